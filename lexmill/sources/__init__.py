"""Lexmill sources."""
