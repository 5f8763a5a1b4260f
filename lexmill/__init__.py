"""Lexmill: a Spark-native engine for text corpora, counts and bilingual phrase tables."""
