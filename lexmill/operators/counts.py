"""Counting and merging of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_keys(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """Rows per key: combined in each task, shuffled by key and summed, with spill."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def token_counts(df: DataFrame, column: str = "value", sep: str = " ") -> DataFrame:
    """(token, n) over all texts of a column."""
    return count_keys(df.select(F.explode(F.split(F.col(column), sep)).alias("token")), "token")


def merge_counts(*parts: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Sums of equal keys over several count tables."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum(name).alias(name))


def count_unaligned(pairs: DataFrame, links: DataFrame, on: list[str], side: str = "src") -> DataFrame:
    """(word, n) of the words at positions without a link; ``side`` is ``src`` (l) or ``trg`` (r)."""
    place = "l" if side == "src" else "r"
    used = links.select(*on, F.col(place).alias("pos")).distinct()
    words = pairs.select(*on, F.posexplode(F.split(F.col(side), " ")).alias("pos", "word"))
    return count_keys(words.join(used, [*on, "pos"], "left_anti"), "word")


def conditional(df: DataFrame, f: str = "f", t: str = "t", n: str = "c_both") -> DataFrame:
    """(f, t, n, p_ft, p_tf): joint counts over those of t and of f, all summed over the rows given."""
    joint = df.groupBy(f, t).agg(F.sum(n).alias(n))
    of_f, of_t = (joint.groupBy(k).agg(F.sum(n).cast("double").alias(f"_{k}")) for k in (f, t))
    out = joint.join(of_f, f).join(of_t, t)
    return out.select(f, t, n, (F.col(n) / F.col(f"_{t}")).alias("p_ft"), (F.col(n) / F.col(f"_{f}")).alias("p_tf"))
