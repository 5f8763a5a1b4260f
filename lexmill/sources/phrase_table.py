"""Phrase tables, lexical tables, reordering tables and count files as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = " ||| "
BAR = " \\|\\|\\| "


def fields(line: Column) -> Column:
    """Fields between bars, without trailing empty ones."""
    return F.split(F.regexp_replace(line, f"(?:{BAR})+$", ""), BAR)


def held(df: DataFrame, good: Column, on_bad: str, column: str) -> DataFrame:
    """Rows that ``good`` holds for; others are skipped, or fail the query (``on_bad="fail"``)."""
    good = F.coalesce(good, F.lit(False))
    if on_bad == "fail":
        return df.filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col(column)))))
    return df.filter(good)


def parse_phrase_table(df: DataFrame, column: str = "value", on_bad: str = "skip") -> DataFrame:
    """(f, t, pft, lft, ptf, ltf, bias, align, c_first, c_second, c_both, raw) of five-field lines."""
    parts = fields(F.col(column))
    scores, counts = F.split(F.trim(F.get(parts, F.lit(2))), " +"), F.split(F.trim(F.get(parts, F.lit(4))), " +")
    number = lambda x, i, kind: F.get(x, F.lit(i)).try_cast(kind)
    out = df.select(
        F.get(parts, F.lit(0)).alias("f"),
        F.get(parts, F.lit(1)).alias("t"),
        *(number(scores, i, "double").alias(n) for i, n in enumerate(("pft", "lft", "ptf", "ltf", "bias"))),
        F.get(parts, F.lit(3)).alias("align"),
        *(number(counts, i, "long").alias(n) for i, n in enumerate(("c_first", "c_second", "c_both"))),
        F.col(column).alias("raw"),
        F.size(parts).alias("_n"),
    )
    good = (F.col("_n") == 5) & F.col("c_first").isNotNull() & F.col("c_second").isNotNull() & F.col("c_both").isNotNull()
    return held(out, good, on_bad, "raw").drop("_n")


def format_phrase_table(f: Column, t: Column, scores: list[Column], align: Column, counts: list[Column]) -> Column:
    """A phrase table line."""
    return F.concat_ws(SEP, f, t, F.concat_ws(" ", *[s.cast("string") for s in scores]), align, F.concat_ws(" ", *[c.cast("string") for c in counts]))


def parse_lexical(df: DataFrame, column: str = "value", on_bad: str = "skip") -> DataFrame:
    """(w1, w2, p) of ``w1 w2 p`` lines, parted at the last blank."""
    last = F.regexp_extract(column, "^(.*) ([^ ]+)$", 2).try_cast("double")
    pair = F.split(F.regexp_extract(column, "^(.*) ([^ ]+)$", 1), " ")
    out = df.select(F.get(pair, F.lit(0)).alias("w1"), F.get(pair, F.lit(1)).alias("w2"), last.alias("p"), F.col(column).alias("_raw"))
    return held(out, F.col("p").isNotNull() & F.col("w2").isNotNull(), on_bad, "_raw").drop("_raw")


def parse_reordering(df: DataFrame, column: str = "value", on_bad: str = "fail") -> DataFrame:
    """(f, t, scores array<double>) of three-field lines."""
    parts = fields(F.col(column))
    scores = F.transform(F.split(F.trim(F.get(parts, F.lit(2))), " +"), lambda x: x.try_cast("double"))
    out = df.select(F.get(parts, F.lit(0)).alias("f"), F.get(parts, F.lit(1)).alias("t"), scores.alias("scores"), F.size(parts).alias("_n"), F.col(column).alias("_raw"))
    return held(out, F.col("_n") == 3, on_bad, "_raw").drop("_n", "_raw")


def parse_counts(df: DataFrame, column: str = "value", on_bad: str = "skip") -> DataFrame:
    """(key, n) of ``key ||| n`` lines, parted at the last bars."""
    out = df.select(F.regexp_extract(column, f"^(.*){BAR}(\\d+)$", 1).alias("key"), F.regexp_extract(column, f"^(.*){BAR}(\\d+)$", 2).try_cast("long").alias("n"), F.col(column).alias("_raw"))
    return held(out, F.col("n").isNotNull(), on_bad, "_raw").drop("_raw")
