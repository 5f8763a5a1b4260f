"""Literals, dictionaries and comparison of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import edit_score, highlight, words

#: A quoted literal of one character at least, and a language tag of two or three characters at the end (fixed values).
LITERAL, TAG = '"([^"]+)"', "@...?$"


def literals(df: DataFrame, column: str = "value", lang: str | None = None) -> DataFrame:
    """(literal) of quoted literals; with ``lang``, of those whose tag begins with it, else of all."""
    pattern = LITERAL if lang is None else f"{LITERAL}@{lang}"
    return df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))).alias("literal"))


def translate_literals(df: DataFrame, dictionary: DataFrame, key: list[str], column: str = "value", on_bad: str = "fail") -> DataFrame:
    """Each quoted literal, quotes included, replaced by its translation, one after another over the whole line.

    ``dictionary`` has (label, translation[, line_no]); of equal labels the last line counts; a trailing language tag
    of two or three characters goes. Two quotes with nothing between are no literal. A literal without a translation fails the query, or stays (``on_bad="skip"``).
    """
    order = "line_no" if "line_no" in dictionary.columns else "translation"
    known = dictionary.groupBy("label").agg(F.regexp_replace(F.max_by("translation", order), TAG, "").alias("_to"))
    found = df.select(*key, column, F.regexp_extract_all(F.col(column), F.lit(LITERAL), F.lit(1)).alias("_all"))
    each = found.select(*key, F.posexplode("_all").alias("_pos", "label")).join(known, "label", "left")
    to = F.coalesce("_to", F.raise_error(F.concat(F.lit("no translation: "), F.col("label"))).cast("string")) if on_bad == "fail" else F.coalesce("_to", F.concat(F.lit('"'), F.col("label"), F.lit('"')))
    pairs = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_pos", F.concat(F.lit('"'), F.col("label"), F.lit('"')).alias("_from"), to.alias("_to")))).alias("_pairs"))
    line = F.aggregate(F.coalesce("_pairs", F.array().cast("array<struct<_pos:int,_from:string,_to:string>>")), F.col(column), lambda acc, p: F.replace(acc, p["_from"], p["_to"]))
    return found.drop("_all").join(pairs, key, "left").select(*key, line.alias(column))


def rewritten(df: DataFrame, suffixes: dict[str, str], column: str = "value") -> DataFrame:
    """``df`` with each line that ends in a key of ``suffixes`` replaced by its value; the first such key counts."""
    ends = [F.when(F.col(column).endswith(F.lit(k)), F.lit(v)) for k, v in suffixes.items()]
    return df.withColumn(column, F.coalesce(*ends, F.col(column)))


def compared(df: DataFrame, hypothesis: str, reference: str, lower: bool = False, repaired: bool = False, mark: str = "*") -> DataFrame:
    """``df`` with ``shown``: the hypothesis' words, those in the reference marked, then the reference, all as they are.

    ``lower`` compares words without case. As is, the hypothesis is compared with itself, so that every word is marked.
    """
    split = lambda c: words(F.col(c), "\\s+")
    mine, other = split(hypothesis), split(reference if repaired else hypothesis)
    return df.withColumn("shown", F.concat_ws(" ||| ", highlight(mine, other, mark, lower), F.col(reference)))


def edit_scores(df: DataFrame, left: str, right: str, lower: bool = False) -> DataFrame:
    """``df`` with ``edit``, the edit score of two texts' words."""
    low = (lambda c: F.lower(F.col(c))) if lower else F.col
    return df.withColumn("edit", edit_score(F.split(low(left), " "), F.split(low(right), " ")))


def mean_edit_score(df: DataFrame, left: str, right: str, lower: bool = False) -> DataFrame:
    """(score): mean edit score over all rows; NaN without rows."""
    return edit_scores(df, left, right, lower).agg(F.coalesce(F.avg("edit"), F.lit(float("nan"))).alias("score"))
