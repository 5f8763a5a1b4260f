"""Ranking and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, score: str = "score", line_no: str = "line_no", repaired: bool = False) -> DataFrame:
    """The n rows of greatest (score, line). As is, rows ranked below the first line are never admitted."""
    if not repaired:
        first = df.agg(F.min_by(F.struct(score, line_no), line_no).alias("_first"))  # one row
        df = df.join(F.broadcast(first), F.struct(F.col(score), F.col(line_no)) >= F.col("_first")).drop("_first")
    return df.orderBy(F.desc(score), F.desc(line_no)).limit(n)


def co_filter(lines: DataFrame, chosen: DataFrame, line_no: str = "line_no") -> DataFrame:
    """The lines that were chosen; Spark broadcasts the choice where its size allows."""
    return lines.join(chosen.select(line_no), line_no, "left_semi")


def sweep(df: DataFrame, sizes: list[int], score: str = "score", line_no: str = "line_no") -> DataFrame:
    """(n, line_no, score): the top n for several n, ranked once over the rows of the largest."""
    best = top_n(df, max(sizes), score, line_no, repaired=True)
    ranked = best.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(score), F.desc(line_no))))  # max(sizes) rows
    return ranked.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).filter("_rank <= n").select("n", line_no, score)


def sort_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Rows in byte order of a column: a range partitioning and a sort in each part."""
    return df.orderBy(column)
