"""Groups of neighbouring lines, for programs that read lines in their order and trust them to be sorted.

On sorted lines the neighbours of equal keys are all rows of a key; on others a key may have several groups. Lines are
dealt by ranges of their numbers and sorted; what crosses a boundary, a row for each range, is carried on in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.shared import written


def ranged(df: DataFrame, line_no: str) -> DataFrame:
    """``df`` dealt by ranges of line numbers, with ``_part``, the range's number; written, so that ranges stay."""
    return written(df.repartitionByRange(line_no).sortWithinPartitions(line_no).withColumn("_part", F.spark_partition_id()), "ranged")


def runs(df: DataFrame, keys: list[str], line_no: str = "line_no", name: str = "run") -> DataFrame:
    """``df`` with the number of the first line of the neighbouring lines that share the keys; nulls equal nulls."""
    rows = ranged(df, line_no)
    inside, key = Window.partitionBy("_part").orderBy(line_no), F.struct(*keys)
    marked = rows.withColumn("_before", F.lag(key).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    # the last keys before each range; ranges are as many as Spark has partitions
    ends = rows.groupBy("_part").agg(F.max_by(key, line_no).alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_carried"))
    marked = marked.join(F.broadcast(ends), "_part").withColumn("_before", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
    starts = F.when(~F.col("_before").eqNullSafe(key) | F.col("_before").isNull(), F.col(line_no))
    return carried(marked.withColumn("_start", starts), "_start", line_no, name).drop("_before", "_first", "_carried", "_start", "_part")


def carried(rows: DataFrame, value: str, line_no: str, name: str) -> DataFrame:
    """``rows`` (with ``_part``) with the greatest ``value`` of all lines up to each one."""
    tops = rows.groupBy("_part").agg(F.max(value).alias("_top"))
    tops = tops.select("_part", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_so_far"))
    so_far = F.max(value).over(Window.partitionBy("_part").orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, so_far).join(F.broadcast(tops), "_part").withColumn(name, F.greatest(name, "_so_far")).drop("_so_far")


def running_max(df: DataFrame, value: Column, line_no: str = "line_no", name: str = "top") -> DataFrame:
    """``df`` with the greatest value of all lines up to each one."""
    return carried(ranged(df, line_no).withColumn("_value", value), "_value", line_no, name).drop("_part", "_value")
