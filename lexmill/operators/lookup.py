"""Joins with a table of unique keys, some of which a large part of all rows may ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key beyond which it is dealt in parts, and keys that may be broadcast as such.
HOT_ROWS, HOT_KEYS = 100_000, 100_000


def lookup(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], how: str = "left", hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once (``how``: ``left``, ``inner`` or ``left_semi``).

    Rows of a key are counted first, combined in each task. A key of over ``hot`` rows is dealt by a hash of ``spread``
    over as many parts as it needs, and its row of the table is copied into each; other keys are joined as they are.
    Keys to deal are few, as each stands for ``hot`` rows, and are broadcast, HOT_KEYS of them at most (``hot`` grows,
    if need be). ``rows`` is computed twice: write it first where that is dear. Null keys find nothing.
    """
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_size"))
    while (heavy := sizes.filter(F.col("_size") > hot).limit(HOT_KEYS + 1).collect()) and len(heavy) > HOT_KEYS:
        hot *= 4
    if not heavy:
        return rows.join(table, on, how)
    parts = F.ceil(F.col("_size") / hot).cast("int").alias("_parts")
    dealt = F.broadcast(rows.sparkSession.createDataFrame(heavy, sizes.schema).select(*on, parts))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int").alias("_salt")
    mine = rows.join(dealt, on, "left").select(*rows.columns, salt)
    last = F.coalesce(F.col("_parts") - 1, F.lit(0))
    copies = table.join(dealt, on, "left").select(*table.columns, F.explode(F.sequence(F.lit(0), last)).alias("_salt"))
    return mine.join(copies, [*on, "_salt"], how).drop("_salt")
