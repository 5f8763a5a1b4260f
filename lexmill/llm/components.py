"""Connected components by alternating stars, on distributed edges alone.

Each round re-hangs the larger neighbours of every node under its smallest neighbour (large star) and then links
the smaller neighbours among themselves (small star). Both are a map-side combined minimum and one equi-join, so a
hub costs a minimum, never a list of its neighbours. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import removed_tables, written


def components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge and is not its component's smallest; root is that smallest."""
    now = written(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(rounds):
        if settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.join(least.filter("m < a"), "a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        before, now = now, written(small, "stars")
        removed_tables(before)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def settled(edges: DataFrame) -> bool:
    """Whether edges from larger a to smaller b are stars: each a has one b, and no b is an a."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    held = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.filter("up > 1 or up = 1 and down = 1").isEmpty()
