"""Filters of phrase tables and language models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.stats import hypergeometric_tail
from lexmill.functions.text import tokens
from lexmill.operators.adjacent import runs
from lexmill.shared import written

INFINITY = float("inf")


def coverage(align: Column, f: Column, t: Column) -> Column:
    """Links over the words of the longer side."""
    return F.size(F.split(F.trim(align), "\\s+")).cast("double") / F.greatest(tokens(f), tokens(t))


def basic_filter(df: DataFrame, percent: float, least: int) -> DataFrame:
    """Pairs covered by more than ``percent`` and seen ``least`` times at least."""
    return df.filter((coverage(F.col("align"), F.col("f"), F.col("t")) > percent) & (F.col("c_both") >= least))


def relative_entropy(threshold: float, pft: Column, lft: Column, both: Column, f: Column) -> Column:
    """both x (ln pft + boost) for one-word f, else both x (ln pft - ln lft); null where pft or both is 0."""
    usable = (pft > 0) & (both > 0)
    one = both * (F.log(pft) + (abs(threshold) + 5))
    more = F.when(lft > 0, both * (F.log(pft) - F.log(lft))).otherwise(F.lit(INFINITY))
    return F.when(usable, F.when(tokens(f) == 1, one).otherwise(more))


def entropy_filter(df: DataFrame, threshold: float, least_coverage: float = 0.5) -> DataFrame:
    """``df`` with ``entropy``, of the pairs above ``threshold`` that are covered by ``least_coverage`` at least."""
    scored = df.withColumn("entropy", relative_entropy(threshold, F.col("pft"), F.col("lft"), F.col("c_both"), F.col("f")))
    good = F.col("entropy").isNotNull() & ~F.isnan("entropy") & (F.col("entropy") > threshold)
    return scored.filter(good & (coverage(F.col("align"), F.col("f"), F.col("t")) >= least_coverage))


def compositional_filter(df: DataFrame, threshold: float, short: int = 3) -> DataFrame:
    """``df`` (f, t, p, n) with ``entropy`` = n x (ln p - ln best), of the pairs above ``threshold``.

    ``best`` is the greatest product of two entries that compose the pair, cut once on each side, in order or
    crossed; entries have up to ``short`` words a side. A pair that nothing composes has an infinite entropy.
    The pairs are used four times and so written first.
    """
    df = written(df, "pairs")
    few = df.filter((tokens(F.col("f")) <= short) & (tokens(F.col("t")) <= short)).select("f", "t", "p")
    halves = lambda x, i: (F.array_join(F.slice(x, F.lit(1), i), " "), F.array_join(F.slice(x, i + 1, F.size(x)), " "))
    cut = df.select("f", "t", F.split("f", "\\s+").alias("_f"), F.split("t", "\\s+").alias("_t")).filter((F.size("_f") > 1) & (F.size("_t") > 1))
    cut = cut.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_f") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(1), F.size("_t") - 1)))
    (f1, f2), (t1, t2) = halves(F.col("_f"), F.col("_i")), halves(F.col("_t"), F.col("_j"))
    both = F.explode(F.array(F.struct(f1.alias("fa"), t1.alias("ta"), f2.alias("fb"), t2.alias("tb")), F.struct(f1.alias("fa"), t2.alias("ta"), f2.alias("fb"), t1.alias("tb"))))
    ways = cut.select("f", "t", both.alias("_w")).select("f", "t", "_w.*")
    one, two = few.toDF("fa", "ta", "_pa"), few.toDF("fb", "tb", "_pb")
    best = ways.join(one, ["fa", "ta"]).join(two, ["fb", "tb"]).groupBy("f", "t").agg(F.max(F.col("_pa") * F.col("_pb")).alias("_best"))
    entropy = F.when(F.col("p") > 0, F.when(F.col("_best") > 0, F.col("n") * (F.log("p") - F.log("_best"))).otherwise(F.lit(INFINITY)))
    return df.join(best, ["f", "t"], "left").withColumn("entropy", entropy).drop("_best").filter((F.col("entropy") > threshold) & ~F.isnan("entropy"))


def fisher_filter(df: DataFrame, population: int, threshold: float, order: list[str], repaired: bool = False, line_no: str | None = None, tail: Callable = hypergeometric_tail) -> DataFrame:
    """``df`` with ``score``: one-word pairs that are significant, or the best one of their f if none is.

    ``order`` names the columns that give the input order. As is, an f goes whose last row has a t of several words,
    and so does the f of the last row of all. With ``line_no``, rows are lines in that order, sorted or not, and only
    neighbouring lines of an f belong together. ``tail``: what makes the score, ``hypergeometric_tail`` or, where results
    have to equal those of SQL with lgamma, ``hypergeometric_sum``.
    """
    rows = df.withColumn("_of", F.struct("f")) if line_no is None else runs(df, ["f"], line_no, "_of")
    rows = rows.withColumn("_order", F.struct(*([line_no] if line_no else order)))
    single = rows.filter(~F.col("f").contains(" ") & ~F.col("t").contains(" "))
    scored = single.withColumn("score", tail(population)("c_first", "c_second", "c_both"))
    # the least score of each f, and of equal ones the last row's, combined before the shuffle
    best = scored.groupBy("_of").agg(F.max(F.struct((-F.col("score")).alias("s"), "_order")).alias("_best"))
    kept = scored.join(best, "_of").filter((F.col("score") < threshold) | ((-F.col("_best.s") >= threshold) & (F.col("_order") == F.col("_best._order")))).drop("_best")
    if not repaired:
        ends = rows.groupBy("_of").agg(F.max_by("t", "_order").alias("_t")).filter(~F.col("_t").contains(" ")).select("_of")
        last = rows.agg(F.max_by("_of", "_order").alias("_of"))  # one row
        kept = kept.join(ends, "_of", "left_semi").join(F.broadcast(last), "_of", "left_anti")
        kept = kept if line_no is None else kept.filter("f <> ''")
    return kept.drop("_order", "_of")


def clamp_log_probabilities(df: DataFrame, column: str = "logp") -> DataFrame:
    """Log probabilities above 0 become 0."""
    return df.withColumn(column, F.least(F.lit(0.0), F.col(column).cast("double")))


def length_filter(df: DataFrame, *columns: str, least: int = 1, most: int = 80) -> DataFrame:
    """Rows whose texts have ``least`` to ``most`` words each."""
    for column in columns:
        df = df.filter(F.size(F.split(F.col(column), " ")).between(least, most))
    return df
