"""Merging of sharded lexical, phrase and reordering tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import links
from lexmill.operators.adjacent import running_max, runs
from lexmill.operators.lookup import lookup
from lexmill.shared import written


def merge_lexical(df: DataFrame, shards: int, shard: str = "shard", floor: float = 0.01, repaired: bool = False) -> DataFrame:
    """(w1, w2, p): mean over ``shards`` tables, a missing entry counting 0.

    As is, what comes before a pair's first value above ``floor`` is lost, and a pair without one is absent.
    Repaired, the sum is held against ``floor / shards``.
    """
    share = F.col("p") / F.lit(float(shards))
    if repaired:
        return df.groupBy("w1", "w2").agg(F.sum(share).alias("p")).filter(F.col("p") > floor / shards)
    big = F.col("p") > floor
    return (
        df.withColumn("_first", F.min(F.when(big, F.col(shard))).over(Window.partitionBy("w1", "w2")))
        .filter(F.col(shard) >= F.col("_first"))
        .groupBy("w1", "w2")
        .agg(F.sum(share).alias("p"))
    )


def lexical_weight(pairs: DataFrame, lexical: DataFrame, forward: bool, name: str, on: tuple[str, ...] = ("f", "t")) -> DataFrame:
    """(on, name): product over the words of one side of their mean probability over linked words.

    Forward, the words of f are looked up with those of t that they link to; else the words of t with those of f. A
    word without links is looked up with NULL; a total of 0 counts 1e-8. Common words are dealt over tasks.
    """
    near, far, here, there = ("f", "t", "l", "r") if forward else ("t", "f", "r", "l")
    base = pairs.select(*on, links(F.col("align")).alias("_links"), F.split(F.col(near), " ").alias("_near"), F.split(F.col(far), " ").alias("_far"))
    words = base.select(*on, "_links", "_far", F.posexplode("_near").alias("_pos", "w1"))
    mine = F.filter("_links", lambda x: x[here] == F.col("_pos"))
    linked = words.withColumn("_w2", F.transform(mine, lambda x: F.get(F.col("_far"), x[there]))).withColumn("_n", F.size("_w2"))
    looked = linked.select(*on, "_pos", "w1", "_n", F.explode(F.when(F.col("_n") == 0, F.array(F.lit("NULL"))).otherwise(F.col("_w2"))).alias("w2"))
    found = lookup(looked, lexical.select("w1", "w2", "p"), ["w1", "w2"], [*on, "_pos"])
    each = found.groupBy(*on, "_pos").agg((F.sum(F.coalesce("p", F.lit(0.0))) / F.greatest(F.max("_n"), F.lit(1))).alias("_p"))
    return each.groupBy(*on).agg(F.product(F.when(F.col("_p") == 0, F.lit(1e-8)).otherwise(F.col("_p"))).alias(name))


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(1e-8)).otherwise(x)


def merge_phrase_tables(df: DataFrame, e2f: DataFrame, f2e: DataFrame, repaired: bool = False, line_no: str | None = None) -> DataFrame:
    """Sharded rows (f, t, align, c_first, c_second, c_both, raw) merged and scored anew.

    Counts are summed, the alignment is that of the least raw line. Groups with an empty f go; as is, so does the
    group of the greatest raw line. With ``line_no``, rows are lines in that order, sorted or not: only neighbouring
    lines are a group, the first one's alignment counts and the last group is the one that goes. The merged rows are
    used three times and so written first.
    """
    sums = [F.sum(c).alias(c) for c in ("c_first", "c_second", "c_both")]
    if line_no is None:
        on = ("f", "t")
        merged = df.filter("f <> ''").groupBy(*on).agg(F.min_by("align", "raw").alias("align"), F.max("raw").alias("_last"), *sums)
        last = df.agg(F.max("raw").alias("_last"))  # one row
    else:
        on = ("_run", "f", "t")
        rows = runs(df, ["f", "t"], line_no, "_run")
        merged = rows.filter("f <> ''").groupBy(*on).agg(F.min_by("align", line_no).alias("align"), F.max("_run").alias("_last"), *sums)
        last = rows.agg(F.max("_run").alias("_last"))
    if not repaired:
        merged = merged.join(F.broadcast(last), "_last", "left_anti")
    merged = written(merged.drop("_last"), "merged")
    lex_f, lex_t = lexical_weight(merged, e2f, True, "_lf", on), lexical_weight(merged, f2e, False, "_lt", on)
    both = F.col("c_both").cast("double")
    return (
        merged.join(lex_f, list(on), "left")
        .join(lex_t, list(on), "left")
        .select("f", "t", finite(both / F.col("c_first")).alias("pft"), finite(F.coalesce("_lf", F.lit(1.0))).alias("lft"), finite(both / F.col("c_second")).alias("ptf"), finite(F.coalesce("_lt", F.lit(1.0))).alias("ltf"), F.lit(2.718).alias("bias"), "align", "c_first", "c_second", "c_both")
    )


def means(kept: DataFrame, on: list[str]) -> DataFrame:
    """(on, scores): means of score arrays by place, as far as the shortest reaches."""
    each = kept.select(*on, F.size("scores").alias("_n"), F.posexplode("scores").alias("_pos", "_x")).groupBy(*on, "_pos").agg(F.avg("_x").alias("_x"), F.min("_n").alias("_n"))
    rows = F.sort_array(F.collect_list(F.struct("_pos", "_x")))
    return each.groupBy(*on).agg(rows.alias("_rows"), F.min("_n").alias("_n")).select(*on, F.transform(F.slice("_rows", F.lit(1), F.col("_n")), lambda x: x["_x"]).alias("scores"))


def merge_reordering(df: DataFrame, table: DataFrame, line_no: str | None = None) -> DataFrame:
    """(f, t, scores): mean of score arrays, as long as the shortest, of the pairs that ``table`` has; an empty f goes.

    With ``line_no``, both inputs are lines in that order, sorted or not, and are read side by side: neighbouring lines of
    a pair are a group, and before each group the table is read on while its line is less than the pair. So the table
    stands at the first of its records (a line that none before it exceeds) that reaches the greatest pair so far, and a
    group is kept where that record is its pair; beyond the last record, at the table's last line.
    """
    if line_no is None:
        return means(df.filter("f <> ''").join(table.select("f", "t"), ["f", "t"], "left_semi"), ["f", "t"])
    pair = F.concat_ws(" ||| ", "f", "t", F.lit(""))
    lines = written(runs(df, ["f", "t"], line_no, "_run"), "runs")
    groups = running_max(lines.groupBy("_run", "f", "t").agg(F.count("*").alias("_n")), pair, "_run", "_top")
    there = written(running_max(table.select("f", "t", line_no), pair, line_no, "_record").withColumn("_pair", pair), "records")
    records = there.filter("_pair = _record").select("_pair").distinct()
    last, most = there.agg(F.max_by("_pair", line_no), F.max("_record")).first()  # two strings
    placed = groups.withColumn("_pair", pair).withColumn("_past", F.col("_top") > F.lit(most))
    inside = placed.filter(~F.col("_past") & (F.col("_pair") == F.col("_top"))).join(records, "_pair", "left_semi")
    kept = inside.select("_run").union(placed.filter(F.col("_past") & (F.col("_pair") == F.lit(last))).select("_run"))
    return means(lines.filter("f <> ''").join(kept, "_run", "left_semi"), ["_run", "f", "t"]).drop("_run")
