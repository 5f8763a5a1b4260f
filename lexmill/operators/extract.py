"""Phrase pairs from word alignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.counts import count_keys


def aligned(pairs: DataFrame, links: DataFrame, on: list[str]) -> DataFrame:
    """``pairs`` with their links as a sorted array of (l, r); pairs without links go."""
    return pairs.join(links.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("l", "r"))).alias("links")), on)


def from_lines(alignments: DataFrame, corpus: DataFrame, on: Sequence[str] = ("line_no",), column: str = "value") -> DataFrame:
    """Sentences (src, trg, links) of alignment lines (``0-0 1-2``) and corpus lines (``src ||| trg``) at the same place.

    Links keep the order of their line. Corpus lines without exactly two sides and blank alignment lines are left
    out, and an empty alignment line gives no links; another link than two numbers fails the query.
    """
    sides = F.split(F.col(column), " \\|\\|\\| ")
    text = corpus.select(*on, sides.alias("_s")).filter(F.size("_s") == 2).select(*on, F.get("_s", F.lit(0)).alias("src"), F.get("_s", F.lit(1)).alias("trg"))
    number = lambda x, k: F.get(F.split(x, "-"), F.lit(k)).cast("int").alias("lr"[k])
    pairs = F.filter(F.split(F.col(column), "\\s+"), lambda x: x != "")
    good = F.when(F.col(column).rlike("^\\s*(?:\\d+-\\d+(?:\\s+|$))*$"), F.transform(pairs, lambda x: F.struct(number(x, 0), number(x, 1))))
    bad = F.raise_error(F.concat(F.lit("bad alignment: "), F.col(column))).cast("array<struct<l:int,r:int>>")
    links = alignments.filter(~F.col(column).rlike("^\\s+$")).select(*on, F.coalesce(good, bad).alias("links"))
    return text.join(links, list(on))


def narrow(n: Column, low: Column, high: Column, most: int, rate: float) -> Column:
    """``n`` different places, ``most`` at most, that fill ``rate`` of their range."""
    return (n <= most) & ((high == low) | (n >= F.lit(rate) * (high - low)))


def good_ends(window: Column, most: int, rate: float) -> Column:
    """How many links, from the first on, make a good run: different places and bounds of both sides are carried along,
    and nothing more is done once there are too many."""
    state = "struct<n:int,ls:array<int>,rs:array<int>,l0:int,l1:int,r0:int,r1:int,ends:array<int>>"
    ints = F.array().cast("array<int>")
    first = F.get(window, F.lit(0))
    start = F.struct(F.lit(0).alias("n"), ints.alias("ls"), ints.alias("rs"), *[first[c].alias(f"{c}{k}") for c in "lr" for k in (0, 1)], ints.alias("ends")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        sets = {c: F.when(F.array_contains(acc[f"{c}s"], x[c]), acc[f"{c}s"]).otherwise(F.array_append(acc[f"{c}s"], x[c])) for c in "lr"}
        bounds = {c: (F.least(acc[f"{c}0"], x[c]), F.greatest(acc[f"{c}1"], x[c])) for c in "lr"}
        good = narrow(F.size(sets["l"]), *bounds["l"], most, rate) & narrow(F.size(sets["r"]), *bounds["r"], most, rate)
        n = acc["n"] + 1
        on = F.struct(n.alias("n"), sets["l"].alias("ls"), sets["r"].alias("rs"), *[bounds[c][k].alias(f"{c}{k}") for c in "lr" for k in (0, 1)], F.when(good, F.array_append(acc["ends"], n)).otherwise(acc["ends"]).alias("ends"))
        return F.when((F.size(acc["ls"]) > most) | (F.size(acc["rs"]) > most), acc).otherwise(on.cast(state))

    return F.aggregate(window, start, step, lambda acc: acc["ends"])


def phrases(df: DataFrame, src: str = "src", trg: str = "trg", most: int = 5, rate: float = 0.75, inverse: bool = False, repaired: bool = False) -> DataFrame:
    """One row per good run of consecutive links: both phrases and both lists of places. As is, the last link is in none.

    Left places are those of ``src`` words, right ones of ``trg`` words; ``inverse`` exchanges which is the foreign side.
    Each start is a row of its own, with as many links as a good run may have (``most`` squared, since links differ).
    """
    last = F.size("links") - (0 if repaired else 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.slice("links", i, F.least(F.lit(most * most), last - i + 1)))
    rest = [c for c in df.columns if c != "links"]
    rows = df.select(*rest, F.explode(windows).alias("_window"))
    rows = rows.withColumn("_end", F.explode(good_ends(F.col("_window"), most, rate)))
    run = F.slice("_window", F.lit(1), F.col("_end"))
    rows = rows.select(*rest, F.transform(run, lambda y: y["l"]).alias("_l"), F.transform(run, lambda y: y["r"]).alias("_r"))

    def text(side: str, places: str) -> Column:
        low = F.array_min(places)
        return F.array_join(F.slice(F.split(F.col(side), " "), low + 1, F.array_max(places) - low + 1), " ")

    rows = rows.withColumn("_a", text(src, "_l")).withColumn("_b", text(trg, "_r"))
    names = {"foreign": "_b", "translation": "_a", "f_places": "_r", "t_places": "_l"} if inverse else {"foreign": "_a", "translation": "_b", "f_places": "_l", "t_places": "_r"}
    return rows.select(*rest, *[F.col(v).alias(k) for k, v in names.items()])


def pair_counts(found: DataFrame) -> DataFrame:
    """(foreign, translation, n)."""
    return count_keys(found, "foreign", "translation")


def side_counts(found: DataFrame, on: list[str], side: str = "foreign") -> DataFrame:
    """(phrase, n): once per sentence and list of places on that side (lists, not spans: repeats in one tell)."""
    places = "f_places" if side == "foreign" else "t_places"
    return count_keys(found.select(*on, side, places).distinct().select(F.col(side).alias("phrase")), "phrase")
