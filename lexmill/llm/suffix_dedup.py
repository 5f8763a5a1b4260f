"""Removal of repeated byte strings by bucket-pointer refinement on a sparse suffix array.

Suffixes are compared through buckets, not bytes. The initial buckets are the 8-grams at each position; a bucket of
depth 2d is named by the bucket of depth d at the position and the bucket identifier d later, so each refinement
reuses the last one, and depth ``width`` takes five of them. Identifiers are 64-bit names of content, alike in all
tasks, so the refinement of a text needs no other text.

What the corpus must sort is a sparse set of suffixes. Every window of ``width`` bytes has one anchor, the position
of its smallest bucket of depth ``depth``; equal windows have their anchors at equal places. An anchor owns a run of
window starts. A task first sorts the anchors of its own portion on their buckets and refined buckets, and sends on
one of each. Over the whole corpus the buckets are then counted, which is combined before the shuffle, and those with
one member are done: no window that they own occurs twice. The others are refined in two steps:

1. by the identifiers at both ends of their run (and the run's shape), which name all bytes that its windows cover;
   a refined bucket with two members settles all their windows at once, as repeated;
2. where a bucket fell into several refined ones, one member of each goes on: its run is cut into blocks, each with
   the bucket of the bytes that all its windows share and the refined bucket of those that any has, and step 1
   holds again. Blocks that are still open after it are spelled out window by window.

Members learn what became of their bucket by joins in which the largest buckets are split over many tasks; copies
never meet in pairs or lists. Identifiers stand for their bytes unread: members of a bucket are told apart by their refined
bucket and by a ``second`` name, another hash (XXH64) of all bytes that their windows cover, and single windows by two
identifiers of different seeds. So among n members two unequal strings pass for equal with a probability of about
n^2 / 2^129.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import released, salted_join, slices, with_text, written

#: Odd multipliers of the mixing step (fixed values: 64-bit fractions of the golden ratio and two finalisers).
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes whose suffixes are held at once, eight bytes an identifier.
CHUNK = 1 << 21
#: Windows to a block, the step between a whole run and single windows.
BLOCK = 16
RUN = "k long, mark long, bucket long, refined long, second long, start long, length int, lead int"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of identifiers."""
    x = a * GOLDEN
    x ^= x >> np.uint64(29)
    x += b
    x *= MIX1
    x ^= x >> np.uint64(32)
    x *= MIX2
    x ^= x >> np.uint64(29)
    return x


class Buckets:
    """Bucket identifiers of all positions of a byte string, refined from 8-grams by doubling."""

    def __init__(self, data: bytes, seed: int = 0):
        raw = np.frombuffer(data, np.uint8)
        first = np.lib.stride_tricks.as_strided(np.frombuffer(data + bytes(8), np.uint8), (max(len(raw) - 7, 0), 8), (1, 1))
        grams = np.ascontiguousarray(first).view("<u8").ravel()
        self.at = {8: mixed(grams, np.uint64(2 * seed + 1))}
        self.size = len(raw)

    def depth(self, d: int) -> np.ndarray:
        """Identifiers of depth d, at positions that have so many bytes."""
        if d not in self.at:
            half = 8
            while 2 * half < d:
                half *= 2
            low = self.depth(half)
            n = max(self.size - d + 1, 0)
            self.at[d] = mixed(low[:n], low[d - half : d - half + n])
        return self.at[d]


def seconds(data: bytes, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Second names of runs of windows: a hash of the bytes that they cover."""
    view = memoryview(data)
    names = [xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + width).tolist(), strict=True)]
    return np.array(names, np.uint64).view(np.int64)


def anchors(buckets: Buckets, width: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of a byte string, ascending; windows are named by their starts."""
    grams, windows = buckets.depth(depth), buckets.size - width + 1
    span = width - depth + 1
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    step, best = 1, key
    while 2 * step <= span:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if span > step:
        best = np.minimum(best[: windows], best[span - step : span - step + windows])
    owner = (best[:windows] & low).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ends = np.r_[starts[1:], windows] - 1
    return owner[starts], starts, ends


def portions(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Parts of documents with their keys (k, mark, base), about CHUNK bytes together.

    A longer document comes in parts that share ``width - 1`` bytes, so each of its windows is in one part.
    """
    keys, parts, size = [], [], 0
    for batch in batches:
        for k, mark, text in zip(batch["k"], batch["mark"], batch["text"], strict=True):
            data = text.encode()
            for at in range(0, len(data) - width + 1, CHUNK):
                part = data[at : at + CHUNK + width - 1]
                keys.append((k, mark, at))
                parts.append(part)
                size += len(part)
                if size >= CHUNK:
                    yield pd.DataFrame(keys, columns=["k", "mark", "base"]), parts
                    keys, parts, size = [], [], 0
    if keys:
        yield pd.DataFrame(keys, columns=["k", "mark", "base"]), parts


def owned(keys: pd.DataFrame, parts: list[bytes], width: int, depth: int) -> pd.DataFrame:
    """A row per anchor and part: key, bucket, refined bucket, and its run of windows (first start, how many).

    Members of one refined bucket in the portion are settled here (``whole``); one of them goes on, as ``many``.
    """
    cuts = np.cumsum([0, *map(len, parts)])
    data = b"".join(parts)
    buckets = Buckets(data)
    anchor, first, last = anchors(buckets, width, depth)
    ends, pieces = cuts[1:], []
    doc = np.searchsorted(ends, first, "right")
    while len(anchor):  # a run ends where its part does: a window across parts is none
        stop = ends[doc] - width
        keep = first <= stop
        pieces.append((doc[keep], anchor[keep], first[keep], np.minimum(last, stop)[keep]))
        more = last >= ends[doc]
        anchor, last, first, doc = anchor[more], last[more], ends[doc[more]], doc[more] + 1
    doc, anchor, first, last = (np.concatenate(x) for x in zip(*pieces, strict=True))
    full, fine = buckets.depth(width), buckets.depth(depth)
    shape = ((anchor - first) * 65536 + (last - first)).astype(np.uint64)
    refined = mixed(mixed(full[first], full[last]), shape)
    rows = {c: keys[c].to_numpy()[doc] for c in ("k", "mark")}
    rows |= {"bucket": fine[anchor].view(np.int64), "refined": refined.view(np.int64), "second": seconds(data, first, last, width), "start": first - cuts[doc] + keys["base"].to_numpy()[doc], "length": last - first + 1, "lead": anchor - first}
    found = pd.DataFrame(rows)
    order = np.lexsort((rows["second"], rows["refined"], rows["bucket"]))
    sorted_ = np.stack([rows[c][order] for c in ("bucket", "refined", "second")])
    same = np.r_[False, (sorted_[:, 1:] == sorted_[:, :-1]).all(0), False]  # as the one before
    goes, whole = np.ones(len(order), bool), np.zeros(len(order), bool)
    goes[order] = ~same[:-1]
    whole[order] = same[:-1] | same[1:]
    return found.assign(whole=whole, goes=goes)


def opened(batch: pd.DataFrame, width: int) -> tuple[bytes, pd.DataFrame]:
    """The bytes of a batch's jobs one after another, and a row per job with ``place``, where its first window is."""
    parts, rows, place = [], [], 0
    for k, mark, data, jobs in zip(batch["k"], batch["mark"], batch["packed"], batch["jobs"], strict=True):
        data = zstandard.decompress(data)
        for job in jobs:
            parts.append(data[job["start"] : job["start"] + job["length"] + width - 1])
            rows.append((k, mark, job["start"], job["length"], job["lead"], job["many"], place))
            place += len(parts[-1])
    return b"".join(parts), pd.DataFrame(rows, columns=["k", "mark", "start", "length", "lead", "many", "place"])


def stepped(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` items: the item's row, and its number among the row's, from 0."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(batch: pd.DataFrame, width: int, size: int) -> pd.DataFrame:
    """Runs cut into blocks of windows that lie at the same ``size`` distances before their anchor.

    A block's bucket names the bytes that all windows at these distances share, its refined bucket those that any of
    the block's windows has.
    """
    data, jobs = opened(batch, width)
    lead, length, place = (jobs[c].to_numpy() for c in ("lead", "length", "place"))
    low = (lead - length + 1) // size  # the nearest block
    row, n = stepped(lead // size - low + 1)
    q = low[row] + n
    near, far = np.maximum(q * size, (lead - length + 1)[row]), np.minimum(q * size + size - 1, lead[row])
    first, last = lead[row] - far, lead[row] - near  # windows of the run
    buckets = Buckets(data, 5)
    full, core = buckets.depth(width), buckets.depth(width - size + 1)
    bucket = mixed(core[place[row] + lead[row] - q * size], q.astype(np.uint64))
    shape = ((far - q * size) * size + near - q * size).astype(np.uint64)
    refined = mixed(mixed(full[place[row] + first], full[place[row] + last]), shape)
    out = {c: jobs[c].to_numpy()[row] for c in ("k", "mark", "many")}
    second = seconds(data, place[row] + first, place[row] + last, width)
    return pd.DataFrame(out | {"bucket": bucket.view(np.int64), "refined": refined.view(np.int64), "second": second, "start": jobs["start"].to_numpy()[row] + first, "length": last - first + 1, "lead": far})


def spelled(batch: pd.DataFrame, width: int) -> pd.DataFrame:
    """The windows of runs, named by two independent identifiers: (w1, w2, k, mark, at, many)."""
    data, jobs = opened(batch, width)
    row, n = stepped(jobs["length"].to_numpy())
    places = jobs["place"].to_numpy()[row] + n
    names = {f"w{i}": Buckets(data, seed).depth(width)[places].view(np.int64) for i, seed in ((1, 3), (2, 4))}
    out = {c: jobs[c].to_numpy()[row] for c in ("k", "mark", "many")}
    return pd.DataFrame(names | out | {"at": jobs["start"].to_numpy()[row] + n})


def covered(runs: list, width: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes that windows cover: with starts from lo to hi, or those of 64 from lo on that ``bits`` has."""
    starts = [(r["lo"], r["hi"]) for r in runs if not r["bits"]]
    starts += [(r["lo"] + i, r["lo"] + i) for r in runs if r["bits"] for i in range(64) if r["bits"] >> i & 1]
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + width)
        else:
            out.append([lo, hi + width])
    return [tuple(x) for x in out]


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, depth: int = 48, whole_characters: bool = False) -> DataFrame:
    """(k, mark, spans, kept binary) of the documents that hold a repeated ``width``-byte string.

    ``k`` is the id (a fixed number for null) and ``mark`` a hash of the text; ``kept`` is what remains of its UTF-8
    bytes, with ``whole_characters`` without those of characters that a cut has split. Rows with equal ``k`` and text share one row here, but count as two places.
    """
    spark = docs.sparkSession
    texts = keyed(docs, id_col, text_col).filter(F.octet_length("text") >= width).select("k", "mark", "text")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, parts in portions(batches, width):
            yield owned(keys, parts, width, depth)

    found = written(texts.mapInPandas(find, f"{RUN}, whole boolean, goes boolean"), "anchors")
    settled = refine(found.filter("goes").drop("goes").withColumnRenamed("whole", "many"), "settled")
    copies = found.filter("whole and not goes").select("k", "mark", "start", "length")
    whole = written(settled.filter("many").select("k", "mark", "start", "length").union(copies), "whole")
    released(spark, found)
    touched = whole.select("k", "mark").union(settled.select("k", "mark")).distinct()

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        make = zstandard.ZstdCompressor(level=3)
        return pd.Series([make.compress(v.encode()) for v in values])

    affected = written(texts.select("k", "mark", packed("text").alias("packed")).join(touched, ["k", "mark"]).dropDuplicates(["k", "mark"]), "affected")
    released(spark)

    def named(runs: DataFrame, make, schema: str) -> DataFrame:
        jobs = runs.groupBy("k", "mark").agg(F.collect_set(F.struct("start", "length", "lead", "many")).alias("jobs"))
        return affected.join(jobs, ["k", "mark"]).mapInPandas(lambda batches: (make(b) for b in slices(batches)), schema)

    blocked = written(named(settled.filter("open"), lambda b: blocks(b, width, BLOCK), f"{RUN}, many boolean"), "blocks")
    parts = refine(blocked, "parts")
    released(spark, blocked)
    windows = written(named(parts.filter("open"), lambda b: spelled(b, width), "w1 long, w2 long, k long, mark long, at long, many boolean"), "windows")
    common = written(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    partly = salted_join(windows.filter("not many"), common, ["w1", "w2"], "n", ["k", "mark", "at"])
    # 64 starts to a number, so that single windows of a long text take less room than itself
    bits = F.expr("bit_or(shiftleft(1L, cast(pmod(at, 64) as int)))")
    partly = partly.groupBy("k", "mark", F.expr("at div 64").alias("_q")).agg(bits.alias("bits")).select("k", "mark", (F.col("_q") * 64).alias("lo"), F.lit(-1).cast("long").alias("hi"), "bits")
    runs = whole.union(parts.filter("many").select("k", "mark", "start", "length"))
    runs = runs.select("k", "mark", F.col("start").alias("lo"), (F.col("start") + F.col("length") - 1).alias("hi"), F.lit(0).cast("long").alias("bits"))
    runs = written(runs.union(partly).groupBy("k", "mark").agg(F.collect_set(F.struct("lo", "hi", "bits")).alias("runs")), "runs")
    released(spark, windows, common, parts, whole, settled)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for k, mark, data, found in zip(batch["k"], batch["mark"], batch["packed"], batch["runs"], strict=True):
                data, spans = zstandard.decompress(data), covered(found, width)
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept = kept.decode(errors="ignore").encode() if whole_characters else kept
                out.append((k, mark, [{"start": a, "end": b} for a, b in spans], kept))
            yield pd.DataFrame(out, columns=["k", "mark", "spans", "kept"])

    joined = affected.select("k", "mark", "packed").join(runs, ["k", "mark"])
    return joined.mapInPandas(apply, "k long, mark long, spans array<struct<start long, end long>>, kept binary")


def refine(runs: DataFrame, name: str) -> DataFrame:
    """Runs that may hold repeated windows, of rows (k, mark, bucket, refined, second, start, length, lead, many) of a table.

    ``many``: the refined bucket has several members (or came so), which settles the run. ``open``: the bucket has
    several refined ones, and this run stands for its own. Runs alone in their bucket are gone. The result is written.
    """
    place = F.xxhash64("k", "mark", "start")
    several = runs.groupBy("bucket").agg(F.count("*").alias("members"), F.max("many").alias("came"))
    several = written(several.filter("members > 1 or came").drop("came"), "several")
    held = salted_join(runs, several.withColumn("of", F.col("members")), ["bucket"], "members", ["k", "mark", "start"])
    held = written(held.withColumn("place", place), "held")
    released(runs.sparkSession, several)
    # a refined bucket with fewer members than its bucket is not the only one; the member with the least name stands for it
    refined = held.groupBy("bucket", "refined", "second").agg(F.count("*").alias("n"), F.max("many").alias("came"), F.min("place").alias("one"), F.max("of").alias("all"))
    verdict = written(refined.select("bucket", "refined", "second", "n", ((F.col("n") > 1) | F.col("came")).alias("_many"), F.when(F.col("n") < F.col("all"), F.col("one")).alias("_one")), "refined")
    joined = salted_join(held.drop("many", "of"), verdict, ["bucket", "refined", "second"], "n", ["place"])
    out = joined.select("k", "mark", "start", "length", "lead", F.col("_many").alias("many"), F.coalesce(F.col("_one") == F.col("place"), F.lit(False)).alias("open"))
    out = written(out.filter("many or open"), name)
    released(runs.sparkSession, held, verdict)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``k``, ``mark`` and ``text`` without nulls."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.lit(11), text).alias("mark"), text.alias("text"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``.

    Defined cases: null texts count as empty; texts shorter than ``width`` bytes keep all; rows repeating a text are
    two places of all its strings, whatever their ids; an empty table gives an empty table; other columns play no part.
    """
    changed = cut(docs, id_col, text_col, width).select("k", "mark", F.size("spans").cast("long").alias("_n"), F.octet_length("kept").cast("long").alias("_left"), F.sha2("kept", 256).alias("_sha"))
    plain = keyed(docs.select(id_col, text_col), id_col, text_col).select("k", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_whole"))
    return plain.join(changed, ["k", "mark"], "left").select(
        F.when(F.col("k") != -(1 << 63), F.col("k")).alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.coalesce("_left", "n_bytes")).alias("n_removed"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("_sha", "_whole").alias("kept_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """The columns of ``docs``, texts without their repeated strings and without characters that a cut has split.

    Defined cases: null texts become empty ones, null ids stay; rows repeating a text lose all of it if it is long enough;
    an empty table stays empty; columns of any other names stay as they are.
    """
    changed = cut(docs, id_col, text_col, width, whole_characters=True).select(F.col("k").alias("_lexmill_k"), F.col("mark").alias("_lexmill_m"), F.col("kept").cast("string").alias("_lexmill_kept"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn("_lexmill_key", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn("_lexmill_mark", F.xxhash64(F.lit(11), text))
    joined = marked.join(changed, (F.col("_lexmill_key") == F.col("_lexmill_k")) & (F.col("_lexmill_mark") == F.col("_lexmill_m")), "left")
    return with_text(joined, F.coalesce("_lexmill_kept", text), text_col).drop("_lexmill_k", "_lexmill_m", "_lexmill_key", "_lexmill_mark", "_lexmill_kept")
