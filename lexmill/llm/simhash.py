"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are made by document; equal ones collapse to one representative (its smallest id). The index's upper
nodes are masked bit patterns: the bits are cut into ``distance + 2`` blocks, so two fingerprints within ``distance``
agree on at least two whole blocks, and each pair of blocks with its bits is an upper node. Nodes are shuffled, never
broadcast; one with too many members is split by the blocks of another cut, and so on, until none has too many: a
split fixes about a third of the bits that are still free. Below an upper node the fingerprints stand in Gray rank; runs of neighbours are factored into nodes that
keep the bits which all members share, and those into wider nodes. Two nodes are compared by the bits fixed in both:
beyond ``distance`` the whole pair of groups is pruned, and where even all free bits could not exceed it the groups
are linked without looking at their members. A node emits a spanning forest, not its pairs. Components are joined
across nodes by alternating stars on the distributed edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import released, written
from lexmill.llm.components import components

SEED, BITS = 42, 64
#: Shingles whose bits are counted at once, members of a lowest node, children of a wider one, node pairs held at once.
AT_ONCE, LEAF, FAN, PAIRS = 1 << 16, 16, 8, 1 << 18
#: Large nodes, of 8 bytes each, that may be broadcast, and places over which the members of each of more are dealt.
MOST_LARGE, SPREAD = 2_000_000, 64


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned fingerprint of a text; zero if it has no words."""
    parts = (text or "").encode().lower().split()  # on bytes: A-Z only, and blanks 0x20, 0x09-0x0D only
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    ends = ends[words - 1 :] or ends[-1:]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), AT_ONCE):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=False)]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp long): ``fp`` holds the 64 bits as a signed number."""

    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the Gray order (reflected binary code), as a signed number of the same bits."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp


def blocks(level: int, distance: int) -> list[int]:
    """``distance + 2`` masks that share out the bits: runs of neighbours on the first level, a shuffle of its own on each other."""
    order = np.arange(BITS) if not level else np.random.default_rng(level).permutation(BITS)
    return [sum(1 << int(bit) for bit in part) for part in np.array_split(order, distance + 2)]


def nodes(key: Column, fp: Column, level: int, distance: int) -> Column:
    """Keys of a level's masked bit patterns that hold a fingerprint: two whole blocks each, below the node of ``key``."""
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    pairs = [signed(a | b) for a, b in combinations(blocks(level, distance), 2)]
    return F.array(*[F.xxhash64(key, F.lit(k), fp.bitwiseAND(F.lit(mask))) for k, mask in enumerate(pairs)])


def merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j, pairwise, in an array of smallest members."""
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = up


def linked(fps: np.ndarray, distance: int) -> np.ndarray:
    """Component labels (smallest position) of distinct fingerprints in Gray order, links at ``distance`` or less."""
    n = len(fps)
    labels = np.arange(n)
    levels, low, high = [], fps, fps  # bits set in all members, and in any; free bits differ
    first = np.arange(n + 1)
    while len(low) > 1 or not levels:
        cuts = np.arange(0, len(low), LEAF if not levels else FAN)
        first = np.append(first[cuts], n)
        low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
        levels.append((low, low ^ high, first, len(cuts)))
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS:
            todo += [(level, a[at : at + PAIRS], b[at : at + PAIRS]) for at in range(0, len(a), PAIRS)]
            continue
        if level < 0:
            open_ = labels[a] != labels[b]
            a, b = a[open_], b[open_]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
            merged(labels, a[near], b[near])
            continue
        low, free, first, _ = levels[level]
        loose = free[a] | free[b]
        apart = np.bitwise_count((low[a] ^ low[b]) & ~loose)
        whole = apart + np.bitwise_count(loose) <= distance
        for x, y in zip(a[whole], b[whole], strict=True):
            members = np.r_[first[x] : first[x + 1], first[y] : first[y + 1]]
            merged(labels, members[:-1], members[1:])
        open_ = (apart <= distance) & ~whole
        a, b = a[open_], b[open_]
        fan, size = (LEAF, n) if level == 0 else (FAN, levels[level - 1][3])
        x = (a[:, None, None] * fan + np.arange(fan)[None, :, None]) + np.zeros((1, 1, fan), np.int64)
        y = (b[:, None, None] * fan + np.arange(fan)[None, None, :]) + np.zeros((1, fan, 1), np.int64)
        # a node meets itself in each upper one; a pair of members is met once
        real = (x < size) & (y < size) & ((x <= y) if level else (x < y))
        if len(a):
            todo.append((level - 1, x[real], y[real]))
    return labels


def forest(rows: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Edges that span the components below each upper node; rows come sorted by node and Gray rank."""

    def of(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(cuts)
        a, b = [], []
        for at, size in zip(cuts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            if size == 2:
                if (int(fp[at]) ^ int(fp[at + 1])).bit_count() <= distance:
                    a.append(rep[at : at + 1])
                    b.append(rep[at + 1 : at + 2])
                continue
            labels = linked(fp[at : at + size], distance)
            far = np.flatnonzero(labels != np.arange(size))
            a.append(rep[at + far])
            b.append(rep[at + labels[far]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"u": join(a), "v": join(b)})

    held: list[tuple[np.ndarray, ...]] = []
    for batch in rows:
        if not len(batch):
            continue
        key, fp, rep = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["rep"].to_numpy()
        whole = int(np.searchsorted(key, key[-1])) if (key[:-1] <= key[1:]).all() else 0
        if held and key[0] != held[-1][0][-1] or held and whole:
            held.append((key[:whole], fp[:whole], rep[:whole]))
            yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        elif whole:
            yield of(key[:whole], fp[:whole], rep[:whole])
        held.append((key[whole:], fp[whole:], rep[whole:]))
    if held:
        yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))


def meeting(keyed: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns of their join, in which no task gets the members of a large node whole: few large nodes
    are broadcast, more are copied to SPREAD places each, over which their members are dealt."""
    if large.count() <= MOST_LARGE:
        return keyed, F.broadcast(large), ["key"]
    salt = F.pmod(F.xxhash64("rep"), F.lit(SPREAD)).cast("int")
    return keyed.withColumn("salt", salt), large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["key", "salt"]


def dealt(fps: DataFrame, distance: int, hot: int) -> DataFrame:
    """(key, fp, rep): the fingerprints below each node of the index's top, none of which has over ``hot`` members.

    Levels end by themselves: each fixes a third of the free bits, and with so few that they tell less than ``hot``
    members apart no node is too large (50,000: four levels at most). A level costs 15 copies of the members of the
    nodes that it splits; of copies that are edited here and there, most nodes hold few.
    """
    keyed, done, level = fps.select("fp", "rep", F.explode(nodes(F.lit(0), F.col("fp"), 0, distance)).alias("key")), [], 0
    while True:
        large = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"), "large")  # a row for ``hot`` members
        if large.isEmpty():
            released(fps.sparkSession, large)
            return reduce(DataFrame.unionByName, [*done, keyed])
        level += 1
        keyed, large, on = meeting(keyed, large)
        done.append(keyed.join(large, on, "left_anti").select("key", "fp", "rep"))
        below = keyed.join(large, on, "left_semi").select("fp", "rep", F.explode(nodes(F.col("key"), F.col("fp"), level, distance)).alias("key"))
        keyed = written(below, "lower")


def simhash_links(fps: DataFrame, distance: int = 4, hot: int = 50_000) -> DataFrame:
    """(u, v) spanning edges between representatives of (fp, rep) rows that have distinct fingerprints.

    An upper node with more than ``hot`` members is split into lower ones, so that no task gets it whole.
    """
    sorted_ = dealt(fps, distance, hot).repartition("key").sortWithinPartitions(F.col("key"), gray_rank(F.col("fp")))
    return sorted_.select("key", "fp", "rep").mapInPandas(lambda rows: forest(rows, distance), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``.

    Defined cases: null and empty texts have fingerprint zero, which links like any other; texts shorter than a
    shingle are one shingle; a row with a null id gets the component of its fingerprint, null if no other row has
    it; repeated rows stay repeated; an empty table gives an empty table; other columns play no part.
    """
    made = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = written(made.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    roots = components(simhash_links(groups, distance), "u", "v")
    named = groups.join(roots, groups["rep"] == roots["node"], "left").select(F.col("fp"), F.coalesce("root", "rep").alias("component_id"))
    return made.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest (and rows without an id); repeated rows: all."""
    gone = near_duplicates(docs, id_col, text_col, **how).filter("component_id <> doc_id").select(F.col("doc_id").alias("_lexmill_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_lexmill_gone"], "left_anti")
