"""Near copies by wide SimHash: one document of each group of similar word shingles stays.

Documents whose five-word shingles have a similarity of 0.8 differ in about a sixth of their fingerprint bits, too
many for blocks of one 64-bit word. Here a fingerprint has four words and the index's upper nodes are many masks of
``bits`` bits each, drawn over all four: a pair at a sixth of its bits shares a given mask's bits with probability
(5/6)^bits and one of the masks' with RECALL at least, a closer pair nearly surely. Both numbers follow from how many
different texts there are, so that an upper node holds about MEMBERS unrelated ones at any size: 14 bits and 44 masks
up to 260,000 texts, then a bit more for each doubling, which takes a fifth more masks (30 bits and 831 masks for 10^10). Below an upper node members stand in Gray
rank; runs of neighbours are factored into nodes of the bits that all their members share, and these into wider ones,
and pairs of nodes whose shared bits differ in over ``most`` places are pruned with all their members. A member's
candidates are those of smaller id that differ in at most ``most`` of the 256 bits. A pair is a link if its sets of shingles
are similar enough, counted in full; groups join through components. Rounds take the nearest candidate first, then
ever more of the next ones, without those in the member's own component by then, until no candidate is left: so every
candidate is verified or already joined, while a group of true copies gives few more pairs than it has members. A node of
more than ``hot`` members is dealt in parts at random for each mask, then by pairs of parts, without those whose
members are all of one component by then; so no pair is lost and no task gets a large node whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import released, slices, written
from lexmill.llm.components import components
from lexmill.llm.simhash import AT_ONCE, FAN, LEAF, SEED

WORDS = 4  # of 64 bits
#: Unrelated members of an upper node, bits of a mask at least, the share of pairs at a sixth of their bits that are found.
MEMBERS, LEAST_BITS, RECALL = 16, 14, 0.97
#: Pairs compared at once.
PAIRS = 1 << 19
#: By how much more candidates each round takes than the one before.
GROWTH = 4


def masks(texts: int) -> tuple[int, int]:
    """(bits, masks) for so many different texts."""
    bits = max(LEAST_BITS, ceil(log2(max(texts, 1) / MEMBERS)))
    return bits, ceil(log(1 - RECALL) / log(1 - (5 / 6) ** bits))


def hashes(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    ends = ends[words - 1 :] or ends[-1:]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)


def wide_fingerprint(text: str | None, words: int = 5) -> np.ndarray:
    """Four words of 64 bits: a bit is set if it is in over half of the different shingles' hashes, remixed by word."""
    return set_fingerprint(np.unique(hashes(text, words)))


def set_fingerprint(found: np.ndarray) -> np.ndarray:
    ones = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(found), AT_ONCE):
        x = found[at : at + AT_ONCE]
        for k in range(WORDS):
            ones[k] += np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
            x = x * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15)
            x = x ^ (x >> np.uint64(32))
            x = x * np.uint64(0xD1342543DE82EF95)
            x = x ^ (x >> np.uint64(29))
    return np.packbits(2 * ones > max(len(found), 1), axis=1).view(">u8").ravel().astype(np.uint64)


def parities(found: np.ndarray) -> np.ndarray:
    """Four words of 64 bits: whether each of 256 buckets holds an odd number of a set's hashes."""
    odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">u8").astype(np.uint64)


def keyed(batches: Iterator[pd.DataFrame], places: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row per fingerprint and mask, with the bits below the mask as a key."""
    tables, bits = places.shape
    for batch in slices(batches):
        words = np.stack([batch[f"f{k}"].to_numpy() for k in range(WORDS)], 1)
        set_ = np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(batch), -1), axis=1)
        key = (set_[:, places].astype(np.int64) << np.arange(bits)).sum(2) + (np.arange(tables) << bits)
        out = batch.loc[batch.index.repeat(tables)].reset_index(drop=True)
        out["key"] = key.ravel()
        yield out


def gray_order(words: np.ndarray) -> np.ndarray:
    """The order of the Gray ranks of patterns of several words, the first one the highest."""
    ranks, odd = [], np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        rank = words[:, k].copy()
        for by in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(by)
        rank ^= np.uint64(0) - odd  # an odd rank of the words before turns this one round
        odd = rank & np.uint64(1)
        ranks.append(rank)
    return np.lexsort(ranks[::-1])


def within(low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Which nodes, of bits set in all members and in any, may have members within ``most`` bits of each other's."""
    free = low ^ high
    loose = free[:, None] | free[None]
    return np.bitwise_count((low[:, None] ^ low[None]) & ~loose).sum(2, dtype=np.int16) <= most


def pruned(words: np.ndarray, most: int) -> np.ndarray:
    """For members in Gray order: which pairs of leaves, LEAF members each, are left when wider nodes and then the
    leaves themselves have been compared."""
    cuts = np.arange(0, len(words), LEAF)
    low, high = np.bitwise_and.reduceat(words, cuts), np.bitwise_or.reduceat(words, cuts)
    wide = np.arange(0, len(low), FAN)
    upper = within(np.bitwise_and.reduceat(low, wide), np.bitwise_or.reduceat(high, wide), most)
    above = np.arange(len(low)) // FAN
    left = upper[above[:, None], above[None]]
    for row in np.flatnonzero(upper.any(1)).tolist():
        mine = np.flatnonzero(above == row)
        others = np.flatnonzero(upper[row][above])
        free = (low ^ high)[mine][:, None] | (low ^ high)[others][None]
        apart = np.bitwise_count((low[mine][:, None] ^ low[others][None]) & ~free).sum(2, dtype=np.int16)
        left[np.ix_(mine, others)] = apart <= most
    return left


def node_candidates(rep: np.ndarray, words: np.ndarray, root: np.ndarray, side: np.ndarray, marks: np.ndarray | None, sizes: np.ndarray | None, least: float, most: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (u, v) of a node's members, sorted by id, and the members that have open candidates beyond them.

    A member's candidates are those of smaller id within ``most`` bits, nearest first; number ``lo`` to ``hi`` of
    them give pairs, if they are in another component, and in the node's other side where it has two (0 and 1, else
    -1), and if ``marks`` do not tell already that their sets are less similar. The third array is empty if nobody has more than ``hi``.
    """
    n, more, u, v = len(rep), False, [], []
    open_ = np.zeros(n, bool)
    gray = gray_order(words) if n > 4 * LEAF else np.arange(n)
    left = pruned(words[gray], most) if n > 4 * LEAF else None
    leaf = np.empty(n, np.int64)
    leaf[gray] = np.arange(n) // LEAF
    step = max(LEAF, PAIRS // n // LEAF * LEAF)
    for at in range(0, n, step):
        rows = gray[at : at + step]
        others = np.arange(n) if left is None else np.flatnonzero(left[at // LEAF : (at + step) // LEAF].any(0)[leaf])
        apart = np.bitwise_count(words[rows, None] ^ words[None, others]).sum(2, dtype=np.int16)
        apart[others[None, :] >= rows[:, None]] = 1000
        cross = (apart <= most) & (root[None, others] != root[rows, None]) & ((side[None, others] != side[rows, None]) | (side[rows, None] < 0))
        if marks is not None:
            i, j = np.nonzero(cross)
            # sets differ in as many elements at least as the parities of their buckets' counts do
            cross[i, j] = np.bitwise_count(marks[rows[i]] ^ marks[others[j]]).sum(1, dtype=np.int16) <= (sizes[rows[i]] + sizes[others[j]]) * (1 - least) / (1 + least) + 1e-6
        open_[others[cross.any(0)]] = True
        some = np.flatnonzero(cross.any(1))
        if not len(some):
            continue
        rows = rows[some]
        open_[rows] = True
        apart, cross = apart[some], cross[some]
        order = apart.argmin(1)[:, None] if hi == 1 else apart.argsort(1, kind="stable")
        one, two = np.nonzero(np.take_along_axis(cross, order[:, lo:hi], 1))
        more |= bool((cross.sum(1) > 1).any() if hi == 1 else np.take_along_axis(cross, order[:, hi:], 1).any())
        u.append(rep[rows[one]])
        v.append(rep[others[order[one, lo + two]]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(u), join(v), rep[open_] if more else rep[:0]


def candidates(batches: Iterator[pd.DataFrame], least: float, most: int, lo: int, hi: int) -> Iterator[pd.DataFrame]:
    """(u, v, key) per pair of ``node_candidates``, and (null, v, key) per open member; rows come sorted by key, id."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        key, rep, root, side = (rows[c].to_numpy() for c in ("key", "rep", "root", "side"))
        words, marks = (np.ascontiguousarray(rows[[f"{x}{k}" for k in range(WORDS)]].to_numpy()).view(np.uint64) if f"{x}0" in rows else None for x in "fp")
        size = None if marks is None else rows["size"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        out = [(np.zeros(0, np.int64),) * 3]
        sizes = np.diff(cuts)
        for lo_, n in zip(cuts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            mine = slice(lo_, lo_ + n)
            u, v, rest = node_candidates(rep[mine], words[mine], root[mine], side[mine], *(None if x is None else x[mine] for x in (marks, size)), least, most, lo, hi)
            out += [(u, v, np.full(len(u), key[lo_])), (np.full(len(rest), -1), rest, np.full(len(rest), key[lo_]))]
        u, v, k = (np.concatenate(x) for x in zip(*out, strict=True))
        pair = np.concatenate([np.full(len(x[0]), i % 2 == 1) for i, x in enumerate(out)])
        return pd.DataFrame({"u": pd.Series(u, dtype="Int64").where(pair), "v": v, "key": k})

    held: list[pd.DataFrame] = []  # of one node, which has few members
    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy()
        whole = int(np.searchsorted(key, key[-1]))
        if held and (whole or key[0] != held[-1]["key"].iloc[-1]):
            yield of(pd.concat([*held, batch.iloc[:whole]], ignore_index=True))
            held = []
        elif whole:
            yield of(batch.iloc[:whole])
        held.append(batch.iloc[whole:])
    if held:
        yield of(pd.concat(held, ignore_index=True))


def parts(keys: DataFrame, hot: int) -> DataFrame:
    """(key, n_parts) of the keys that over ``hot`` rows have: so many parts keep to about half of that each."""
    return keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key", F.ceil(2 * F.col("n") / hot).cast("int").alias("n_parts"))


def split(members: DataFrame, hot: int) -> DataFrame:
    """(rep, key, side) of smaller nodes that have every pair of different components of the large ones' (key, rep, root).

    A component's members are in parts of their own if it is large, or else in mixed ones; each two parts of a node
    are a smaller node with two sides, and each mixed part is one with itself. Two parts of the same component are
    left out, so the work grows with the members outside of the largest component, not with the square of that.
    """
    counted = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = counted.groupBy("key").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("n") <= hot // 4, F.col("n")).otherwise(0)).alias("rest")).filter("roots > 1").select("key", "rest")
    large = counted.filter(F.col("n") > hot // 4).select("key", "root", F.ceil(2 * F.col("n") / hot).alias("own"))
    of = members.join(several, "key").join(large, ["key", "root"], "left")
    of = of.withColumn("one", F.when(F.col("own").isNotNull(), F.col("root"))).withColumn("part", F.pmod(F.xxhash64("rep", "key"), F.coalesce("own", F.greatest(F.ceil(2 * F.col("rest") / hot), F.lit(1)))))
    of = written(of.select("key", "rep", "one", "part"), "parts")
    chosen = of.select("key", "one", "part").distinct()
    other = chosen.toDF("key", "one2", "part2")
    first = F.struct(F.coalesce("one", F.lit(-1)).alias("o"), F.col("one").isNull().alias("m"), F.col("part").alias("p"))
    second = F.struct(F.coalesce("one2", F.lit(-1)).alias("o"), F.col("one2").isNull().alias("m"), F.col("part2").alias("p"))
    both = chosen.join(other, "key").filter((first <= second) & (F.col("one").isNull() | F.col("one2").isNull() | (F.col("one") != F.col("one2"))))
    self_ = first == second
    node = F.xxhash64("key", first, second)
    ends = F.explode(F.when(self_, F.array(F.struct("one", "part", F.lit(-1).alias("side")))).otherwise(F.array(F.struct("one", "part", F.lit(0).alias("side")), F.struct(F.col("one2").alias("one"), F.col("part2").alias("part"), F.lit(1).alias("side")))))
    dealt = both.select("key", node.alias("node"), ends.alias("e")).select("key", "node", "e.*").toDF("key_", "node", "one_", "part_", "side")
    met = (of["key"] == dealt["key_"]) & of["one"].eqNullSafe(dealt["one_"]) & (of["part"] == dealt["part_"])
    return of.join(dealt, met).select("rep", F.col("node").alias("key"), "side")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, most: int = 60, tables: int | None = None, bits: int | None = None, seed: int = 1, hot: int = 4096) -> DataFrame:
    """(doc_id, component_id) of the rows that have an id and a link to a smaller one. ``bits`` and ``tables``, the masks,
    follow from the number of texts where they are not given.

    Defined cases: equal sets of shingles (also the empty ones of texts without words) are one group, equal
    fingerprints of other sets are pairs like any others; texts shorter than a shingle are one shingle; rows with a null id take no part; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    names = [f"f{k}" for k in range(WORDS)]
    same = [*names, "whole"]  # and a hash of the set itself
    of_set = [f"p{k}" for k in range(WORDS)] + ["size"]

    @F.pandas_udf(", ".join(f"{n} long" for n in same + of_set))
    def wide(texts: pd.Series) -> pd.DataFrame:
        sets = (np.unique(hashes(t, words)) for t in texts)
        made = np.array([[*set_fingerprint(x), xxhash.xxh64_intdigest(x.tobytes(), SEED), *parities(x), len(x)] for x in sets], np.uint64).reshape(-1, len(same + of_set))
        return pd.DataFrame(made.view(np.int64), columns=same + of_set)

    made = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), wide(F.col(text_col)).alias("f")).select("doc_id", "f.*")
    made = written(made, "wide")
    groups = written(made.groupBy(*same).agg(F.min("doc_id").alias("rep"), *[F.min(n).alias(n) for n in of_set]), "wide-groups")
    derived = masks(groups.count())
    bits, tables = bits or derived[0], tables or derived[1]
    places = np.array([np.random.default_rng(seed + t).choice(64 * WORDS, bits, replace=False) for t in range(tables)])
    types = ", ".join(f"{n} long" for n in names)
    dealt = groups.select(*names, "rep").mapInPandas(lambda b: keyed(b, places), f"{types}, rep long, key long")
    large = written(parts(dealt.select("key"), hot), "large")
    split_ = not large.isEmpty()
    if split_:  # a large node's parts first, at random for each mask; what is between them follows with the components
        dealt = dealt.join(F.broadcast(large), "key", "left").withColumn("part", F.when(F.col("n_parts").isNotNull(), F.pmod(F.xxhash64("rep", "key"), F.col("n_parts"))))
        whole = written(dealt.filter("part is not null").select("key", "rep"), "whole")
        dealt = dealt.withColumn("key", F.when(F.col("part").isNull(), F.col("key")).otherwise(-1 - F.xxhash64("key", "part").bitwiseAND((1 << 62) - 1))).drop("n_parts", "part")
    dealt = dealt.withColumn("root", F.col("rep")).withColumn("side", F.lit(-1))
    lo, hi, grow, sets, tried, nodes, roots = 0, 1, GROWTH, None, None, None, None
    while True:
        sorted_ = dealt.repartition("key").sortWithinPartitions("key", "rep")
        found = written(sorted_.mapInPandas(lambda b, lo=lo, hi=hi: candidates(b, least, most, lo, hi), "u long, v long, key long"), "candidates")
        released(spark)
        pairs = found.filter("u is not null").select("u", "v").distinct()
        if sets is None:  # later rounds have pairs of these members only
            wanted = found.select("v").union(found.filter("u is not null").select("u")).distinct().toDF("doc_id")
            wanted = wanted.union(whole.select("rep").distinct()) if split_ else wanted
            sets = shingle_sets(docs, wanted.distinct(), id_col, text_col, words)
        else:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        links = similar(pairs, sets, least)
        roots = components(links if roots is None else links.union(roots), "u", "v")
        open_ = found.filter("u is null").select("key", F.col("v").alias("rep"))
        if nodes is not None:
            nodes = nodes.join(open_.select("key").distinct(), "key", "left_semi")
        else:
            # whoever is a candidate of nobody in a node is left out once; after that nodes stay whole, so that numbers do
            nodes = open_.filter("key >= 0").select("rep", "key", F.lit(-1).alias("side"))
            if split_:
                rooted = whole.join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
                nodes, hi = nodes.union(split(rooted, hot)), 0
        nodes = written(nodes, "open")
        if nodes.isEmpty():
            break
        lo, hi, grow = hi, hi + grow, GROWTH * grow
        dealt = nodes.join(groups, "rep").join(roots, F.col("rep") == F.col("node"), "left").select(*names, *of_set, "rep", "key", "side", F.coalesce("root", "rep").alias("root"))
    named = groups.join(roots, groups["rep"] == roots["node"], "left").select(*same, F.coalesce("root", "rep").alias("component_id"))
    return made.join(named, same).filter("component_id <> doc_id").select("doc_id", "component_id")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, s): the hashes of the sets of shingles of the rows whose ids ``wanted`` has."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    @F.pandas_udf("binary")
    def shingles(values: pd.Series) -> pd.Series:
        return pd.Series([np.unique(hashes(t, words)).tobytes() for t in values])

    # rows repeating an id: the pair stands for the least of their sets, as one of them
    sets = written(texts.join(wanted, "doc_id").select("doc_id", shingles("text").alias("s")).groupBy("doc_id").agg(F.min("s").alias("s")), "sets")
    released(docs.sparkSession)
    return sets


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of ``least`` or more."""

    @F.pandas_udf("double")
    def jaccard(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(one, two, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / max(len(a) + len(b) - both, 1) if len(a) or len(b) else 1.0)
        return pd.Series(out, dtype="float64")

    sides = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    return sides.filter(jaccard("a", "b") >= least).select("u", "v")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no smaller id is a near copy of; rows repeating an id stand or fall together."""
    gone = near_copies(docs, id_col, text_col).select(F.col("doc_id").alias("_lexmill_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_lexmill_gone"), "left_anti")
