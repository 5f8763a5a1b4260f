"""Best-fit packing of tokenised documents.

Planning needs only how many pieces there are of each length, at most ``capacity`` numbers, whatever the corpus
size. The plan is made on that histogram by exact-complement hashing: single lengths and the sums of pairs, and with
them those of triples, are indexed under the counts that remain; a gap's exact filling is looked up there and taken
for whole batches of equal bins at a time. What finds no exact filling goes through best fit, again over counts. The
plan is a bounded table of runs; pieces get their place in it by rank within their length, computed in salted parts.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import slices, written

#: Texts of these characters alone take the remembered path; there, one lower-casing and splitting at blanks is what
#: the file's normaliser and splitter do. All others go through the library as they are.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
#: The file's splitting pattern for such characters: contractions, letters, a digit, other signs.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\w\\s]|_)+")
#: A comma or stop that ends a chunk but may be part of a run of signs; elsewhere it is a word of its own.
RUN = re.compile(r"(?:[^\w\s]|_)[,.]\s")
REMEMBERED = 1_000_000


class Remembered(dict):
    """Values made on first use; cleared by ``bounded`` once there are too many."""

    def __init__(self, make: Callable[[str], bytes], most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) < 64:
            self[key] = value
        return value

    def bounded(self) -> Callable[[str], bytes]:
        if len(self) > self.most:
            self.clear()
        return self.__getitem__


class WordTokenizer:
    """Ids of the tokenizer file as the library gives them, by remembered words where that is safe."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._model = self.library.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self._signs = str.maketrans({chr(b): c for b, c in signs.items()})
        self._words, self._chunks = Remembered(self._word), Remembered(self._chunk)

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._signs))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        words = WORDS.findall(chunk)
        return self._word(chunk) if words == [chunk] else b"".join(map(self._words.bounded(), words))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens."""
        if not PLAIN.fullmatch(text) or "<|" in text:
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if not RUN.search(text):  # fewer different chunks to remember
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return b"".join(map(self._chunks.bounded(), text.lower().split()))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of a document and ``end_id``, cut only beyond ``capacity``.

    Defined cases: a null or empty text is one piece holding ``end_id`` alone; repeated rows each give their pieces;
    a null id stays null; an empty table gives an empty table; other columns play no part.
    """

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = tokenizer(path).encode, np.array([end_id], "<u4").tobytes()
        for batch in slices(rows):
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (None if pd.isna(doc) else int(doc), k, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype("i8")) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, schema)


class Sums:
    """An index of what remains: how many pairs of lengths have each sum, kept up as lengths run out.

    A single length is its own sum, and a triple's sum is a length and a pair's, so both are looked up in it too.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.have = np.zeros(capacity + 1, np.int64)
        for n, c in histogram.items():
            self.have[n] = max(c, 0)
        self.left = self.have > 0
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        for n in np.flatnonzero(self.left):
            self.pairs[n : n + capacity + 1][self.left & (np.arange(capacity + 1) >= n)] += 1
        for n in np.flatnonzero(self.have == 1):
            self.pairs[2 * n] -= 1

    def take(self, n: int, count: int) -> None:
        """Removes ``count`` of a length, and the pairs that there are no more."""
        was, now = self.have[n], self.have[n] - count
        self.have[n] = now
        if was > 1 >= now:
            self.pairs[2 * n] -= 1
        if not now:
            self.left[n] = False
            self.pairs[n : n + len(self.left)][self.left] -= 1

    def enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.have[n] >= k for n, k in Counter(lengths).items())

    def pair(self, gap: int, with_: tuple[int, ...]) -> tuple[int, ...]:
        """Two lengths that fill a gap, the larger first and as large as can be; none if there are none."""
        if gap < 2 or not self.pairs[gap]:
            return ()
        top = min(gap - 1, len(self.left) - 1)
        ones = np.arange(top, (gap + 1) // 2 - 1, -1)
        for n in ones[self.left[ones] & self.left[gap - ones]].tolist():
            if self.enough((*with_, n, gap - n)):
                return n, gap - n
        return ()

    def exact(self, gap: int, with_: tuple[int, ...], most: int = 3) -> tuple[int, ...]:
        """One, two or three lengths that fill a gap exactly, beside those of ``with_``; fewest and largest first."""
        if gap < len(self.left) and self.left[gap] and self.enough((*with_, gap)):
            return (gap,)
        if most > 1 and (found := self.pair(gap, with_)):
            return found
        if most > 2 and gap > 2:
            ones = np.arange(min(gap - 2, len(self.left) - 1), (gap + 2) // 3 - 1, -1)
            for n in ones[self.left[ones] & (self.pairs[gap - ones] > 0)].tolist():
                if self.enough((*with_, n)) and (found := self.pair(gap - n, (*with_, n))) and found[0] <= n:
                    return n, *found
        return ()


def plans(histogram: dict[int, int], capacity: int = 2048) -> dict[str, list[tuple[tuple[int, ...], int]]]:
    """Plans by their names, exact fillings first: by triples, pairs and singles, of all lengths or of bins in turn."""
    ways = {f"complements of {most}": complements(histogram, capacity, most) for most in (3, 2, 1)}
    ways |= {f"filled by {most}": filled(histogram, capacity, most) for most in (3, 2, 1)}
    return ways | {"best fit": best_fit(histogram, capacity)}


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins), using each length as often as the histogram has it.

    Exact fillings that are greedy may spend small lengths which best fit could use better, so the plan is made in
    several ways on the same few numbers, and the one with the fewest bins counts; of equal ones the first of ``plans``,
    so that best fit alone is only taken where it needs fewer bins than every way of exact fillings.
    """
    return min(plans(histogram, capacity).values(), key=lambda bins: sum(times for _, times in bins))


def _most(sums: Sums, lengths: tuple[int, ...]) -> int:
    return int(min(sums.have[n] // k for n, k in Counter(lengths).items()))


def _spend(sums: Sums, bins: Counter, lengths: tuple[int, ...], times: int) -> None:
    bins[lengths] += times
    for n, k in Counter(lengths).items():
        sums.take(n, k * times)


def _together(bins: Counter, sums: Sums, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The bins made so far, and best fit of what remains."""
    for lengths, times in best_fit({int(n): int(sums.have[n]) for n in np.flatnonzero(sums.left)}, capacity):
        bins[lengths] += times
    return list(bins.items())


def complements(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """First all lengths with an exact single complement, then with a pair, then with a triple; the rest by best fit."""
    sums, bins = Sums(histogram, capacity), Counter()
    if sums.left[capacity]:
        _spend(sums, bins, (capacity,), int(sums.have[capacity]))
    for size in range(1, most + 1):
        for big in np.flatnonzero(sums.left)[::-1].tolist():
            while sums.left[big] and (found := sums.exact(capacity - big, (big,), size)):
                _spend(sums, bins, (big, *found), _most(sums, (big, *found)))
    return _together(bins, sums, capacity)


def filled(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin after bin, from the largest length left: an exact filling of its gap if there is one, else the largest
    length that fits, and so on; equal bins at once, as long as the counts last."""
    sums, bins = Sums(histogram, capacity), Counter()
    while sums.left.any():
        lengths: tuple[int, ...] = (int(np.flatnonzero(sums.left)[-1]),)
        gap = capacity - lengths[0]
        while gap:
            if found := sums.exact(gap, lengths, most):
                lengths += found
                break
            held = Counter(lengths)
            fits = next((n for n in np.flatnonzero(sums.left[: gap + 1])[::-1].tolist() if sums.have[n] > held[n]), 0)
            if not fits:
                break
            lengths, gap = (*lengths, fits), gap - fits
        _spend(sums, bins, lengths, _most(sums, lengths))
    return list(bins.items())


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of decreasing lengths over counts: each into the open bin with the least room that takes it."""
    bins: Counter[tuple[int, ...]] = Counter()
    gaps: dict[int, list[list]] = {}  # free space -> open bins of it, as [lengths, count]
    order: list[int] = []  # the free spaces, ascending
    for n in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left = histogram[n]
        while left:
            i = bisect.bisect_left(order, n)
            if i == len(order):
                fit = capacity // n
                full, rest = divmod(left, fit)
                opened = [((n,) * fit, full), ((n,) * rest, 1)] if rest else [((n,) * fit, full)]
                new = [(capacity - n * len(b), b, c) for b, c in opened if c]
                left = 0
            else:
                space = order[i]
                lengths, count = gaps[space].pop()
                if not gaps[space]:
                    del gaps[space], order[i]
                fit = min(space // n, left)
                times = min(count, left // fit)
                left -= fit * times
                new = [(space - fit * n, (*lengths, *(n,) * fit), times), (space, lengths, count - times)]
            for space, lengths, count in new:
                if count and space:
                    if space not in gaps:
                        bisect.insort(order, space)
                    gaps.setdefault(space, []).append([lengths, count])
                elif count:
                    bins[lengths] += count
    for held in gaps.values():
        for lengths, count in held:
            bins[lengths] += count
    return list(bins.items())


def packed(parts: DataFrame, capacity: int = 2048, salt: int = 64) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    ``parts`` must be a written table: it is read for the histogram and again for the ranks. A length that most
    pieces have (the full one) is ranked in ``salt`` parts by hash of the document; their sizes give the offsets.

    Defined cases: null ids rank first; rows alike in id, piece and checksum take their places in any order, as they are
    exchangeable; no pieces give no sequences; other columns stay.
    """
    spark = parts.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salt)).cast("int")
    salted = parts.withColumn("_part", part)
    counts = salted.groupBy("length", "_part").count()
    base = counts.select("length", "_part", (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    runs, first, used = [], 0, Counter()
    for lengths, times in plan(histogram, capacity):
        at = 0
        for n, same in Counter(lengths).items():  # the k-th piece of a run goes to bin k // same
            runs.append((n, used[n], used[n] + same * times, first, same, at))
            used[n] += same * times
            at += n * same
        first += times
    table = spark.createDataFrame(runs, "length long, _lo long, _hi long, _first long, _same long, _at long")
    starts = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_lo", "_first", "_same", "_at"))).alias("_runs"))
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(F.broadcast(base), ["length", "_part"])  # capacity x salt rows at most
        .withColumn("_rank", F.col("_rank") + F.col("_base"))
        .join(F.broadcast(starts), "length")  # capacity rows at most
    )
    run = F.element_at(F.filter("_runs", lambda r: r["_lo"] <= F.col("_rank")), -1)
    into = ranked.withColumn("_run", run).withColumn("_k", F.col("_rank") - F.col("_run._lo"))
    return into.select(
        *parts.columns,
        (F.col("_run._first") + F.expr("_k div _run._same")).alias("sequence_id"),
        (F.col("_run._at") + F.col("_k") % F.col("_run._same") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there; see ``pieces`` for the defined cases."""
    return packed(written(pieces(docs, path, id_col, text_col, capacity, with_ids=with_ids), "pieces"), capacity)
