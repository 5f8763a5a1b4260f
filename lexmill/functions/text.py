"""Column functions on words and phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column, sep: str = " +") -> Column:
    """Split at ``sep`` (a pattern) without trailing empty fields, as the JVM's own split does."""
    return F.split(F.regexp_replace(text, f"(?:{sep})+$", ""), sep)


def tokens(text: Column) -> Column:
    """Number of words between whitespace runs."""
    return F.size(words(text, "\\s+"))


def links(align: Column) -> Column:
    """``i-j`` pairs as an array of (l, r)."""
    return F.transform(F.split(F.trim(align), " +"), lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("int").alias("l"), F.split_part(x, F.lit("-"), F.lit(2)).cast("int").alias("r")))


#: Cells of one diagonal of all pairs that are filled at once, and times that the longest of them may exceed the shortest.
CELLS, UNEVEN = 1 << 18, 1.25


def numbered(a: pa.ListArray, b: pa.ListArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both sides' words as numbers, the same for the same word, last word first; nulls equal nothing."""
    sides = []
    for side, nothing in ((a, -1), (b, -2)):
        sizes = np.asarray(side.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        sides.append((side.flatten(), np.cumsum(sizes) - sizes, sizes, nothing))
    words = pa.chunked_array([sides[0][0], sides[1][0]]).dictionary_encode()
    codes = [chunk.indices.fill_null(nothing).to_numpy(zero_copy_only=False) for chunk, (*_, nothing) in zip(words.unify_dictionaries().chunks, sides, strict=True)] if words.num_chunks == 2 else [np.zeros(0, np.int32)] * 2
    out = [[code[at : at + n][::-1] for at, n in zip(starts.tolist(), sizes.tolist(), strict=True)] for code, (_, starts, sizes, _) in zip(codes, sides, strict=True)]
    return out[0], out[1]


def filled(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The last cells of the tables of some pairs, the first of each pair not the longer one.

    A row of ``last`` is a place in the first text and a column a pair, so that a diagonal is a few whole rows. Cells
    beyond a pair's end are filled too and never read by those before it.
    """
    m, n = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    high, wide, pairs = int(m.max()), int(n.max()), len(one)
    a, b = np.full((high, pairs), -1, np.int32), np.full((wide, pairs), -2, np.int32)
    for k, (x, y) in enumerate(zip(one, two, strict=True)):
        a[: len(x), k] = x
        b[wide - len(y) :, k] = y[::-1]  # turned round: the partners of neighbouring rows of a diagonal are neighbours
    out, ends = np.zeros(pairs, np.int32), m + n
    before, last, now = (np.zeros((high + 1, pairs), np.int32) for _ in range(3))
    by_end = np.argsort(ends, kind="stable")
    done = int(np.searchsorted(ends[by_end], 0, "right"))  # two empty texts: 0
    for k in range(1, int(ends.max()) + 1):
        low, top = max(1, k - wide), min(high, k - 1)
        if low <= top:
            cells = now[low : top + 1]
            np.minimum(before[low - 1 : top], last[low - 1 : top], out=cells)
            np.minimum(cells, last[low : top + 1], out=cells)
            cells += a[low - 1 : top] != b[wide - k + low : wide - k + top + 1]
        if k <= wide:
            now[0] = k
        if k <= high:
            now[k] = k
        while done < pairs and ends[by_end[done]] == k:
            out[by_end[done]] = now[m[by_end[done]], by_end[done]]
            done += 1
        before, last, now = last, now, before
    return out


def edit_scores(a: pa.ListArray, b: pa.ListArray) -> pa.Array:
    """Scores of a batch: pairs in order of their lengths, as many at once as CELLS allows, or one."""
    one, two = numbered(a, b)
    one, two = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(one, two, strict=True)], strict=True) if len(a) else ((), ())
    order = sorted(range(len(one)), key=lambda k: (len(one[k]) + len(two[k]), len(one[k])))
    scores = np.zeros(len(one), np.int32)
    begun = 0
    for at in range(1, len(order) + 1):
        if at < len(order):
            size, least = len(one[order[at]]) + len(two[order[at]]), len(one[order[begun]]) + len(two[order[begun]])
            if (at + 1 - begun) * (size + 2) <= 2 * CELLS and size <= UNEVEN * least + 8:
                continue
        block = order[begun:at]
        scores[block] = filled([one[k] for k in block], [two[k] for k in block])
        begun = at
    missing = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return pa.array(scores, mask=missing)


def edit_score(a: Column, b: Column) -> Column:
    """Edit score of two token arrays whose mismatch cost falls on every move; null where an array is.

    From the ends of both arrays backwards, a cell is the least of its three neighbours plus one if the two tokens
    differ; where the tokens agree, inserting and deleting are free. It never exceeds the Levenshtein distance.

    Tables are filled by diagonals for many pairs at once, in Arrow batches, of which two diagonals are held; so whole
    texts are compared, and the work is that of the tables' cells.
    """

    @F.arrow_udf("int")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            yield edit_scores(one, two)

    return score(a, b)


#: The word that a part came from: without lower-case letters, without upper-case ones, or with an upper-case first
#: letter; and a part cut at its first letter (fixed values, as patterns).
ALL_UPPER, ALL_LOWER, CAPITAL = "\\A[\\p{Lu}[^\\p{L}]]+\\z", "\\A[\\p{Ll}[^\\p{L}]]+\\z", "\\A[^\\p{L}]*\\p{Lu}.*\\z"
FIRST_LETTER = "(?s)^([^\\p{L}]*)(\\p{L})(.*)$"


def recase(part: Column, original: Column) -> Column:
    """A part in the case of the word that it came from: all upper, all lower, or its first letter raised; else unchanged."""
    cut = lambda i: F.regexp_extract(part, FIRST_LETTER, i)
    title = F.when(part.rlike("\\p{L}"), F.concat(cut(1), F.upper(cut(2)), cut(3))).otherwise(part)
    return F.when(original.rlike(ALL_UPPER), F.upper(part)).when(original.rlike(ALL_LOWER), F.lower(part)).when(original.rlike(CAPITAL), title).otherwise(part)


def highlight(hypothesis: Column, reference: Column, mark: str = "*", lower: bool = False) -> Column:
    """The hypothesis' words, those that the reference has (``lower``: in any case) between marks."""
    key = F.lower if lower else lambda x: x
    known = F.transform(reference, key)
    return F.array_join(F.transform(hypothesis, lambda w: F.when(F.array_contains(known, key(w)), F.concat(F.lit(mark), w, F.lit(mark))).otherwise(w)), " ")
