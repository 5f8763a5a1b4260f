"""Alignment of two tokenizers over a corpus: which tokens of one end where tokens of the other do, and how often.

Both encoders part a text at a space between two other characters: the byte-level one by its pattern, the other one since
none of its pieces has a space after another character (checked when it is loaded; else a text is one word). So texts are
taken in blocks, within Arrow batches, and each block's different words are encoded once. Tokens are those of whole texts,
as the tests say.

A block's words laid end to end are two interval tables (place, id, end) for DuckDB, one connection a task: tokens that
end together are joined, a window over the joined ends says how many tokens came before each group, and an ASOF join gives
every token its group, and so its place in the text that is hashed. Another ASOF join gives groups their words, and joins
with the documents' words the documents' sums and pairs, all in Arrow. Blocks keep their different pairs once and each
document's share of them as places in that list; Spark adds the blocks' counts, finds the highest of each second id, and
sends each block the counts of its own pairs. So pairs are shuffled once a block and not once a document, and no task
holds more than a block's.

Defined cases: null and empty texts, and texts that either encoder does not give back byte by byte, have no tokens: zeros
and an empty hash column. Rows that repeat an id, or have none, are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import removed_tables, written

#: Characters, different words and rows that close a block.
BLOCK, MOST_WORDS, MOST_ROWS = 2 << 20, 60_000, 20_000
#: A space between two other characters, and what tells that a text has other white space beside a space or at an end.
SPACE, ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s|\A\s|\s\Z")
FOUND = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<long>, a array<int>, b array<int>"
ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: From a, b (place n from 0, id, stop: bytes up to the token's end), words (w, start, n_a, n_b), uses (doc, w): the groups,
#: the tokens' places, the block's pairs, how often words hold them, and the sums and pairs of each document.
GROUPS = "create or replace temp table groups as select *, coalesce(lag(bn) over (order by stop), -1) + 1 as before from (select a.stop, a.n as an, b.n as bn, a.id as a, b.id as b from a join b using (stop))"
PLACES = """select a.n + g.before as place, a.id, a.stop = g.stop as last, false as other from a asof join groups g on a.stop <= g.stop
union all select b.n + g.an + 1, b.id, b.stop = g.stop, true from b asof join groups g on b.stop <= g.stop"""
HOLDS = "create or replace temp table holds as select w, a, b, count(*) as n from groups asof join words on groups.stop > words.start group by all"
PAIRS = "create or replace temp table pairs as select a, b, (row_number() over (order by a, b) - 1)::int as place from (select distinct a, b from holds)"
TIMES = "create or replace temp table times as select doc, w, count(*) as n from uses group by all"
SUMS = "select doc, sum(t.n * n_a)::bigint as n_a, sum(t.n * n_b)::bigint as n_b from times t join words using (w) group by doc"
SHARES = """select doc, sum(n)::bigint as n_links, list(place) as places, list(n) as times from
(select doc, place, sum(t.n * h.n)::bigint as n from times t join holds h using (w) join pairs using (a, b) group by all) group by doc"""
TOTALS = "select list(n order by place) as times, list(a order by place) as a, list(b order by place) as b from (select a, b, place, sum(t.n * h.n)::bigint as n from times t join holds h using (w) join pairs using (a, b) group by all)"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Encoders:
    """Both encoders with the bytes of their tokens."""

    one: tiktoken.Encoding
    two: sentencepiece.SentencePieceProcessor
    bytes_one: list[bytes]
    bytes_two: list[bytes]
    parts: bool  #: no piece has a space after another character
    lengths: tuple[np.ndarray, np.ndarray] = field(init=False)
    texts: list[str] = field(init=False)  #: an id with what follows it, for all places of either encoder

    def __post_init__(self) -> None:
        self.lengths = tuple(np.array([len(x) for x in side], np.int32) for side in (self.bytes_one, self.bytes_two))
        self.texts = [f"{i}{end}" for side, close in ((self.bytes_one, "|"), (self.bytes_two, ";")) for end in (",", close) for i in range(len(side))]

    def words(self, text: str) -> list[str]:
        """The parts of a text that are encoded apart."""
        if not self.parts:
            return [text]
        return SPACE.split(text) if ODD.search(text) else text.split(" ")

    def encoded(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Both lists of ids of each text, or None where one of them does not give the text's bytes back."""
        for text, two in zip(texts, self.two.encode(texts, num_threads=1), strict=True):
            one, data = self.one.encode_ordinary(f" {text}"), f" {text}".encode()
            same = b"".join([self.bytes_one[i] for i in one]) == data == b"".join([self.bytes_two[i] for i in two])
            yield (one, two) if same else None


@lru_cache(maxsize=2)
def encoders(byte_level: str, pieces: str) -> Encoders:
    """Encoders of a byte-level vocabulary (JSON, ids in the order of merges) and of a piece model."""
    with open(byte_level, encoding="utf-8") as file:
        vocabulary = json.load(file)
    special, of = {x["content"] for x in vocabulary["added_tokens"]}, byte_characters()
    ranks = {bytes(of[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
    table = [b""] * (max(ranks.values()) + 1)
    for data, i in ranks.items():
        table[i] = data
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Encoders(
        tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), model, table,
        [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)],
        not any(re.search("[^▁]▁", name) for name in names),
    )


def interval_table(ids: list[list[int]], lengths: np.ndarray) -> pa.Table:
    flat = np.fromiter(chain.from_iterable(ids), np.int32)
    return pa.table({"n": np.arange(len(flat), dtype=np.int32), "id": flat, "stop": np.cumsum(lengths[flat], dtype=np.int64)})


@dataclass
class Block:
    """Documents as numbers of words."""

    number: int
    index: dict[str, int] = field(default_factory=dict)
    ids: list[int | None] = field(default_factory=list)
    uses: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, i: int | None, text: str | None, two: Encoders) -> None:
        numbers = [np.zeros(0, np.int32)]
        for part in parts_of(text, two) if text else ():
            numbers.append(np.array([self.index.setdefault(w, len(self.index)) for w in two.words(part)], np.int32))
        self.ids.append(i)
        self.uses.append(np.concatenate(numbers))
        self.size += len(text or "")

    def full(self) -> bool:
        return self.size >= BLOCK or len(self.index) >= MOST_WORDS or len(self.ids) >= MOST_ROWS

    def closed(self, two: Encoders, db: duckdb.DuckDBPyConnection) -> pa.Table:
        """A row with the block's pairs, and one for each document."""
        found = list(two.encoded(list(self.index)))
        bad = np.array([x is None for x in found], bool)
        good = [bool(len(u)) and not bad[u].any() for u in self.uses]
        empty = {"block": self.number, "doc_id": None, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "places": [], "times": [], "a": None, "b": None}
        rows = [empty | {"doc_id": i} for i in self.ids]
        pairs = empty | {"a": [], "b": []}
        if any(good):
            strings = self.prepared([x or ([], []) for x in found], good, two, db)
            for doc, n_a, n_b in db.sql(SUMS).fetchall():
                rows[doc] |= {"n_a": n_a, "n_b": n_b}
            for doc, n, places, times in db.sql(SHARES).fetchall():
                rows[doc] |= {"n_groups": n, "n_links": n, "places": places, "times": times}
            for k, u in enumerate(self.uses):
                if good[k]:
                    rows[k]["groups_sha256"] = digest(u, strings)
            pairs |= dict(zip(("times", "a", "b"), db.sql(TOTALS).fetchall()[0], strict=True))
        return pa.Table.from_pylist([pairs, *rows], ARROW)

    def prepared(self, found: list[tuple[list[int], list[int]]], good: list[bool], two: Encoders, db: duckdb.DuckDBPyConnection) -> list[str]:
        """Fills DuckDB's tables; the text of the groups of each word."""
        a, b = (interval_table([f[side] for f in found], lengths) for side, lengths in enumerate(two.lengths))
        sizes = [np.array([len(f[side]) for f in found], np.int64) for side in (0, 1)]
        ends = np.r_[0, a["stop"].to_numpy()][np.cumsum(sizes[0])]
        uses = [u for u, fine in zip(self.uses, good, strict=True) if fine]
        tables = {
            "a": a, "b": b,
            "words": pa.table({"w": np.arange(len(found), dtype=np.int32), "start": np.r_[0, ends[:-1]], "n_a": sizes[0], "n_b": sizes[1]}).filter(sizes[0] > 0),
            "uses": pa.table({"doc": np.repeat(np.flatnonzero(good).astype(np.int32), [len(u) for u in uses]), "w": np.concatenate(uses)}),
        }
        for name, table in tables.items():
            db.register(name, table)
        for step in (GROUPS, HOLDS, PAIRS, TIMES):
            db.execute(step)
        places = db.sql(PLACES).to_arrow_table()
        code, n = np.empty(len(a) + len(b), np.int32), [len(x) for x in (two.bytes_one, two.bytes_two)]
        other = places["other"].to_numpy()
        code[places["place"].to_numpy()] = places["id"].to_numpy() + other * 2 * n[0] + places["last"].to_numpy() * np.where(other, n[1], n[0])
        shown, cuts = [two.texts[c] for c in code.tolist()], np.r_[0, np.cumsum(sizes[0] + sizes[1])].tolist()
        return ["".join(shown[i:j])[:-1] for i, j in zip(cuts, cuts[1:], strict=False)]


def digest(uses: np.ndarray, strings: list[str]) -> str:
    """Hash of a text's groups, so many words at a time."""
    out = hashlib.sha256()
    for at in range(0, len(uses), 1 << 20):
        out.update((";" * (at > 0) + ";".join([strings[w] for w in uses[at : at + (1 << 20)].tolist()])).encode())
    return out.hexdigest()


def parts_of(text: str, two: Encoders) -> Iterator[str]:
    """A text in parts of BLOCK characters or more, as far as it has places where it may be parted."""
    begun = 0
    while two.parts and len(text) - begun > BLOCK and (place := SPACE.search(text, begun + BLOCK)):
        yield text[begun : place.start()]
        begun = place.end()
    yield text[begun:]


def found(docs: DataFrame, byte_level: str, pieces: str, id_col: str, text_col: str) -> DataFrame:
    """For each block a row with its different pairs (``a``, ``b``, ``times``), and one for each of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, number = encoders(byte_level, pieces), TaskContext.get().partitionId() << 32
        db = duckdb.connect(config={"threads": 1, "temp_directory": "", "python_enable_replacements": False})
        block = Block(number)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(i, text.as_py(), two)
                if block.full():
                    yield from block.closed(two, db).to_batches()
                    block = Block(block.number + 1)
        if block.ids:
            yield from block.closed(two, db).to_batches()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold each pair of ids."""
    each = blocks.filter("a is not null").select(F.explode(F.arrays_zip("a", "b", "times")).alias("p"))
    return each.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("p.times").alias("n"))


def alignments(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: tokens, groups, links, how many links hold a pair that no pair of the same second id exceeds
    in the corpus, the sum of the links' counts, and a hash of the groups (``a1,a2|b1;a3|b2,b3``)."""
    blocks = written(found(docs, byte_level, pieces, id_col, text_col), "aligned")
    counts = written(pair_counts(blocks), "pair-counts")
    best = counts.groupBy(F.col("b").alias("_b")).agg(F.max("n").alias("_most"))
    marked = counts.join(best, F.col("b") == F.col("_b")).select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))
    asked = blocks.filter("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("block", "place", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    told = asked.join(marked, ["a", "b"]).select("block", "place", "n", "best")
    rows = blocks.filter("a is null").drop("a", "b")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, is_best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        place = right["place"].to_numpy()
        n[place], is_best[place] = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        own = left["places"].combine_chunks()
        size = np.asarray(own.value_lengths())
        at = own.flatten().to_numpy()
        times = left["times"].combine_chunks().flatten().to_numpy()
        sums = [np.r_[0, np.cumsum(x[at] * times)] if len(at) else np.zeros(1, np.int64) for x in (is_best, n)]
        ends = np.cumsum(size)
        cut = [s[ends] - s[ends - size] for s in sums]
        kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(cut[0], pa.int64())).append_column("count_sum", pa.array(cut[1], pa.int64())).append_column("groups_sha256", left["groups_sha256"])

    # columns of their own, as both sides come from one table
    told, rows = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (told, rows))
    out = written(rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, RESULT), "alignments")
    removed_tables(blocks, counts)
    return out
