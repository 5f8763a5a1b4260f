"""Divergence of the sources of a language: which sources differ most, and by which terms.

Terms are encoded by integers. Term counts are gathered in each task, dealt by ranges of (language, term) and sorted, so
that a task sees every count of a term. It keeps the terms that enough documents have, in sorted arrays of CHUNK terms;
the place in its array (by ``searchsorted``) and the array's own place are a term's id, and ids keep the order of UTF-8.
A group's counts in one array are a sparse row, counted over the ids (in integers, where ``bincount`` adds floats); the comparison of sources spreads the
rows of an array to dense vectors and sums over their pairs, by blocks of sources. No task holds a vocabulary, a
language or all sources: an array has at most CHUNK terms and closes early at MOST_ENTRIES counts, a block of sources
has about BLOCK members. All arithmetic is on 64-bit integers.

Defined cases: null texts, languages and sources count as ''; rows that repeat a document each count as a document;
groups without terms have no ``term`` rows and the values that zero counts give in ``pair`` rows; an empty table gives
none. Equal values rank by item in the order of UTF-8. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import removed_tables, written

#: Bytes of a text as lower-case ASCII letters, bytes of other characters, and blanks for all that is in no term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of an array, counts that close one early, sources of a block, and different (group, term) pairs that a task holds.
CHUNK, MOST_ENTRIES, BLOCK, HELD = 1024, 2_000_000, 128, 1_000_000
COUNTED = "key binary, lang string, sources array<string>, counts array<long>, docs long"
NAMES = [x.split(" ")[0] for x in COUNTED.split(", ")]
ENCODED = "lang string, source string, part int, chunk int, terms array<binary>, ids array<int>, counts array<long>, total long"
SHARE = 1_000_000_000


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """For each language and term its counts by source and the documents with it, as far as one task holds them at once.

    A term's ``key`` is its language, a zero byte and the term, one value to sort by. Each language has also a row of its
    sources, without a key.
    """
    lists = pa.list_(pa.string()), pa.list_(pa.int64())

    def flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for lang in dict.fromkeys(lang for lang, _ in held):
            mine = [(source, n, has) for (of, source), (n, has) in held.items() if of == lang]
            names = pa.array([source for source, *_ in mine], pa.string())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([lang]), pa.array([names.to_pylist()], lists[0]), pa.nulls(1, lists[1]), pa.array([0], pa.int64())], names=NAMES)
            each = pa.table(
                {
                    "term": pa.array([x for _, n, _ in mine for x in n], pa.binary()), "source": np.repeat(np.arange(len(mine)), [len(n) for _, n, _ in mine]),
                    "n": pa.array([x for _, n, _ in mine for x in n.values()], pa.int64()), "docs": pa.array([has[x] for _, n, has in mine for x in n], pa.int64()),
                }
            )
            terms = each.group_by("term").aggregate([("source", "list"), ("n", "list"), ("docs", "sum")]).combine_chunks()
            for part in terms.to_batches(max_chunksize=10_000):
                sources = part["source_list"]
                named = pa.ListArray.from_arrays(pc.subtract(sources.offsets, sources.offsets[0]), names.take(sources.flatten()))
                keys = pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.binary()), part["term"], pa.scalar(b"\0", pa.binary()))
                yield pa.RecordBatch.from_arrays([keys, pa.nulls(len(part), pa.string()), named, part["n_list"], part["docs_sum"]], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        new = 0  # at most so many pairs came since they were counted
        for batch in batches:
            for text, lang, source in zip(batch.column(0).cast(pa.large_binary()), *(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                n, has = held.setdefault((lang, source), (Counter(), Counter()))
                words = text.as_buffer().to_pybytes().translate(FOLD).split()
                n.update(words)
                has.update(different := set(words))
                if (new := new + len(different)) >= HELD and (new := sum(len(x) for x, _ in held.values())) >= HELD:
                    yield from flushed(held)
                    held, new = {}, 0
        yield from flushed(held)

    some = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return docs.select(some(text_col).alias("text"), some(lang_col).alias("lang"), some(source_col).alias("source")).mapInArrow(run, COUNTED)


def encoded(counts: DataFrame, least_docs: int) -> DataFrame:
    """Kept terms as arrays and, for each, the counts of every group in it and of the language (``source`` null)."""

    def rows_of(lang: str, chunk: int, terms: list[bytes], ids: np.ndarray, sources: pa.DictionaryArray, n: np.ndarray) -> pa.RecordBatch:
        part, size = TaskContext.get().partitionId(), len(terms)
        names, group = sources.dictionary.to_pylist(), sources.indices.to_numpy().astype(np.int64)
        # one number a group and term, and the sum of its counts; entries of one number may come from several tasks
        at, place = np.unique(group * size + ids, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, place, n)
        cuts = np.searchsorted(at, np.arange(1, len(names)) * size)
        out = [(name, None, i, c) for name, i, c in zip(names, np.split(at % size, cuts), np.split(total, cuts), strict=True)]
        whole = np.zeros(size, np.int64)
        np.add.at(whole, ids, n)
        out.append((None, terms, np.arange(size), whole))
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.repeat(lang, len(out)), "source": pa.array([r[0] for r in out], pa.string()), "part": pa.repeat(pa.scalar(part, pa.int32()), len(out)), "chunk": pa.repeat(pa.scalar(chunk, pa.int32()), len(out)),
                "terms": pa.array([r[1] for r in out], pa.list_(pa.binary())), "ids": pa.array([r[2] for r in out], pa.list_(pa.int32())), "counts": pa.array([r[3] for r in out], pa.list_(pa.int64())), "total": pa.array([int(r[3].sum()) for r in out], pa.int64()),
            }
        )

    def changes(table: pa.Table) -> np.ndarray:
        """Where rows of another term or language begin."""
        keys = table["key"].combine_chunks()
        if len(keys) < 2:
            return np.zeros(len(keys), np.int64)
        return np.r_[0, np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, lang, rest = 0, None, None
        terms: list[bytes] = []
        held: list[pa.Table] = []  # whole terms of one language

        def closed() -> pa.RecordBatch:
            table = pa.concat_tables(held).combine_chunks()
            ids = np.searchsorted(changes(table), np.arange(table.num_rows), "right") - 1  # rows are in the order of terms
            sources, counts = table["sources"].combine_chunks(), table["counts"].combine_chunks()
            return rows_of(lang, chunk, terms, np.repeat(ids, np.asarray(sources.value_lengths())), sources.flatten().dictionary_encode(), counts.flatten().to_numpy())

        def taken(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Takes a table of whole terms; gives the arrays that became full."""
            nonlocal chunk, lang, terms, held
            starts = changes(table)
            sizes = np.diff(np.r_[starts, table.num_rows])
            entries_of = np.add.reduceat(np.asarray(table["counts"].combine_chunks().value_lengths()), starts)
            kept = np.flatnonzero(np.add.reduceat(table["docs"].to_numpy(), starts) >= least_docs)
            if not len(kept):
                return
            keys = [key.rpartition(b"\0") for key in table["key"].take(starts[kept]).to_pylist()]
            entries = sum(len(t["counts"].combine_chunks().flatten()) for t in held)
            begun = 0
            for k in range(len(kept) + 1):
                full = k < len(kept) and terms and (keys[k][0].decode() != lang or len(terms) >= CHUNK or entries >= MOST_ENTRIES)
                if full or k == len(kept):
                    mine = kept[begun:k]
                    if len(mine):
                        held.append(table.take(np.concatenate([np.arange(s, s + z) for s, z in zip(starts[mine], sizes[mine], strict=True)])))
                    begun = k
                    if full:
                        yield closed()
                        chunk, terms, held, entries = chunk + 1, [], [], 0
                if k < len(kept):
                    lang = keys[k][0].decode()
                    terms.append(keys[k][2])
                    entries += int(entries_of[kept[k]])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = int(changes(table)[-1]) if table.num_rows else 0
            whole, rest = table.slice(0, last), table.slice(last)
            if whole.num_rows:
                yield from taken(whole)
        if rest is not None and rest.num_rows:
            yield from taken(rest)
        if terms:
            yield closed()

    rows = counts.filter("key is not null").select("key", "sources", "counts", "docs")
    return rows.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, ENCODED)


def shares(counts: np.ndarray, base: int | np.ndarray) -> np.ndarray:
    """1 + floor(SHARE * (count + 2) / base), by two steps of long division, exact for counts below 9 * 10^13."""
    one, rest = np.divmod((counts + 2) * 100_000, base)
    return 1 + one * (SHARE // 100_000) + rest * (SHARE // 100_000) // base


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def bases(counts: DataFrame, table: DataFrame) -> DataFrame:
    """(lang, source, base, block, blocks): each group's kept occurrences plus twice the kept terms; and, with a null
    source, each language's. Sources are dealt to blocks by a hash."""
    groups = counts.filter("key is null").select("lang", F.explode("sources").alias("source")).distinct()
    n = table.groupBy("lang", "source").agg(F.sum("total").alias("_n"))
    v = table.filter("source is null").groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("_v"))
    sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    every = groups.union(groups.select("lang", F.lit(None).cast("string").alias("source")).distinct()).join(sources, "lang").join(v, "lang", "left")
    found = every.join(n.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source"), (F.col("lang") == F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    base = F.coalesce("_n", F.lit(0).cast("long")) + 2 * F.coalesce("_v", F.lit(0).cast("long"))
    return found.select("lang", "source", base.alias("base"), F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), "blocks")


def telling_terms(table: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, value): the ``most`` terms of each group that it has more of than its language, at most, in each array."""

    def run(key: tuple, chunk: pa.Table) -> pa.Table:
        rows = chunk.to_pylist()
        whole = next(r for r in rows if r["source"] is None)
        q = shares(np.array(whole["counts"], np.int64), whole["base"])
        out: list[tuple] = []
        for r in rows:
            if r["source"] is not None:
                ids = np.array(r["ids"], np.int64)
                p = shares(np.array(r["counts"], np.int64), r["base"])
                more = np.flatnonzero(p > q[ids])
                value = differences(p[more], q[ids[more]])
                best = np.lexsort((ids[more], -value))[:most]  # ids keep the terms' order
                out += [(r["lang"], r["source"], whole["terms"][i], v) for i, v in zip(ids[more[best]].tolist(), value[best].tolist(), strict=True)]
        return pa.table({k: pa.array([r[i] for r in out], kind) for i, (k, kind) in enumerate((("lang", pa.string()), ("source", pa.string()), ("item", pa.binary()), ("value", pa.int64())))})

    return table.groupBy("lang", "part", "chunk").applyInArrow(run, "lang string, source string, item binary, value long")


def source_pairs(table: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each array and pair of sources of a language, the sum of its terms' differences."""
    own = groups.filter("source is not null")
    block = own.groupBy("lang", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("source", "base"))).alias("members"))  # about BLOCK members each
    later = block.select("lang", F.col("block").alias("other"), F.col("members").alias("others"))
    both = block.join(later, "lang").filter("block <= other").drop("blocks")  # pairs of blocks, not of sources
    arrays = table.filter("source is null").select("lang", "part", "chunk", F.size("terms").alias("size"))
    # languages without kept terms still have pairs: one array of no terms
    none = own.select("lang").distinct().join(arrays.select("lang").distinct(), "lang", "left_anti")
    arrays = arrays.union(none.select("lang", F.lit(-1), F.lit(-1), F.lit(0)))
    work = arrays.join(both, "lang")
    placed = table.filter("source is not null").select("lang", "part", "chunk", "source", "ids", "counts", "block", "blocks")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("block"), F.greatest("block", x).alias("other")))
    dealt = placed.withColumn("_p", F.explode(pairs)).select("lang", "part", "chunk", "_p.block", "_p.other", "source", "ids", "counts")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {k: [] for k in ("lang", "source", "item", "value")}
        placed_rows = right.to_pylist()
        for job in left.to_pylist():  # one row
            names = [[m["source"] for m in job[k]] for k in ("members", "others")]
            dense = []
            for k, side in zip(("members", "others"), names, strict=True):
                base = np.array([m["base"] for m in job[k]], np.int64)[:, None]
                counts = np.zeros((len(side), job["size"]), np.int64)
                row = {name: i for i, name in enumerate(side)}
                for r in placed_rows:
                    if r["source"] in row:
                        counts[row[r["source"]], r["ids"]] = r["counts"]
                dense.append(shares(counts, np.maximum(base, 1)))
            same = job["block"] == job["other"]
            for i, name in enumerate(names[0]):
                sums = differences(dense[1][i + 1 if same else 0 :], dense[0][i]).sum(1).tolist()
                for other, value in zip(names[1][i + 1 if same else 0 :], sums, strict=True):
                    found["source"] += [name, other]
                    found["item"] += [other, name]
                    found["value"] += [value, value]
            found["lang"] += [job["lang"]] * (len(found["source"]) - len(found["lang"]))
        return pa.table({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in found.items()})

    keys = ["lang", "part", "chunk", "block", "other"]
    dealt = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # columns of their own, as both sides come from one table
    made = work.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, "lang string, source string, item string, value long")
    return made.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, most: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of a language by their distance (part ``pair``, all),
    and the terms that tell a source from its language (part ``term``, ``most`` of them), the greatest value first."""
    counts = written(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    table = written(encoded(counts, least_docs), "term-arrays")
    groups = written(bases(counts, table), "term-bases")
    on = (F.col("lang") == F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    based = table.join(groups.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source"), on).drop("_lang", "_source")

    def ranked(rows: DataFrame, part: str, item: Column) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        rows = rows.select("lang", "source", F.lit(part).alias("part"), item.alias("item"), "value").withColumn("rank", F.row_number().over(order))
        return rows.filter(F.col("rank") <= most) if part == "term" else rows

    terms = ranked(telling_terms(based, most), "term", F.col("item").cast("string"))
    pairs = ranked(source_pairs(based, groups), "pair", F.col("item"))
    out = written(terms.unionByName(pairs), "divergence")
    removed_tables(counts, table, groups)
    return out


#: The whole contract in DuckDB's SQL; shares and differences in 128-bit integers.
ORACLE = r"""with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as n from w group by lang, term having count(distinct i) >= 10),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by lang),
c as (select w.lang, w.source, w.term, count(*)::hugeint as n from w join kept k on k.lang = w.lang and k.term = w.term group by 1, 2, 3),
g as (select x.lang, x.source, coalesce(v.v, 0) as v, coalesce(v.n, 0) as ln, coalesce(s.n, 0) as n from (select distinct lang, source from d) x left join v on v.lang = x.lang left join (select lang, source, sum(n)::hugeint as n from c group by 1, 2) s on s.lang = x.lang and s.source = x.source),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) as p, 1 + 1000000000 * (k.n + 2) // (g.ln + 2 * g.v) as q from g join kept k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from terms)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10"""
