"""Queries of the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import workflow
from lexmill.functions.stats import hypergeometric_sum
from lexmill.functions.text import recase
from lexmill.operators import counts, decompose, extract, filters, merge, rank, text
from lexmill.plans.fixtures import duck, relation
from lexmill.shared import new_path
from lexmill.sources import phrase_table
from lexmill.sources import text as source
from lexmill.streaming import counter

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
SENTENCE = ["conv_id", "turn"]


def query(oracle: str | None = None, *needs: str):
    """Registers a query under its function's name, with DuckDB SQL over the named relations."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = duck(oracle, *needs)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


TOKENS = "select token, count(*) as n from (select unnest(string_split(value, ' ')) as token from lines) group by token"


# sources and sinks


@query(TOKENS, "lines")
def token_counts(spark, d):
    return counts.token_counts(relation(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


@query("select doc_id, line_no::int as line_no, value from lines", "lines")
def line_scan(spark, d):
    """Lines written as text, in order, and read again."""
    path = new_path(spark, "lines")
    source.write_lines(relation(spark, d, "lines").select("doc_id", "line_no", _line("value")), path, order=("doc_id", "line_no"))
    return source.lines(spark, path, end="\n").select(*_fields()[:2], _fields()[2].alias("value"))


@query("select count(*) as n from lines", "lines")
def wc(spark, d):
    return relation(spark, d, "lines").agg(F.count("*").alias("n"))


@query("select 0 as ord, n_name as value from nation union all select 1, r_name from region")
def cat_union(spark, d):
    return source.cat(relation(spark, d, "nation").select(F.col("n_name").alias("value")), relation(spark, d, "region").select(F.col("r_name").alias("value")))


@query()
def find_files(spark, d):
    return source.find(spark, d, "*.parquet").filter(F.col("path").endswith(".parquet"))


@query("select doc_id, line_no::int as line_no, ((row_number() over (order by doc_id, line_no) - 1) // 1000 + 1)::bigint as chunk, ((row_number() over (order by doc_id, line_no) - 1) % 1000)::bigint as place, value from lines", "lines")
def split_chunks(spark, d):
    """All lines numbered, written in chunks of 1,000 and read again, with their place in their chunk."""
    path = new_path(spark, "chunks")
    rows = source.numbered(relation(spark, d, "lines"), "doc_id", "line_no", name="place")
    source.write_chunks(rows.select("place", _line("value")), path, 1000, line_no="place")
    return source.read_chunks(spark, path, end="\n").select(*_fields()[:2], "chunk", F.col("line_no").alias("place"), _fields()[2].alias("value"))


def _line(value: str) -> Column:
    """Document, line and value as one line of text."""
    return F.concat_ws("\t", "doc_id", "line_no", value).alias("value")


def _fields() -> list[Column]:
    parts = F.split("value", "\t", 3)
    return [F.get(parts, F.lit(0)).cast("long").alias("doc_id"), F.get(parts, F.lit(1)).cast("int").alias("line_no"), F.get(parts, F.lit(2))]


@query("select value, count(*) as n from lines group by value", "lines")
def sort_lines(spark, d):
    return rank.sort_lines(counts.count_keys(relation(spark, d, "lines"), "value"))


@query("select distinct trim(token) as term from (select unnest(string_split(value, ' ')) as token from lines) where trim(token) <> ''", "lines")
def termbase(spark, d):
    return source.terms(relation(spark, d, "lines").select(F.explode(F.split("value", " ")).alias("value")))


@query("select count(distinct p_name) as n from part")
def termbase_size(spark, d):
    return relation(spark, d, "part").agg(F.count_distinct("p_name").alias("n"))


@query("select distinct f as term from pt_base where f in (select p_name from part)", "pt_base")
def termbase_lookup(spark, d):
    known = source.terms(relation(spark, d, "part"), "p_name")
    return relation(spark, d, "pt_base").select(F.col("f").alias("term")).distinct().join(known, "term", "left_semi")


@query("select line_no, value from ldp_src where line_no >= (select min(line_no) from ldp_src where value like '<n7>%')", "ldp_src")
def ini_tail(spark, d):
    src = relation(spark, d, "ldp_src")
    header = F.when(F.col("value").startswith("<n7>"), F.lit("[start]")).otherwise(F.col("value"))
    return source.from_section(src.withColumn("head", header), "[start]", "head").select("line_no", "value")


@query("select conv_id, turn, src as value from pairs", "pairs")
def tag_extract(spark, d):
    wrapped = relation(spark, d, "pairs").select(*SENTENCE, F.concat(F.lit("x <s1>"), "src", F.lit("</s1> y")).alias("value"))
    return source.tagged(wrapped, "s1")


@query("select line_no::int as line_no, round(least(0, logp), 6)::double as logp, ngram, round(backoff, 6)::double as backoff from arpa", "arpa")
def arpa_scan(spark, d):
    rows = relation(spark, d, "arpa").select("line_no", F.concat_ws("\t", F.col("logp").cast("double").cast("string"), "ngram", F.col("backoff").cast("string")).alias("value"))
    found = filters.clamp_log_probabilities(source.arpa(rows))
    return found.select(F.col("line_no").cast("int").alias("line_no"), F.round("logp", 6).alias("logp"), "ngram", F.round("backoff", 6).alias("backoff"))


@query("select line_no, round(least(0, logp), 6)::double as logp, ngram, backoff from arpa", "arpa")
def arpa_clamp(spark, d):
    return filters.clamp_log_probabilities(relation(spark, d, "arpa")).withColumn("logp", F.round("logp", 6))


@query("select f, t, lft, ltf, align, c_first, c_second, c_both from pt_shards", "pt_shards")
def phrase_table_parse(spark, d):
    pt = relation(spark, d, "pt_shards")
    one = F.lit(1.0)
    text_ = pt.select(phrase_table.format_phrase_table(F.col("f"), F.col("t"), [one, F.col("lft"), one, F.col("ltf"), F.lit(2.718)], F.col("align"), [F.col("c_first"), F.col("c_second"), F.col("c_both")]).alias("value"))
    return phrase_table.parse_phrase_table(text_).select("f", "t", "lft", "ltf", "align", "c_first", "c_second", "c_both")


@query("select f, t, s1::double as s1, s2::double as s2, s3::double as s3 from rot", "rot")
def reordering_parse(spark, d):
    rows = relation(spark, d, "rot").select(F.concat_ws(" ||| ", "f", "t", F.concat_ws(" ", "s1", "s2", "s3")).alias("value"))
    return phrase_table.parse_reordering(rows).select("f", "t", *[F.get("scores", F.lit(i)).alias(f"s{i + 1}") for i in range(3)])


@query("select w1, w2, round(p, 9) as p from lex", "lex")
def lexical_parse(spark, d):
    rows = relation(spark, d, "lex").select(F.concat_ws(" ", "w1", "w2", F.col("p").cast("string")).alias("value"))
    return phrase_table.parse_lexical(rows).withColumn("p", F.round("p", 9))


@query("select f as key, sum(c_both)::bigint as n from pt_base group by f", "pt_base")
def counts_parse(spark, d):
    rows = relation(spark, d, "pt_base").groupBy("f").agg(F.sum("c_both").alias("n")).select(F.concat_ws(" ||| ", "f", "n").alias("value"))
    return phrase_table.parse_counts(rows)


@query("select distinct least(a.lang, b.lang) as l1, greatest(a.lang, b.lang) as l2 from (select distinct lang from documents) a, (select distinct lang from documents) b where a.lang is not null and b.lang is not null")
def language_pairs(spark, d):
    langs = relation(spark, d, "documents").select("lang").filter("lang is not null").distinct()
    both = langs.toDF("a").crossJoin(langs.toDF("b")).filter("a <= b")
    return both.select(F.col("a").alias("l1"), F.col("b").alias("l2"))


@query("select line_no, case when value like '%\"EUROPE\" \"\"' then 'europe' else value end as value from ldp_src", "ldp_src")
def config_rewrite(spark, d):
    return text.rewritten(relation(spark, d, "ldp_src"), {'"EUROPE" ""': "europe"})


# zips, counts, extraction


@query("select p.conv_id, p.turn, p.src, p.trg from pairs p", "pairs")
def zip_lines(spark, d):
    pairs = relation(spark, d, "pairs")
    return source.zip_lines(pairs.select(*SENTENCE, "src"), pairs.select(*SENTENCE, "trg"), SENTENCE)


@query("select conv_id, turn, src || ' ||| ' || trg as value from pairs", "pairs")
def paste(spark, d):
    return relation(spark, d, "pairs").select(*SENTENCE, F.concat_ws(" ||| ", "src", "trg").alias("value"))


@query("select conv_id, turn from pairs where len(string_split(src, ' ')) between 1 and 80 and len(string_split(trg, ' ')) between 1 and 80", "pairs")
def length_filter(spark, d):
    return filters.length_filter(relation(spark, d, "pairs"), "src", "trg").select(*SENTENCE)


UNALIGNED = """select word, count(*) as n from (select conv_id, turn, unnest(string_split({side}, ' ')) as word, generate_subscripts(string_split({side}, ' '), 1) - 1 as pos from pairs) w
where not exists (select 1 from links k where k.conv_id = w.conv_id and k.turn = w.turn and k.{place} = w.pos) group by word"""


@query(UNALIGNED.format(side="src", place="l"), "pairs", "links")
def count_unaligned_src(spark, d):
    return counts.count_unaligned(relation(spark, d, "pairs"), relation(spark, d, "links"), SENTENCE, "src")


@query(UNALIGNED.format(side="trg", place="r"), "pairs", "links")
def count_unaligned_trg(spark, d):
    return counts.count_unaligned(relation(spark, d, "pairs"), relation(spark, d, "links"), SENTENCE, "trg")


def _extraction(last: int, tail: str) -> str:
    return f"""with k as (select *, row_number() over (partition by conv_id, turn order by l, r) - 1 as i, count(*) over (partition by conv_id, turn) as n from links),
c as (select a.conv_id, a.turn, a.i as i, b.i as j from k a join k b on a.conv_id = b.conv_id and a.turn = b.turn and b.i >= a.i and b.i < a.i + 25 and b.i < a.n - {last}),
g as (select c.conv_id, c.turn, c.i, c.j, count(distinct l) as nl, min(l) as l0, max(l) as l1, count(distinct r) as nr, min(r) as r0, max(r) as r1, list(l order by k.i) as ls, list(r order by k.i) as rs
      from c join k on k.conv_id = c.conv_id and k.turn = c.turn and k.i between c.i and c.j group by all),
good as (select g.conv_id, g.turn, ls, rs, array_to_string(string_split(src, ' ')[l0 + 1:l1 + 1], ' ') as a, array_to_string(string_split(trg, ' ')[r0 + 1:r1 + 1], ' ') as b
      from g join pairs p on p.conv_id = g.conv_id and p.turn = g.turn
      where nl <= 5 and nr <= 5 and (l1 = l0 or nl >= 0.75 * (l1 - l0)) and (r1 = r0 or nr >= 0.75 * (r1 - r0)))
{tail}"""


PAIR_COUNTS = "select a as foreign_, b as translation, count(*) as n from good group by 1, 2".replace("foreign_", '"foreign"')


def _found(spark, d, **how):
    pairs = extract.aligned(relation(spark, d, "pairs"), relation(spark, d, "links"), SENTENCE)
    return extract.phrases(pairs.select(*SENTENCE, "src", "trg", "links"), **how)


@query(_extraction(1, PAIR_COUNTS), "pairs", "links")
def extract_pairs(spark, d):
    return extract.pair_counts(_found(spark, d))


@query(_extraction(1, PAIR_COUNTS), "pairs", "links")
def extract_from_lines(spark, d):
    """Extraction from lines of alignments and of both sides, as text."""
    pairs = extract.aligned(relation(spark, d, "pairs"), relation(spark, d, "links"), SENTENCE)
    shown = F.array_join(F.transform("links", lambda x: F.concat_ws("-", x["l"].cast("string"), x["r"].cast("string"))), " ")
    found = extract.from_lines(pairs.select(*SENTENCE, shown.alias("value")), pairs.select(*SENTENCE, F.concat_ws(" ||| ", "src", "trg").alias("value")), SENTENCE)
    return extract.pair_counts(extract.phrases(found))


@query(_extraction(0, PAIR_COUNTS), "pairs", "links")
def extract_pairs_repaired(spark, d):
    return extract.pair_counts(_found(spark, d, repaired=True))


@query(_extraction(1, 'select b as "foreign", a as translation, count(*) as n from good group by 1, 2'), "pairs", "links")
def extract_pairs_inverse(spark, d):
    return extract.pair_counts(_found(spark, d, inverse=True))


@query(_extraction(1, "select a as phrase, count(*) as n from (select distinct conv_id, turn, a, ls from good) group by 1"), "pairs", "links")
def extract_foreign(spark, d):
    return extract.side_counts(_found(spark, d), SENTENCE, "foreign")


@query(_extraction(1, "select b as phrase, count(*) as n from (select distinct conv_id, turn, b, rs from good) group by 1"), "pairs", "links")
def extract_translation(spark, d):
    return extract.side_counts(_found(spark, d), SENTENCE, "translation")


@query("select f, t, sum(c_both)::bigint as n from pt_base group by f, t", "pt_base")
def merge_counts(spark, d):
    base = relation(spark, d, "pt_base").select("shard", "f", "t", F.col("c_both").alias("n"))
    return counts.merge_counts(*[base.filter(F.col("shard") == s).drop("shard") for s in range(4)], keys=["f", "t"])


# merges


@query("with b as (select *, min(case when p > 0.01 then shard end) over (partition by w1, w2) as first_big from lex) select w1, w2, round(sum(p / 4), 9) as p from b where shard >= first_big group by w1, w2", "lex")
def merge_lex(spark, d):
    return merge.merge_lexical(relation(spark, d, "lex"), 4).withColumn("p", F.round("p", 9))


@query("select w1, w2, round(sum(p / 4), 9) as p from lex group by w1, w2 having sum(p / 4) > 0.01 / 4", "lex")
def merge_lex_repaired(spark, d):
    return merge.merge_lexical(relation(spark, d, "lex"), 4, repaired=True).withColumn("p", F.round("p", 9))


def _shards(spark, d):
    return relation(spark, d, "pt_shards").withColumn("raw", F.concat_ws(" ||| ", "f", "t", "align", "shard"))


def _lexicons(spark, d):
    lex = merge.merge_lexical(relation(spark, d, "lex"), 4).withColumn("p", F.round("p", 9))
    return lex, lex.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "p")


def _merged(tail: str, last: bool) -> str:
    keep = "" if last else "where mx <> (select max(raw) from s)"
    return f"""with b as (select *, min(case when p > 0.01 then shard end) over (partition by w1, w2) as first_big from lex),
lx as (select w1, w2, round(sum(p / 4), 9) as p from b where shard >= first_big group by w1, w2),
s as (select *, f || ' ||| ' || t || ' ||| ' || align || ' ||| ' || shard as raw from pt_shards),
m as (select * from (select f, t, arg_min(align, raw) as align, max(raw) as mx, sum(c_first)::bigint as c_first, sum(c_second)::bigint as c_second, sum(c_both)::bigint as c_both from s where f <> '' group by f, t) {keep}),
k as (select f, t, split_part(x, '-', 1)::int as l, split_part(x, '-', 2)::int as r from (select f, t, unnest(string_split(align, ' ')) as x from m)),
wf as (select f, t, unnest(string_split(f, ' ')) as w, generate_subscripts(string_split(f, ' '), 1) - 1 as pos from m),
wt as (select f, t, unnest(string_split(t, ' ')) as w, generate_subscripts(string_split(t, ' '), 1) - 1 as pos from m),
pf as (select wf.f, wf.t, wf.pos, case when count(k.l) = 0 then coalesce(max(nl.p), 0) else sum(coalesce(lx.p, 0)) / count(k.l) end as p
       from wf left join k on k.f = wf.f and k.t = wf.t and k.l = wf.pos left join wt o on o.f = k.f and o.t = k.t and o.pos = k.r
       left join lx on lx.w1 = wf.w and lx.w2 = o.w left join lx nl on nl.w1 = wf.w and nl.w2 = 'NULL' group by 1, 2, 3),
pt as (select wt.f, wt.t, wt.pos, case when count(k.l) = 0 then coalesce(max(nl.p), 0) else sum(coalesce(lx.p, 0)) / count(k.l) end as p
       from wt left join k on k.f = wt.f and k.t = wt.t and k.r = wt.pos left join wf o on o.f = k.f and o.t = k.t and o.pos = k.l
       left join lx on lx.w2 = wt.w and lx.w1 = o.w left join lx nl on nl.w2 = wt.w and nl.w1 = 'NULL' group by 1, 2, 3),
qf as (select f, t, product(case when p = 0 then 1e-8 else p end) as v from pf group by 1, 2),
qt as (select f, t, product(case when p = 0 then 1e-8 else p end) as v from pt group by 1, 2),
z as (select m.f, m.t, round(c_both::double / c_first, 9) as pft, round(qf.v, 9) as lft, round(c_both::double / c_second, 9) as ptf, round(qt.v, 9) as ltf, 2.718::double as bias, align, c_first, c_second, c_both
      from m join qf on qf.f = m.f and qf.t = m.t join qt on qt.f = m.f and qt.t = m.t)
{tail}"""


#: Lines in an order that is not sorted: the pairs of a phrase stand in two places.
UNSORTED = "md5(concat(f, cast(shard % 2 as varchar))), t, shard"


def _merged_lines() -> str:
    """The same over neighbouring lines; alignments depend on the pair alone here, and so do lexical weights."""
    text = _merged("select * from z", True)
    text = text.replace("from pt_shards),", f"from pt_shards), o as (select *, row_number() over (order by {UNSORTED}) - 1 as line_no from s), b1 as (select *, case when f = lag(f) over (order by line_no) and t = lag(t) over (order by line_no) then 0 else 1 end as new from o), b2 as (select *, sum(new) over (order by line_no) as run from b1),")
    head, _, rest = text.partition("m as (")
    return f"""{head}ma as (select f, t, run, arg_min(align, line_no) as align, sum(c_first)::bigint as c_first, sum(c_second)::bigint as c_second, sum(c_both)::bigint as c_both from b2 where f <> '' and run <> (select max(run) from b2) group by f, t, run),
m as (select distinct f, t, align from ma),
{rest.partition("group by f, t) )")[2].lstrip(",")}""".replace("from m join qf", "from ma m join qf")


def _rounded(df: DataFrame) -> DataFrame:
    for name in ("pft", "lft", "ptf", "ltf"):
        df = df.withColumn(name, F.round(name, 9))
    return df


@query(_merged("select * from z", False), "pt_shards", "lex")
def merge_pts(spark, d):
    return _rounded(merge.merge_phrase_tables(_shards(spark, d), *_lexicons(spark, d)))


@query(_merged("select * from z", True), "pt_shards", "lex")
def merge_pts_repaired(spark, d):
    return _rounded(merge.merge_phrase_tables(_shards(spark, d), *_lexicons(spark, d), repaired=True))


def _in_lines(df: DataFrame) -> DataFrame:
    rows = df.withColumn("_key", F.md5(F.concat("f", (F.col("shard") % 2).cast("string"))))
    return source.numbered(rows, "_key", "t", "shard").drop("_key")


@query(_merged_lines(), "pt_shards", "lex")
def merge_pts_lines(spark, d):
    """Phrase table lines that are not sorted: each group of neighbours is merged by itself."""
    return _rounded(merge.merge_phrase_tables(_in_lines(_shards(spark, d)), *_lexicons(spark, d), line_no="line_no"))


#: Reordering lines sorted but for some that come late, against a phrase table without some pairs; ||| after each side.
LATE = "case when md5(concat(f, t)) < '2' then 1 else 0 end"


@query(
    f"""with o as (select *, row_number() over (order by {LATE}, f, t, shard) as line_no from rot),
    r1 as (select *, case when f = lag(f) over (order by line_no) and t = lag(t) over (order by line_no) then 0 else 1 end as new from o),
    r2 as (select *, sum(new) over (order by line_no) as run from r1),
    g as (select run, f, t, f || ' ||| ' || t || ' ||| ' as pair, avg(s1) as s1, avg(s2) as s2, avg(s3) as s3 from r2 group by all),
    k as (select *, max(pair) over (order by run) as top from g),
    p as (select distinct f || ' ||| ' || t || ' ||| ' as pair from pt_shards where c_both > 1)
    select f, t, round(s1, 9) as s1, round(s2, 9) as s2, round(s3, 9) as s3 from k where f <> '' and case when top <= (select max(pair) from p) then pair = top and pair in (from p) else pair = (select max(pair) from p) end""",
    "rot",
    "pt_shards",
)
def merge_rot_lines(spark, d):
    """Both tables read side by side, as lines: what comes late is lost."""
    rot = relation(spark, d, "rot").select("shard", "f", "t", F.array(*[F.col(f"s{i}").cast("double") for i in (1, 2, 3)]).alias("scores"))
    late = F.when(F.md5(F.concat("f", "t")) < "2", 1).otherwise(0)
    rot = source.numbered(rot.withColumn("_late", late), "_late", "f", "t", "shard")
    table = relation(spark, d, "pt_shards").filter("c_both > 1").select("f", "t").distinct().withColumn("_pair", F.concat_ws(" ||| ", "f", "t", F.lit("")))
    out = merge.merge_reordering(rot, source.numbered(table, "_pair"), "line_no")
    return out.select("f", "t", *[F.round(F.get("scores", F.lit(i)), 9).alias(f"s{i + 1}") for i in range(3)])


@query("select f, t, round(avg(s1), 9) as s1, round(avg(s2), 9) as s2, round(avg(s3), 9) as s3 from rot where f <> '' and (f, t) in (select f, t from pt_shards where c_both > 1) group by f, t", "rot", "pt_shards")
def merge_rot(spark, d):
    rot = relation(spark, d, "rot").select("f", "t", F.array(*[F.col(f"s{i}").cast("double") for i in (1, 2, 3)]).alias("scores"))
    out = merge.merge_reordering(rot, relation(spark, d, "pt_shards").filter("c_both > 1"))
    return out.select("f", "t", *[F.round(F.get("scores", F.lit(i)), 9).alias(f"s{i + 1}") for i in range(3)])


@query("with j as (select f, t, sum(c_both)::bigint as c_both from pt_base group by f, t) select f, t, c_both, round(c_both::double / sum(c_both) over (partition by t), 9) as p_ft, round(c_both::double / sum(c_both) over (partition by f), 9) as p_tf from j", "pt_base")
def cond_probs(spark, d):
    return counts.conditional(relation(spark, d, "pt_base")).withColumn("p_ft", F.round("p_ft", 9)).withColumn("p_tf", F.round("p_tf", 9))


# filters

COVER = "(len(string_split(align, ' '))::double / greatest(len(string_split(f, ' ')), len(string_split(t, ' '))))"


@query(f"select shard, f, t from pt_shards where {COVER} > 0.4 and c_both >= 2", "pt_shards")
def basic_filter(spark, d):
    return filters.basic_filter(relation(spark, d, "pt_shards"), 0.4, 2).select("shard", "f", "t")


@query(
    f"""with e as (select shard, f, t, align, case when len(string_split(f, ' ')) = 1 then c_both * (ln(c_both::double / c_first) + 25) else c_both * (ln(c_both::double / c_first) - ln(lft)) end as entropy from pt_shards)
    select shard, f, t, round(entropy, 6) as entropy from e where entropy > 20 and {COVER} >= 0.5""",
    "pt_shards",
)
def simple_entropy(spark, d):
    rows = relation(spark, d, "pt_shards").withColumn("pft", F.col("c_both").cast("double") / F.col("c_first"))
    return filters.entropy_filter(rows, 20).select("shard", "f", "t", F.round("entropy", 6).alias("entropy"))


@query(
    """with j as (select f, t, sum(c_both)::bigint as n, sum(c_both)::double / sum(sum(c_both)) over (partition by t)::double as p from pt_base group by f, t),
    w as (select f, t, string_split(f, ' ') as ff, string_split(t, ' ') as tt from j),
    c as (select f, t, ff, tt, i, unnest(range(1, len(tt))) as k from (select *, unnest(range(1, len(ff))) as i from w)),
    h as (select f, t, array_to_string(ff[:i], ' ') as f1, array_to_string(ff[i + 1:], ' ') as f2, array_to_string(tt[:k], ' ') as t1, array_to_string(tt[k + 1:], ' ') as t2 from c),
    y as (select f, t, f1 as fa, t1 as ta, f2 as fb, t2 as tb from h union all select f, t, f1, t2, f2, t1 from h),
    s as (select f, t, p from j where len(string_split(f, ' ')) <= 3 and len(string_split(t, ' ')) <= 3),
    b as (select y.f, y.t, max(a.p * b.p) as best from y join s a on a.f = y.fa and a.t = y.ta join s b on b.f = y.fb and b.t = y.tb group by 1, 2),
    e as (select j.f, j.t, n, case when best > 0 then n * (ln(p) - ln(best)) else 'infinity'::double end as entropy from j left join b on b.f = j.f and b.t = j.t)
    select f, t, n, round(case when entropy = 'infinity'::double then null else entropy end, 6) as entropy from e where entropy > 5""",
    "pt_base",
)
def compositional_entropy(spark, d):
    rows = counts.conditional(relation(spark, d, "pt_base")).select("f", "t", F.col("c_both").alias("n"), F.col("p_ft").alias("p"))
    out = filters.compositional_filter(rows, 5.0)
    return out.select("f", "t", "n", F.round(F.when(F.col("entropy") != filters.INFINITY, F.col("entropy")), 6).alias("entropy"))


def _fisher(repaired: bool, table: str = "pt_shards", order: str = "c_both, f, t, shard", population: int = 200, lines: bool = False) -> str:
    """One-word pairs that are significant, or the best of their f; ``lines``: f are parted where they are not neighbours."""
    n = population
    down = ", ".join(f"{c} desc" for c in order.split(", "))
    group = "run" if lines else "f"
    extra = "" if repaired else f"and r.{group} in (select {group} from p group by {group} having not contains(arg_max(t, ({order})), ' ')) and r.{group} <> (select arg_max({group}, ({order})) from p)"
    runs_ = f"select *, sum(new) over (order by {order}) as run from (select *, case when f = lag(f) over (order by {order}) then 0 else 1 end as new from {table})"
    return f"""with p as ({runs_ if lines else f"select * from {table}"}),
    a as (select *, least(c_first + 1, {n})::bigint as k, least(c_second + 1, {n})::bigint as n from p where not contains(f, ' ') and not contains(t, ' ')),
    x as (select *, coalesce(list_sum(list_transform(range(greatest(c_both + 1, n - ({n} - k)), least(k, n) + 1), lambda x:
      exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1.0) + lgamma({n} - k + 1) - lgamma(n - x + 1.0) - lgamma({n} - k - (n - x) + 1.0) - (lgamma({n} + 1) - lgamma(n + 1) - lgamma({n} - n + 1))))), 0) as score from a),
    r as (select *, min(score) over (partition by {group}) as least_, row_number() over (partition by {group} order by score, {down}) as rk from x)
    select {"shard, " if table == "pt_shards" else ""}f, t, round(score, 8) as score from r where (score < 0.2 or (least_ >= 0.2 and rk = 1)) {extra}"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in ("shard", "f", "t") if c in df.columns], F.round("score", 8).alias("score"))


@query(_fisher(False), "pt_shards")
def fisher_filter(spark, d):
    return _shown(filters.fisher_filter(relation(spark, d, "pt_shards"), 200, 0.2, ["c_both", "f", "t", "shard"]))


@query(_fisher(True), "pt_shards")
def fisher_filter_repaired(spark, d):
    return _shown(filters.fisher_filter(relation(spark, d, "pt_shards"), 200, 0.2, ["c_both", "f", "t", "shard"], repaired=True))


@query(_fisher(False, "pt_words", "f, t", 20_000), "pt_words")
def fisher_filter_words(spark, d):
    """Linked words of sentences, as is, in their order."""
    return _shown(filters.fisher_filter(relation(spark, d, "pt_words"), 20_000, 0.2, ["f", "t"], tail=hypergeometric_sum))


@query(_fisher(False, "(select *, md5(concat(f, cast(c_both % 3 as varchar))) as o1 from pt_words)", "o1, t", 20_000, lines=True), "pt_words")
def fisher_filter_lines(spark, d):
    """The same as lines that are not sorted: the pairs of a word stand in up to three places."""
    rows = relation(spark, d, "pt_words").withColumn("_key", F.md5(F.concat("f", (F.col("c_both") % 3).cast("string"))))
    return _shown(filters.fisher_filter(source.numbered(rows, "_key", "t"), 20_000, 0.2, [], line_no="line_no", tail=hypergeometric_sum))


# ranking


@query("with x as (select score as s0, line_no as l0 from sim order by line_no limit 1) select line_no, score from sim, x where (score, line_no) >= (s0, l0) order by score desc, line_no desc limit 100", "sim")
def top_n_docs(spark, d):
    """Similarities written as text and read again."""
    path = new_path(spark, "similarity")
    relation(spark, d, "sim").select("line_no", F.lit("").alias("other"), "score").write.csv(path, header=True)
    return rank.top_n(source.similarity(spark, path), 100)


@query("select line_no, score from sim order by score desc, line_no desc limit 100", "sim")
def top_n_docs_repaired(spark, d):
    return rank.top_n(relation(spark, d, "sim"), 100, repaired=True)


@query("select doc_id, lang from documents where doc_id in (select line_no from sim order by score desc, line_no desc limit 100)", "sim")
def top_n_co_filter(spark, d):
    docs = relation(spark, d, "documents").select("doc_id", "lang")
    chosen = rank.top_n(relation(spark, d, "sim"), 100, repaired=True).withColumnRenamed("line_no", "doc_id")
    return rank.co_filter(docs, chosen, "doc_id")


@query("with r as (select *, row_number() over (order by score desc, line_no desc) as k from sim) select n::int as n, line_no, score from r, (select unnest([50, 100, 150]) as n) where k <= n", "sim")
def top_n_sweep(spark, d):
    return rank.sweep(relation(spark, d, "sim"), [50, 100, 150])


# texts

LITERALS = "select unnest(regexp_extract_all(value, '\"([^\"]+)\"{}', 1)) as literal from ldp_src"


@query(LITERALS.format(""), "ldp_src")
def rdf_extract(spark, d):
    return text.literals(relation(spark, d, "ldp_src"))


@query(LITERALS.format("@en"), "ldp_src")
def rdf_extract_tagged(spark, d):
    return text.literals(relation(spark, d, "ldp_src"), lang="en")


@query("select n_nationkey as line_no, concat('<n', n_nationkey, '> ', lower(n_name), '@en in ', lower(r_name), ' \"\"') as value from nation join region on n_regionkey = r_regionkey")
def ldp_merge(spark, d):
    return text.translate_literals(relation(spark, d, "ldp_src"), relation(spark, d, "ldp_dict"), ["line_no"])


SHOWN = r"""with w as (select *, regexp_split_to_array(regexp_replace(src, '\s+$', ''), '\s+') as h, regexp_split_to_array(regexp_replace({r}, '\s+$', ''), '\s+') as r from pairs)
select conv_id, turn, array_to_string(list_transform(h, lambda x: case when list_contains(list_transform(r, lambda y: {low}(y)), {low}(x)) then '*' || x || '*' else x end), ' ') || ' ||| ' || trg as shown from w"""


@query(SHOWN.format(r="src", low=""), "pairs")
def compare_translation(spark, d):
    return text.compared(relation(spark, d, "pairs"), "src", "trg").select(*SENTENCE, "shown")


@query(SHOWN.format(r="trg", low="lower"), "pairs")
def compare_translation_repaired(spark, d):
    return text.compared(relation(spark, d, "pairs"), "src", "trg", lower=True, repaired=True).select(*SENTENCE, "shown")


#: One table of cells a pair, by diagonals k: entry i + 1 of d is the cell (i, k - i).
EDIT = """with recursive w as (select conv_id, turn, list_reverse(string_split(src, ' ')) as a, list_reverse(string_split(trg, ' ')) as b from pairs),
e(conv_id, turn, a, b, k, d, c) as (select conv_id, turn, a, b, 0, [0::bigint], []::bigint[] from w
union all select conv_id, turn, a, b, k + 1, list_transform(range(0, len(a) + 1), lambda i: case when k + 1 - i < 0 or k + 1 - i > len(b) then null when i = 0 then k + 1 when k + 1 = i then i
  else least(case when i > 0 then c[i] end, case when i > 0 then d[i] end, d[i + 1]) + case when a[i] = b[k + 1 - i] then 0 else 1 end end), d from e where k < len(a) + len(b))"""


@query(EDIT + " select conv_id, turn, d[len(a) + 1]::int as edit from e where k = len(a) + len(b)", "pairs")
def edit_score(spark, d):
    return text.edit_scores(relation(spark, d, "pairs"), "src", "trg").select(*SENTENCE, "edit")


@query(EDIT + " select round(avg(d[len(a) + 1]), 9) as score from e where k = len(a) + len(b)", "pairs")
def word_error_rate(spark, d):
    return text.mean_edit_score(relation(spark, d, "pairs"), "src", "trg").select(F.round("score", 9).alias("score"))


# decomposition


def _words(spark, d):
    return relation(spark, d, "part").select(F.explode(F.split(F.regexp_replace("p_name", " ", "|"), "\\|")).alias("w")).distinct()


def _compounds(spark, d):
    names = relation(spark, d, "part").select(F.regexp_replace("p_name", " ", "").alias("word")).distinct()
    return names.union(_words(spark, d).toDF("word")), _words(spark, d).toDF("term")


@query(
    "with w as (select distinct replace(p_name, ' ', '') as word from part union select unnest(string_split(p_name, ' ')) from part), t as (select distinct unnest(string_split(p_name, ' ')) as term from part), i as (select word, lower(word) as low, unnest(range(1, length(word) - 1)) as i from w where length(word) > 2), s as (select word, substr(low, i, n) as term from (select *, unnest(range(2, length(low) - i + 2)) as n from i)) select distinct word, term from s where term in (select term from t)"
)
def filter_terms(spark, d):
    return decompose.filter_terms(*_compounds(spark, d))


#: Terms in words (as above, with their places), what may follow them, and from the end of each word the best parts from
#: each place on: b has the places in turn, the end first; places without parts have none.
BEST = r"""with recursive w as (select distinct replace(p_name, ' ', '') as word from part union select unnest(string_split(p_name, ' ')) from part),
t as (select distinct unnest(string_split(p_name, ' ')) as term from part),
i as (select word, lower(word) as low, unnest(range(1, length(word))) as i from w where length(word) > 2),
o1 as (select distinct word, low, i - 1 as pos, substr(low, i, n) as term from (select *, unnest(range(2, length(low) - i + 2)) as n from i) where term in (select term from t)),
o as (select * from o1 where (word, term) in (select (word, term) from o1 where pos <= length(low) - 3)),
p as (select *, pos + length(term) as one, substr(low, pos + length(term) + 1) as rest from o),
q as (select *, regexp_matches(rest, '^..?\b') as ends, case when ends then substr(rest, 1, case when regexp_matches(substr(rest, 2, 1), '\pL') then 2 else 1 end) else regexp_extract(rest, '^(s|e|en|er|n)', 1) end as extra from p),
e as (select word, pos, one, term, case when extra <> '' then one + length(extra) end as two, case when term || extra in (select x.term from o x where x.word = q.word) then term || extra else term end as longer from q),
r(word, n, k, b) as (select word, length(word), length(word), [[]::varchar[]] from w
union all select word, n, k - 1, list_append(b, min(case when c is not null then {'n': len(c), 'c': c} end).c) from
(select r.word, n, k, b, case when e.pos is null then null when b[n - one + 1] is not null then list_prepend(term, b[n - one + 1]) when b[n - two + 1] is not null then list_prepend(longer, b[n - two + 1]) end as c from r left join e on e.word = r.word and e.pos = k - 1 where k > 0) group by word, n, k, b),
best as (select word, coalesce(b[n + 1], []::varchar[]) as parts from r where k = 0)"""


@query(BEST + " select word, array_to_string(parts, ' ') as parts, len(parts)::int as n from best")
def decompose_best(spark, d):
    found = decompose.decompose_best(*_compounds(spark, d))
    return found.select("word", F.array_join("parts", " ").alias("parts"), F.size("parts").alias("n"))


@query(
    BEST
    + """, v as (select e.word, pos, case when b[n - one + 1] is not null then one else two end as to_, case when b[n - one + 1] is not null then term else longer end as part
from e join r on r.word = e.word and r.k = 0 where b[n - one + 1] is not null or b[n - two + 1] is not null),
s(word, pos, parts) as (select word, 0, []::varchar[] from w union select s.word, v.to_, list_append(parts, part) from s join v on v.word = s.word and v.pos = s.pos)
select word, row_number() over (partition by word order by len(parts), parts)::int as rank, 1.0::double / len(parts) as score, array_to_string(parts, ' ') as parts from s where pos = length(word) and len(parts) > 0"""
)
def decompose_ranked(spark, d):
    return decompose.decompose_ranked(*_compounds(spark, d)).withColumn("parts", F.array_join("parts", " "))


@query(
    BEST
    + """ select (select string_agg(case when len(parts) > 1 then array_to_string(parts, ' ') else x.word end, ' ' order by x.i) from (select unnest(string_split(q.name, ' ')) as word, generate_subscripts(string_split(q.name, ' '), 1) as i) x left join best on best.word = x.word) as value from (select replace(p_name, ' ', case when p_partkey % 2 = 0 then '' else ' ' end) as name from part) q"""
)
def decompose_lines(spark, d):
    """Names, every other one without its blanks."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    return decompose.decompose_lines(relation(spark, d, "part").select(name.alias("value")), _words(spark, d).toDF("term"))


@query("with w as (select distinct p_name, p_type from part) select p_name, p_type, upper(string_split(p_name, ' ')[1]) as part from w")
def recase_parts(spark, d):
    rows = relation(spark, d, "part").select("p_name", "p_type").distinct()
    return rows.withColumn("part", recase(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.upper("p_type")))


# streams, processes, compositions


@query(TOKENS, "lines")
def streaming_counts(spark, d):
    docs = relation(spark, d, "documents")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").parquet(*_folder(spark, d))
    tokens = stream.select(F.explode(F.split("text", "[\n ]")).alias("token"))
    return counter.snapshot(counter.running_counts(tokens, "token"))


def _folder(spark, d):
    """The documents as a folder or a glob, which a stream needs: a single file is named by a pattern."""
    return [f"{d}/documents.parque[t]"]


@query("select upper(n_name) as value from nation")
def process_pipe(spark, d):
    return workflow.pipe(relation(spark, d, "nation").select(F.col("n_name").alias("value")), ["tr", "a-z", "A-Z"])


@query(_extraction(1, PAIR_COUNTS.replace("from good", "from good where conv_id is not null")), "pairs", "links")
def phrase_count_pipeline(spark, d):
    """Extraction by shard of the corpus, then the merge of the shards' counts."""
    found = _found(spark, d)
    parts = [extract.pair_counts(found.filter(F.pmod("conv_id", F.lit(2)) == s)) for s in (0, 1)]
    return counts.merge_counts(*parts, keys=["foreign", "translation"])


@query(
    _merged(
        "select f, t, pft, lft, ptf, ltf from z where pft > 0 and round(c_both * case when len(string_split(f, ' ')) = 1 then ln(pft) + 25 else ln(pft) - ln(greatest(lft, 1e-9)) end, 6) > 20 and len(string_split(align, ' '))::double / greatest(len(string_split(f, ' ')), len(string_split(t, ' '))) >= 0.5",
        True,
    ),
    "pt_shards",
    "lex",
)
def model_merge_pipeline(spark, d):
    """Lexical merge, phrase table merge and entropy filter of the merged table."""
    merged = _rounded(merge.merge_phrase_tables(_shards(spark, d), *_lexicons(spark, d), repaired=True)).withColumn("lft", F.greatest("lft", F.lit(1e-9)))
    scored = merged.withColumn("e", F.round(filters.relative_entropy(20, F.col("pft"), F.col("lft"), F.col("c_both"), F.col("f")), 6))
    kept = scored.filter((F.col("e") > 20) & (filters.coverage(F.col("align"), F.col("f"), F.col("t")) >= 0.5))
    return kept.select("f", "t", "pft", F.when(F.col("lft") == 1e-9, F.lit(0.0)).otherwise(F.col("lft")).alias("lft"), "ptf", "ltf")
