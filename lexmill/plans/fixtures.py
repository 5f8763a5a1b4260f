"""Inputs that the queries derive from the driver tables, as SQL for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()

#: name: (SQL, or (Spark SQL, DuckDB SQL)); later ones use earlier ones.
RELATIONS: dict[str, str | tuple[str, str]] = {
    "lines": (
        "select doc_id, pos as line_no, value from documents lateral view posexplode(split(text, '\\n')) x as pos, value",
        "select doc_id, i - 1 as line_no, v as value from (select doc_id, unnest(string_split(text, chr(10))) v, generate_subscripts(string_split(text, chr(10)), 1) i from documents)",
    ),
    "pairs": (
        "select u.conv_id, u.turn, replace(u.text, '\\n', ' ') as src, replace(a.text, '\\n', ' ') as trg from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'",
        "select u.conv_id, u.turn, replace(u.text, chr(10), ' ') as src, replace(a.text, chr(10), ' ') as trg from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'",
    ),
    "links": (
        "select conv_id, turn, p as l, p + d as r from (select conv_id, turn, size(split(src, ' ')) n, size(split(trg, ' ')) m, explode(sequence(0, size(split(src, ' ')) - 1)) p from pairs) lateral view explode(array(0, 1)) y as d where p < n and p + d < m and ((d = 0 and p % 4 <> 3) or (d = 1 and p % 5 = 0))",
        "select conv_id, turn, p as l, p + d as r from (select conv_id, turn, len(string_split(src, ' ')) n, len(string_split(trg, ' ')) m, unnest(range(0, len(string_split(src, ' ')))) p from pairs), (select unnest([0, 1]) d) where p < n and p + d < m and ((d = 0 and p % 4 <> 3) or (d = 1 and p % 5 = 0))",
    ),
    "pt_base": "select l_suppkey % 4 as shard, case when l_linenumber % 2 = 0 then split_part(p_name, ' ', 1) else p_name end as f, case when l_returnflag = 'A' then lower(p_type) else concat(lower(p_type), ' ', lower(l_returnflag)) end as t, count(*) as c_both from lineitem join part on l_partkey = p_partkey group by 1, 2, 3",
    "pt_shards": "select shard, f, t, cast(sum(c_both) over (partition by shard, t) as bigint) as c_first, cast(sum(c_both) over (partition by shard, f) as bigint) as c_second, c_both, cast(1 + c_both % 7 as double) / 10 as lft, cast(1 + c_both % 5 as double) / 10 as ltf, case when f like '% %' and t like '% %' then '0-0 1-1' else '0-0' end as align from pt_base",
    "lex": (
        "select shard, w1, w2, cast(sum(c_both) as double) / cast(sum(sum(c_both)) over (partition by shard, w2) as double) / 5 as p from (select shard, w1, explode(split(t, ' ')) w2, c_both from (select shard, t, c_both, explode(split(f, ' ')) w1 from pt_base)) group by shard, w1, w2",
        "select shard, w1, w2, cast(sum(c_both) as double) / cast(sum(sum(c_both)) over (partition by shard, w2) as double) / 5 as p from (select shard, w1, unnest(string_split(t, ' ')) w2, c_both from (select shard, t, c_both, unnest(string_split(f, ' ')) w1 from pt_base)) group by shard, w1, w2",
    ),
    # linked words of sentence pairs, some with the word after the second one
    "pt_words": (
        "select f, t, c_both, cast(sum(c_both) over (partition by t) as bigint) as c_first, cast(sum(c_both) over (partition by f) as bigint) as c_second from (select f, t, count(*) as c_both from (select get(split(src, ' '), l) as f, case when l % 7 = 0 then concat(get(split(trg, ' '), r), ' ', coalesce(get(split(trg, ' '), r + 1), '.')) else get(split(trg, ' '), r) end as t from pairs p join links k on p.conv_id = k.conv_id and p.turn = k.turn) where f <> '' and t <> '' group by f, t)",
        "select f, t, c_both, cast(sum(c_both) over (partition by t) as bigint) as c_first, cast(sum(c_both) over (partition by f) as bigint) as c_second from (select f, t, count(*) as c_both from (select string_split(src, ' ')[l + 1] as f, case when l % 7 = 0 then concat(string_split(trg, ' ')[r + 1], ' ', coalesce(string_split(trg, ' ')[r + 2], '.')) else string_split(trg, ' ')[r + 1] end as t from pairs p join links k on p.conv_id = k.conv_id and p.turn = k.turn) where f <> '' and t <> '' group by f, t)",
    ),
    "rot": "select shard, f, t, c_both % 3 as s1, c_both % 5 as s2, c_both % 7 as s3 from pt_base",
    "sim": "select doc_id as line_no, cast(n_chars % 1000 as double) / 1000 as score from documents",
    "arpa": "select c_custkey as line_no, c_acctbal / 1000.0 - 5.0 as logp, c_name as ngram, case when c_nationkey % 3 = 0 then null else cast(c_nationkey as double) / (-10) end as backoff from customer",
    "ldp_src": "select n_nationkey as line_no, concat('<n', n_nationkey, '> \"', n_name, '\"@en in \"', r_name, '\" \"\"') as value from nation join region on n_regionkey = r_regionkey",
    "ldp_dict": "select n_name as label, concat(lower(n_name), '@DE') as translation from nation union all select r_name, concat(lower(r_name), '@deu') from region",
}
NEEDS = {"links": ["pairs"], "pt_words": ["pairs", "links"], "pt_shards": ["pt_base"], "lex": ["pt_base"], "rot": ["pt_base"]}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived relation of a directory."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for needed in NEEDS.get(name, []):
        relation(spark, sf_dir, needed).createOrReplaceTempView(needed)
    text = RELATIONS[name] if isinstance(RELATIONS[name], str) else RELATIONS[name][0]
    for table in TABLES:
        if table in text.replace("(", " ").replace(")", " ").split():
            relation(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(text)


def duck(query: str, *names: str) -> str:
    """DuckDB SQL: ``query`` over the named relations as common table expressions."""
    wanted = [n for n in RELATIONS if n in names or any(n in NEEDS.get(x, []) for x in names)]
    parts = [f"{n} as ({RELATIONS[n] if isinstance(RELATIONS[n], str) else RELATIONS[n][1]})" for n in wanted]
    head = ", ".join(parts)
    query = query.strip()
    if query.lower().startswith("with recursive "):
        return f"with recursive {head}, {query[15:]}" if head else query
    if query.lower().startswith("with "):
        return f"with {head}, {query[5:]}" if head else query
    return f"with {head} {query}" if head else query
