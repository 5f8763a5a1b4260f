"""Proportional stratified interleaving into shards.

Within each source, rows are ranked in a seeded shuffle (the order of a digest of seed and id). A row's fractional
rank is its rank, plus a shift that its source alone decides, over its source's size; rows in order of fractional
rank interleave the sources in proportion, so any run of them, and thus each shard, holds the mixture. Shards are
runs of the whole order with counts at most one apart. No window ever sees a whole source or the whole table: ranks
are taken within (source, digest prefix) and within slices of the fractional rank, and sizes of the parts give
the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import written



def parts(rows: int, part_rows: int) -> tuple[int, int]:
    """Hexadecimal digits of a digest that cut ``rows`` into parts of ``part_rows`` at most, and slices that do."""
    digits = 0
    while rows > part_rows << 4 * digits:
        digits += 1
    return digits, max(1, -(-rows // part_rows))


def sharded(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", part_rows: int = 100_000) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) per row: row counts of shards differ by one at most.

    A window ranks about ``part_rows`` rows: a source and the whole order are cut into as many parts as the count of
    all rows asks for.

    Defined cases: a null text has size 1 and the checksum of no bytes; null sources are one source of their own; a
    null id ranks as the text "null"; rows repeating an id follow each other by checksum and size; an empty table
    gives an empty table; other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            name.alias("_name"),
            F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("_digest"),
        ),
        "rows",
    )
    digits, slices = parts(rows.count(), part_rows)
    rows = rows.withColumn("_part", F.substring("_digest", 1, digits))
    counted = rows.groupBy("_name", "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_name")
    sizes = counted.select("_name", "_part", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    ties = ["_digest", "text_crc32", "size"]
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_name"))), 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)
    ranked = (
        rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_name", "_part").orderBy(*ties)) - 1)
        .join(sizes, ["_name", "_part"])
        .withColumn("_place", ((F.col("_rank") + F.col("_before")).cast("double") + shift) / F.col("_all").cast("double"))
        .withColumn("_slice", F.floor(F.col("_place") * slices).cast("int"))
        .drop("_rank", "_before", "_all", "_part")
    )
    ranked = written(ranked, "ranked")
    each = ranked.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = each.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    placed = (
        ranked.withColumn("_in", F.row_number().over(Window.partitionBy("_slice").orderBy("_place", "_name", *ties)) - 1)
        .join(before, "_slice")  # a row a slice
        .withColumn("_at", F.col("_in") + F.col("_before"))
    )
    # shard k begins at k * total div shards
    shard = F.expr(f"((_at + 1) * {shards} - 1) div _total")
    return placed.withColumn("_shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), (F.col("_at") - F.expr(f"_shard * _total div {shards}")).alias("slot")
    )


#: The checksum is that of the text's bytes, one table step a byte.
ORACLE = """
with recursive steps(n, c, k) as (select n, n, 0 from (select unnest(range(0, 256))::bigint as n) union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by n) as t from steps where k = 8),
texts as (select doc_id, source, strlen(coalesce(text, '')) + 1 as size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as b from documents),
d as (select doc_id, size, coalesce('=' || source, 'null') as name, md5('42:' || coalesce(doc_id::varchar, 'null')) as digest,
             xor(list_reduce(list_transform(b, lambda x: ('0x' || x)::bigint), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295) as text_crc32 from texts, crc),
r as (select *, row_number() over (partition by name order by digest, text_crc32, size) - 1 as rnk, count(*) over (partition by name) as n from d),
p as (select *, (rnk::double + ('0x' || substr(md5('42:' || name), 1, 8))::bigint::double / 4294967296.0) / n::double as place from r),
o as (select *, row_number() over (order by place, name, digest, text_crc32, size) - 1 as pos, count(*) over () as total from p),
s as (select *, ((pos + 1) * 16 - 1) // total as shard from o)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, shard::int as shard, (pos - shard * total // 16)::bigint as slot, null::int as grown_shard from s
"""
