"""Line dedup with DataFrame functions only.

Lines are exploded with their position and reduced to a 128-bit hash of their normalised key, once, into a table of
hashes and positions. Distinct documents are counted per hash (map-side combined, so that a line in a third of all
documents costs one row a document); hot hashes are joined back to (document, position) pairs, a small table of them
by broadcast, a large one by shuffle with the commonest lines split over many tasks; and each text is reassembled
from the positions that stay. The texts move once, in the join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower, salted_join, with_text, written

#: The characters that a key loses at both ends (fixed values of the contract: 0x20 and 0x09 to 0x0D).
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without outer blanks, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drops lines that many documents share, except in the largest id holding them.

    Returns the columns of ``docs`` (``text`` without the dropped lines) plus ``n_lines`` and ``n_dropped``; columns
    of these names are replaced. Defined cases: a null text counts as empty, an empty text is one empty line; rows
    with a null id hold no place in the counts and keep all lines; rows repeating an id count as one document;
    an empty table gives an empty table.
    """
    own = docs.drop("n_lines", "n_dropped")
    own = own.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    mark = F.xxhash64(F.lit(7), F.col(text_col))
    lines = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .filter(F.col("_id").isNotNull() & (F.length("_text") >= min_chars))
        .select("_id", F.xxhash64(F.lit(7), F.col("_text")).alias("_mark"), F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
        .select("_id", "_mark", "_pos", line_key(F.col("_line")).alias("_key"))
        .filter(F.length("_key") >= min_chars)
        .select("_id", "_mark", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"))
    )
    lines = written(lines, "lines")
    a_document = lines.groupBy("_h1", "_h2", "_id").agg(F.count("*").alias("_rows"))
    hot = a_document.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.sum("_rows").alias("_rows"), F.max("_id").alias("_keep"))
    hot = written(hot.filter(F.col("_n") >= min_docs).drop("_n"), "hot-lines")
    held = salted_join(lines, hot, ["_h1", "_h2"], "_rows", ["_id", "_pos"])
    dropped = held.filter(F.col("_id") != F.col("_keep")).groupBy("_id", "_mark").agg(F.collect_set("_pos").alias("_gone"))
    joined = own.withColumn("_lexmill_mark", mark).join(dropped.toDF("_lexmill_of", "_lexmill_m", "_lexmill_gone"), (F.col(id_col) == F.col("_lexmill_of")) & (F.col("_lexmill_mark") == F.col("_lexmill_m")), "left")
    parts = F.split(text_col, "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_lexmill_gone"))
    kept = F.when(F.col("_lexmill_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n"))
    counted = joined.withColumn("n_lines", F.size(parts).cast("long")).withColumn("n_dropped", F.when(F.col("_lexmill_gone").isNull(), 0).otherwise(F.size("_lexmill_gone")).cast("long"))
    return with_text(counted, kept, text_col).drop("_lexmill_mark", "_lexmill_of", "_lexmill_m", "_lexmill_gone")


ORACLE = r"""
with lines as (
  select doc_id, i - 1 as pos, l as line,
         translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
hot as (select k, max(doc_id) as keep from lines where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select l.doc_id, l.pos, l.line, (h.k is not null and l.doc_id <> h.keep) as gone from lines l left join hot h on l.k = h.k)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
