"""Line-oriented sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.shared import written

#: Digits of a chunk's name, so that names are in the order of chunks.
DIGITS = 10


def lines(spark: SparkSession, *paths: str, numbered: bool = True, end: str | None = None) -> DataFrame:
    """(value[, line_no, file]) of text files; ``.gz`` and ``.bz2`` are read by their suffix, line numbers are from 0 per file.

    Numbers follow block starts and then the order within a block, since splits are not read in file order. ``end``: what
    ends a line, where not any of the usual line ends does.
    """
    text = spark.read.text(list(paths), lineSep=end)
    if not numbered:
        return text
    found = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    # blocks are counted apart, so that no task sees a whole file
    inner = Window.partitionBy("file", "at").orderBy("id")
    sizes = found.groupBy("file", "at").agg(F.count("*").alias("n"))
    base = sizes.select("file", "at", (F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")).alias("base"))
    return found.withColumn("row", F.row_number().over(inner)).join(base, ["file", "at"]).select("value", (F.col("base") + F.col("row") - 1).alias("line_no"), "file")


def cat(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, with ``ord`` naming the part that a row came from."""
    return reduce(DataFrame.unionByName, [p.withColumn("ord", F.lit(i)) for i, p in enumerate(parts)])


def find(spark: SparkSession, root: str, glob: str = "*", wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, length) of the files below a folder; contents are not read.

    With ``wanted``, a condition on paths: the uppermost folders that meet it, with the sum of their files' lengths,
    in place of all below them, and the files that meet it elsewhere. A folder without files is not seen.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    if wanted is None:
        return files
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(root)
    top = where.getFileSystem(conf).makeQualified(where).toString().rstrip("/")
    # the root itself, then each longer prefix of the path that ends before a slash, and the path
    below = F.split(F.substring(F.col("path"), F.instr("path", where.toUri().getPath()) + len(where.toUri().getPath().rstrip("/")), F.length("path")), "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(below)), lambda n: F.concat(F.lit(top), F.array_join(F.slice(below, 1, n), "/")))
    first = F.get(F.filter(steps, wanted), F.lit(0))
    return files.select(first.alias("path"), "length").filter("path is not null").groupBy("path").agg(F.sum("length").alias("length"))


def zip_lines(left: DataFrame, right: DataFrame, on: Sequence[str] = ("line_no",)) -> DataFrame:
    """Rows of both sides at the same place; the shorter side ends it."""
    return left.join(right, list(on))


def chunk(line_no: Column, size: int) -> Column:
    """Number, from 1, of the part of ``size`` lines that a line is in."""
    return (F.floor(line_no / F.lit(size)) + 1).cast("long")


def numbered(df: DataFrame, *order: str, name: str = "line_no") -> DataFrame:
    """``df`` with numbers from 0 in the order of some columns, without gaps.

    Rows are dealt by ranges and sorted there, and written once with their place in their part; the parts' sizes, as
    many as Spark has partitions, say where each begins. No task sees all rows.
    """
    placed = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))  # a row for each partition
    return placed.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + row).drop("_id", "_part", "_begin")


def write_lines(df: DataFrame, path: str, column: str = "value", compression: str = "none", append: bool = False, order: Sequence[str] = ()) -> None:
    """Writes one column as text files, whole (``append``: beside what is there). With ``order``, the files in the order
    of their names hold the lines in the order of those columns."""
    rows = df.orderBy(*order) if order else df
    rows.select(column).write.mode("append" if append else "overwrite").option("compression", compression).text(path)


#: How a suffix of an output's path is compressed (fixed values).
COMPRESSION = {".gz": "gzip", ".bz2": "bzip2"}


def put(df: DataFrame, path: str | None = None, column: str = "value", order: Sequence[str] = ()) -> None:
    """Lines to a path, compressed as its suffix says, or without a path to standard output, a partition at a time."""
    if path is not None:
        write_lines(df, path, column, next((v for k, v in COMPRESSION.items() if path.endswith(k)), "none"), order=order)
        return
    for row in (df.orderBy(*order) if order else df).select(column).toLocalIterator():
        print(row[0])


def write_chunks(df: DataFrame, path: str, size: int, column: str = "value", line_no: str = "line_no") -> None:
    """A folder for each chunk of ``size`` lines, with one file of them in order; folders are named in the order of chunks.

    Lines are dealt by ranges of chunks, so that each is written by one task, and sorted there. No lines at all give the
    first chunk, empty.
    """
    name = F.lpad(chunk(F.col(line_no), size).cast("string"), DIGITS, "0")
    rows = df.select(name.alias("chunk"), F.col(line_no).alias("_line"), F.col(column).alias("value"))
    if rows.isEmpty():
        write_lines(df, f"{path}/chunk={'1'.rjust(DIGITS, '0')}", column)
        return
    rows.repartitionByRange("chunk").sortWithinPartitions("chunk", "_line").select("chunk", "value").write.mode("overwrite").partitionBy("chunk").text(path)


def read_chunks(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """(chunk, line_no, value) of what ``write_chunks`` wrote; lines are numbered within their chunk."""
    found = lines(spark, f"{path}/chunk=*", end=end)
    return found.select(F.regexp_extract("file", "/chunk=(\\d+)/[^/]*$", 1).cast("long").alias("chunk"), "line_no", "value")


def terms(df: DataFrame, column: str = "value") -> DataFrame:
    """A term base (term): trimmed, without blanks, each once."""
    return df.select(F.trim(F.col(column)).alias("term")).filter("term <> ''").distinct()


def jdbc_terms(spark: SparkSession, url: str, table: str, column: str, parts: Sequence[str] | None = None, **options: str) -> DataFrame:
    """A term base from a database column, read in one task, or in one for each of the conditions in ``parts``."""
    read = spark.read.jdbc(url, table, properties=options) if parts is None else spark.read.jdbc(url, table, predicates=list(parts), properties=options)
    return read.select(F.col(column).alias("term"))


#: Keys of one lookup in a database, and keys that are looked up; of more, the whole column is read instead.
ASKED, MOST_ASKED = 500, 50_000


def jdbc_lookup(spark: SparkSession, url: str, table: str, column: str, words: DataFrame, parts: Sequence[str] | None = None, **options: str) -> DataFrame:
    """(term): the different words (first column of ``words``) that a database column has.

    Up to MOST_ASKED words are sent to the database in conditions of ASKED each, a task and an index lookup for each, so
    that only rows of these words are read. Of more words, too many to name, the column is read as by ``jdbc_terms``
    (in ``parts``) and joined in Spark.
    """
    asked = words.select(F.col(words.columns[0]).cast("string").alias("term")).filter("term is not null").distinct()
    named = [r.term for r in asked.limit(MOST_ASKED + 1).collect()]
    if len(named) > MOST_ASKED:
        return jdbc_terms(spark, url, table, column, parts, **options).distinct().join(asked, "term", "left_semi")
    dialect = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    name = dialect.quoteIdentifier(column)
    lists = [", ".join("'" + w.replace("'", "''") + "'" for w in named[at : at + ASKED]) for at in range(0, len(named), ASKED)]
    found = jdbc_terms(spark, url, table, column, [f"{name} IN ({x})" for x in lists] or ["1 = 0"], **options)
    # what a database takes for equal, as without regard to case, Spark does not
    return found.distinct().join(asked, "term", "left_semi")


def similarity(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, score) of a CSV file with a header and three columns, of which the second is not used."""
    return spark.read.csv(path, header=True, schema="line_no long, other string, score double", mode="FAILFAST").select("line_no", "score")


def arpa(df: DataFrame, column: str = "value") -> DataFrame:
    """(logp, ngram, backoff, raw) of language model lines: two or three fields between tabs; others only have ``raw``."""
    parts = F.split(F.regexp_replace(F.col(column), "\\t+$", ""), "\\t")
    entry = F.size(parts).isin(2, 3) & F.get(parts, F.lit(0)).try_cast("double").isNotNull()
    return df.select(
        "*",
        F.when(entry, F.get(parts, F.lit(0)).try_cast("double")).alias("logp"),
        F.when(entry, F.get(parts, F.lit(1))).alias("ngram"),
        F.when(entry & (F.size(parts) == 3), F.get(parts, F.lit(2)).try_cast("double")).alias("backoff"),
        F.trim(F.col(column)).alias("raw"),
    )


def from_section(df: DataFrame, header: str, column: str = "value", line_no: str = "line_no") -> DataFrame:
    """The lines from the first one that equals ``header`` on."""
    first = df.filter(F.col(column) == header).agg(F.min(line_no).alias("_first"))  # one row
    return df.join(F.broadcast(first), F.col(line_no) >= F.col("_first")).drop("_first")


def tagged(df: DataFrame, tag: str, column: str = "value") -> DataFrame:
    """The content of an element on the lines that hold one."""
    return df.filter(F.col(column).contains(f"<{tag}>")).withColumn(column, F.regexp_extract(column, f"<{tag}>(.*?)</{tag}>", 1))
