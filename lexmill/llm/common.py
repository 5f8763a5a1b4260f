"""What the training-data operators share: the shared folder, written tables, text columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The temporary folder of a local session that names none.
_own: list[str] = []
#: Rows of a key beyond which ``salted_join`` splits it, and keys that it may broadcast as split ones.
HOT_ROWS, HOT_KEYS = 100_000, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session in one process may do without naming one; a cluster not."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("the session must name a folder that its executors share in spark.checkpoint.dir")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='lexmill-')}")
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing needs any more, and lets Spark drop finished shuffles."""
    removed_tables(*tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed_tables(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing needs any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            removed(table.sparkSession, folder)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII strings, the common case, take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_text(df: DataFrame, text: Column, text_col: str = "text") -> DataFrame:
    """``df`` with its text replaced, and ``n_chars`` (if there is one) following it."""
    out = df.withColumn(text_col, text)
    return out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, spread: list[str], hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with the written ``table``, which has each key once, and in ``count`` how many rows have it.

    A small table is broadcast by Spark, whatever the keys. Else a key of over ``hot`` rows is dealt by a hash of
    ``spread`` over as many parts as it needs, and its row of the table is copied into each; such keys are few, as
    each stands for ``hot`` rows, and are marked by a broadcast of at most HOT_KEYS of them (``hot`` grows, if need be).
    """
    while (split := table.filter(F.col(count) > hot)).count() > HOT_KEYS:
        hot *= 4
    parts = F.ceil(F.col(count) / hot).cast("int")
    marked = rows.join(F.broadcast(split.select(*keys, parts.alias("_lexmill_parts"))), keys, "left")
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_lexmill_parts")), F.lit(0)).cast("int")
    copies = table.withColumn("_lexmill_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
    return marked.withColumn("_lexmill_salt", salt).join(copies, [*keys, "_lexmill_salt"]).drop("_lexmill_parts", "_lexmill_salt", count)


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Batches, which Spark keeps to spark.sql.execution.arrow.maxBytesPerBatch, in parts of so many rows."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)
