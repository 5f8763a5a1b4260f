"""A running counter over a stream, the incremental form of ``count_keys``.

Counts are kept in a table of buckets by a hash of the key. Each batch counts its own rows and adds them to the buckets
that it touches; only these are written anew, in a folder of the batch. A manifest for each batch names the folder that
each bucket is in, so that a reader sees a batch whole or not at all, and a batch that is run again starts from the
manifest before it and changes nothing. Nothing of the counts is held between batches, in executors or the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.shared import file_system, new_path, removed

#: Manifests that stay, so that a reader of the one before the last still finds its buckets.
KEPT = 2


@dataclass(frozen=True)
class RunningCounts:
    """A stream's counts per key, in ``buckets`` parts of a table at ``path``."""

    stream: DataFrame
    keys: tuple[str, ...]
    name: str
    buckets: int
    path: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*(self.stream.schema[k] for k in self.keys), T.StructField(self.name, T.LongType())])

    def counted(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.count("*").alias(self.name))

    def add(self, batch: DataFrame, number: int) -> None:
        """Adds a batch to the buckets that it touches."""
        spark = batch.sparkSession
        places = manifest(spark, self.path, number - 1)
        folder = f"{self.path}/batch={number}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        new = self.counted(batch).select("*", bucket).persist()
        try:
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # numbers of buckets
            old = [f"{places[k]}/bucket={k}" for k in touched if k in places]
            rows = new
            if old:
                rows = new.unionByName(spark.read.schema(self.schema).parquet(*old).select("*", bucket))
            total = rows.groupBy("bucket", *self.keys).agg(F.sum(self.name).alias(self.name))
            total.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        finally:
            new.unpersist()
        published(spark, self.path, number, places | dict.fromkeys(touched, folder))
        old_places = set(places.values())
        before = set(manifest(spark, self.path, number - KEPT + 1).values()) if number >= KEPT else old_places
        for gone in set(manifest(spark, self.path, number - KEPT).values()) - before - old_places:
            removed(spark, gone)

    def start(self):
        """The streaming query; it may be stopped, lost and started again."""
        return self.stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()

    def table(self) -> DataFrame:
        """The counts of the last batch that is whole."""
        spark: SparkSession = self.stream.sparkSession
        numbers = [n for n in manifests(spark, self.path)]
        places = manifest(spark, self.path, max(numbers)) if numbers else {}
        folders = [f"{folder}/bucket={k}" for k, folder in places.items()]
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)


def manifests(spark: SparkSession, path: str) -> list[int]:
    files, where = file_system(spark, f"{path}/manifests")
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, number: int) -> dict[int, str]:
    """The folder of each bucket after a batch; before the first one there is none."""
    files, where = file_system(spark, f"{path}/manifests/{number}")
    if number < 0 or not files.exists(where):
        return {}
    stream = files.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(k): f"{path}/{folder}" for k, folder in (line.split("\t") for line in text.splitlines())}


def published(spark: SparkSession, path: str, number: int, places: dict[int, str]) -> None:
    """Writes a manifest beside its place and moves it there, in one step."""
    files, whole = file_system(spark, f"{path}/manifests/{number}")
    _, part = file_system(spark, f"{path}/manifests/{number}.part")
    out = files.create(part, True)
    try:
        out.write(bytearray("".join(f"{k}\t{folder.removeprefix(f'{path}/')}\n" for k, folder in sorted(places.items())).encode()))
    finally:
        out.close()
    files.delete(whole, False)
    files.rename(part, whole)


def running_counts(stream: DataFrame, *keys: str, name: str = "n", buckets: int = 64, path: str | None = None) -> RunningCounts:
    """Counts per key of all rows so far. ``path``: the folder of the table, by default a new one in the shared folder."""
    return RunningCounts(stream, keys, name, buckets, path or new_path(stream.sparkSession, "counts"))


def snapshot(counts: RunningCounts) -> DataFrame:
    """Runs a stream over what its source holds now and returns the table of its counts."""
    counts.start().awaitTermination()
    return counts.table()
