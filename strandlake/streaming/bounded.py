"""Bounded frames as streams of several micro-batches, and streams run to their end: for backfills, queries and tests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How the store packs its files: by zstd, if the session doesn't say otherwise (Spark's default is lz4).
PACKED = "spark.sql.streaming.stateStore.rocksdb.compression"
BATCH = "batch"


def _folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the shared one; it goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


class Feed:
    """A bounded frame that a stream gets piece by piece: the rows with ``number`` 0 first, then 1, and so on.

    The frame is written once, in as many tasks as it has partitions; a piece is handed over by renaming its folder, so it is
    one micro-batch whatever its number of files.
    """

    def __init__(self, df: DataFrame, number: Column):
        self.spark, self.staged, self.path = df.sparkSession, _folder(df.sparkSession, "staged"), _folder(df.sparkSession, "stream")
        df.withColumn("__batch", number.cast("int")).write.partitionBy("__batch").parquet(self.staged)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path(self.path))
        #: The streaming frame.
        self.frame = self.spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(self.path)

    def push(self, i: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        piece = path(f"{self.staged}/__batch={i}")
        if self._fs.exists(piece):
            self._fs.rename(piece, path(f"{self.path}/{i}"))


def run(df: DataFrame, *feeds: Feed, batches: int = 1, checkpoint: str | None = None) -> DataFrame:
    """All rows that a streaming frame gives, as a bounded frame, with the number of the piece that gave them as ``batch``.

    The query is run to the end of its sources after each of the ``batches`` pieces of its feeds, from one checkpoint; so each run also
    takes up the state that the one before left.
    """
    spark = df.sparkSession
    path, progress = _folder(spark, "results"), checkpoint or _folder(spark, "progress")
    had, packed = spark.conf.get(PROVIDER), spark.conf.get(PACKED, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(PACKED, packed or "zstd")
    try:
        for i in range(batches):
            for feed in feeds:
                feed.push(i)

            def put(rows: DataFrame, number: int, i: int = i) -> None:
                rows.withColumn(BATCH, F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{path}/{i}-{number}")

            df.writeStream.outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
            spark._jvm.System.gc()  # lets Spark remove the batch's shuffle files
    finally:
        spark.conf.set(PROVIDER, had)
        if packed is None:
            spark.conf.unset(PACKED)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    schema = df.withColumn(BATCH, F.lit(0).cast("long")).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
