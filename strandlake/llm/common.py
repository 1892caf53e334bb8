"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, for Java, Spark and DuckDB regular expressions. ``bytes.split()`` cuts at the same bytes.
WORD = "[^\\x20\\x09-\\x0D]+"


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, whatever their case: what an operator adds takes their place."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """``batch`` cut so that ``column`` (string or binary) holds about ``most`` bytes in each part.

    A single longer value makes a part of its own.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield batch.slice(start)


#: Largest Arrow batch of texts that a Python worker gets; a single longer row is a batch of its own.
BATCH_BYTES = 8 * 1024 * 1024


def map_texts(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` in batches that stay small however long the texts are.

    Spark takes the size from the session when the plan runs, so the session's own setting is lowered
    if it is larger. Executors may hold several Python workers at once, each with a batch of its own.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(task, schema)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a master in one process, as in tests, may leave it unset (``/tmp/checkpoints``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return folder


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, its lineage cut; for many rows, of which later steps read some columns.

    The table goes when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a frame as a table and reads it again; these tables go when the block ends.

    For loops. A checkpointed frame keeps the size that was estimated for its plan. Joins multiply the sizes of their sides, so in a
    loop that joins what it made before, these estimates come to have millions of digits, and planning takes longer than
    the work. A written table's size is that of its files, by which Spark also decides what it broadcasts.
    """
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def put(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield put
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def near(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df``, marked to be broadcast if it has at most ``limit`` (narrow) rows; else joined by a shuffle.

    For a written or otherwise cheap ``df``: its rows are counted.
    """
    return F.broadcast(df.coalesce(8)) if df.limit(limit + 1).count() <= limit else df
