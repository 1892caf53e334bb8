"""Running a topology: bounded reads, micro-batches, streams; delivery, error policies and metrics."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LakeError, RetriableError
from ..plans.storage import shared_folder
from ..plans.topology import BuiltTopology
from ..records import HEADER_TYPE, no_headers
from ..sources import kafka

#: Prefix of the headers that a dead letter gets.
PREFIX = "strandlake.error."

Sink = Callable[[str, DataFrame, int], None]


class ErrorPolicy(Enum):
    """What happens to a partition's batch that fails: the run fails, the batch is skipped, or its records go to a dead-letter topic."""

    FAIL = "fail"
    SKIP = "skip"
    DEAD_LETTER = "dead_letter"


@dataclass
class Metrics:
    """Totals of a runner."""

    batches: int = 0
    input: int = 0
    output: int = 0
    failures: int = 0
    dead_letters: int = 0
    nanos: int = 0


def with_defaults(settings: Mapping[str, str], **defaults: str) -> dict[str, str]:
    """``settings`` with the engine's defaults for streams, and ``defaults``, where they say nothing."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    return {**fixed, **defaults, **settings}


def memory_sink(store: dict[str, list]) -> Sink:
    """A sink that keeps rows on the driver, for tests."""
    return lambda topic, df, batch: store.setdefault(topic, []).extend(df.collect())


def parquet_sink(path: str) -> Sink:
    """A folder for each topic and in it one for each batch number: a batch that runs again replaces itself, so delivery is exactly once."""
    return lambda topic, df, batch: df.write.mode("overwrite").parquet(f"{path}/{topic}/batch={batch}")


def kafka_sink(**options: str) -> Sink:
    """Appends to Kafka topics (the connector must be on the class path), as :func:`..sources.kafka.records` says; at least once."""

    def send(topic: str, df: DataFrame, batch: int) -> None:
        kafka.records(df, topic).write.format("kafka").options(**options).save()

    return send


@dataclass
class Runner:
    """Feeds batches to a built topology and its outputs to a sink.

    A batch is all or nothing for each logical partition: if it fails, each partition is tried by
    itself on the state before the batch, and the policy decides on those that fail again.
    Retriable errors are always raised. ``state_path`` (in a shared folder) holds the state after each
    batch; :meth:`resume` takes up the last complete one, so a batch that is delivered again with its
    number does not count twice.
    """

    topology: BuiltTopology
    sink: Sink
    policy: ErrorPolicy = ErrorPolicy.FAIL
    dead_letter_topic: str = "dead-letters"
    state_path: str | None = None
    metrics: Metrics = field(default_factory=Metrics)
    last: int = -1

    def run(self, raw: Mapping[str, DataFrame], batch: int | None = None) -> None:
        """One batch of raw records by topic."""
        number = self.last + 1 if batch is None else batch
        if number <= self.last:
            return  # it was completed before
        began = time.monotonic_ns()
        raw = {t: df.persist() for t, df in raw.items()}
        try:
            n_in = sum(df.count() for df in raw.values())
            if n_in == 0:
                self.last = number
                return
            before = {n: dict(s) for n, s in self.topology.state.items()}
            try:
                self._evaluate(raw, number)
            except Exception as e:
                self.topology.state = before
                self._after_failure(raw, number, e, before)
            self.metrics.batches += 1
            self.metrics.input += n_in
            self.last = number
            self._save(next(iter(raw.values())).sparkSession)
        finally:
            for df in raw.values():
                df.unpersist()
            self.metrics.nanos += time.monotonic_ns() - began

    def _evaluate(self, raw: Mapping[str, DataFrame], number: int) -> None:
        outputs = {t: df.persist() for t, df in self.topology.run_batches(raw).items()}
        try:
            counts = {t: df.count() for t, df in outputs.items()}  # everything is computed before anything is sent
            for topic, df in outputs.items():
                self.sink(topic, df, number)
            self.metrics.output += sum(counts.values())
        finally:
            for df in outputs.values():
                df.unpersist()

    def _after_failure(self, raw: Mapping[str, DataFrame], number: int, error: Exception, before: dict) -> None:
        self.metrics.failures += 1
        if _retriable(error) or self.policy is ErrorPolicy.FAIL:
            raise error
        partitions = sorted({r[0] for df in raw.values() for r in df.select("partition").distinct().collect()}, key=lambda p: (p is None, p))
        good, bad = [], {}
        for p in partitions:  # a topic's partitions, which are few
            one = {t: df.filter(F.col("partition").eqNullSafe(F.lit(p))) for t, df in raw.items()}
            try:
                for df in self.topology.run_batches(one).values():
                    df.write.format("noop").mode("overwrite").save()
                good.append(p)
            except Exception as e:
                if _retriable(e):
                    raise
                bad[p] = e
            finally:
                self.topology.state = {n: dict(s) for n, s in before.items()}
        if good:
            chosen = F.col("partition").isin([p for p in good if p is not None]) | (F.col("partition").isNull() if None in good else F.lit(False))
            self._evaluate({t: df.filter(chosen) for t, df in raw.items()}, number)
        if self.policy is ErrorPolicy.DEAD_LETTER and bad:
            letters = None
            for p, e in bad.items():
                for topic, df in raw.items():
                    part = dead_letters(df.filter(F.col("partition").eqNullSafe(F.lit(p))), topic, e)
                    letters = part if letters is None else letters.union(part)
            self.metrics.dead_letters += letters.count()
            self.sink(self.dead_letter_topic, letters, number)

    def _save(self, spark: SparkSession) -> None:
        if self.state_path is None:
            return
        at = f"{self.state_path}/{self.last}"
        self.topology.snapshot(at)
        done = json.dumps({"batch": self.last, "parts": self.topology.parts()})
        # The marker is written last: a snapshot without one does not count.
        spark.createDataFrame([(done,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/_complete")

    def resume(self, spark: SparkSession, batch: int) -> None:
        """Takes up the state after ``batch``."""
        done = json.loads(spark.read.text(f"{self.state_path}/{batch}/_complete").head()[0])
        self.topology.restore(spark, f"{self.state_path}/{batch}", done["parts"])
        self.last = done["batch"]

    def stream(self, sources: Mapping[str, DataFrame], checkpoint: str | None = None, once: bool = True):
        """A streaming query over raw streaming frames by topic (schema ``RAW``), exact micro-batch by micro-batch.

        All topics go through one ``foreachBatch``, so co-partitioned topics see the same batch. With ``once``
        it handles what is there and ends (at least once; with :func:`parquet_sink` exactly once).
        """
        tagged = None
        for topic, df in sources.items():
            part = df.select(F.lit(topic).alias("__topic"), "key", "value", "timestamp", "partition", "offset", "headers")
            tagged = part if tagged is None else tagged.unionByName(part)
        if tagged is None:
            raise LakeError("a stream needs a topic")

        def each(df: DataFrame, number: int) -> None:
            self.run({t: df.filter(F.col("__topic") == t).drop("__topic") for t in sources}, number)

        where = checkpoint or f"{shared_folder(tagged.sparkSession)}/stream-{uuid.uuid4().hex}"
        writer = tagged.writeStream.foreachBatch(each).option("checkpointLocation", where)
        return (writer.trigger(availableNow=True) if once else writer).start()


def _retriable(error: BaseException) -> bool:
    return isinstance(error, RetriableError) or "SchemaPending" in str(error)


def dead_letters(raw: DataFrame, topic: str, error: BaseException) -> DataFrame:
    """The raw records with five more headers: error class and message, source topic, partition and offset."""

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(PREFIX + name).alias("key"), value.cast("string").cast("binary").alias("value"))

    more = F.array(header("class", F.lit(type(error).__name__)), header("message", F.lit(str(error)[:1000])), header("topic", F.lit(topic)), header("partition", F.col("partition")), header("offset", F.col("offset")))
    return raw.select("key", "value", "timestamp", "partition", "offset", F.concat(F.coalesce("headers", no_headers()), more.cast(HEADER_TYPE)).alias("headers"))


class TestDriver:
    """Runs a topology in process on records given one by one or as batches, and keeps its outputs by topic."""

    __test__ = False

    def __init__(self, spark: SparkSession, topology: BuiltTopology):
        from ..records import RAW

        self.spark, self.topology, self.schema = spark, topology, RAW
        self.offsets: dict[tuple[str, int], int] = {}
        self.outputs: dict[str, list] = {}
        self.fault: Exception | None = None

    def fail_next(self, error: Exception) -> None:
        """The next batch raises ``error``."""
        self.fault = error

    def pipe(self, topic: str, value: bytes | None, key: bytes | None = None, timestamp: int = 0, partition: int = 0, headers: list | None = None) -> None:
        """One record as a batch, its offset assigned."""
        at = self.offsets.get((topic, partition), 0)
        self.offsets[topic, partition] = at + 1
        self.pipe_batch({topic: [(key, value, timestamp, partition, at, headers or [])]})

    def pipe_batch(self, records: Mapping[str, list]) -> None:
        """Records (key, value, timestamp, partition, offset, headers) by topic, as one batch."""
        if self.fault:
            error, self.fault = self.fault, None
            raise error
        raw = {t: self.spark.createDataFrame(r, self.schema) for t, r in records.items()}
        for topic, df in self.topology.run_batches(raw).items():
            self.outputs.setdefault(topic, []).extend(df.collect())

    def output_size(self, topic: str) -> int:
        return len(self.outputs.get(topic, []))

    def read(self, topic: str):
        """The next output of a topic, or None."""
        rows = self.outputs.get(topic, [])
        return rows.pop(0) if rows else None

    def drain(self, topic: str) -> list:
        return self.outputs.pop(topic, [])
