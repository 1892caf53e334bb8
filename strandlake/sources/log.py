"""A topic as an offset log in shared storage: a Spark data source and sink, bounded and streaming, exactly once.

A folder holds ``data`` (Parquet, a row group for each run of a partition's records) and ``commits`` (numbered JSON files, each with
the runs that it adds and their first offsets). Tasks write data files only; the driver's commit makes them part of the
log with one file, named after the writer and its epoch. A file that no commit names is never read: what a task or driver
that died has left counts for nothing. An epoch that is committed again, as after a restart between a commit and
Spark's own note of it, adds nothing. Reads are planned by commits: a task reads whole runs and only their bytes.

``folder`` is any place that pyarrow's file systems reach (a path, ``file:``, ``hdfs:``, ``s3:``...). One query at a time
writes to a topic; readers may be any number.

    spark.dataSource.register(OffsetLog)
    records.write.format("offset_log").option("folder", path).mode("append").save()
    spark.readStream.format("offset_log").option("folder", path).load()

Options to read: ``from`` and ``to`` (JSON from partition to offset; from included, to not), ``commits_per_batch`` for streams.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import LakeError
from ..records import RAW


class Store:
    """The folder of a topic."""

    def __init__(self, folder: str):
        self.files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.data, self.commits = f"{root}/data", f"{root}/commits"

    def listed(self) -> list[tuple[int, str]]:
        """(number, path) of all commits, in order."""
        found = self.files.get_file_info(fs.FileSelector(self.commits, allow_not_found=True))
        return sorted((int(f.base_name.split("-")[0]), f.path) for f in found if f.base_name.endswith(".json"))

    def runs(self, after: int = -1, upto: int | None = None) -> list[dict]:
        """The runs of the commits numbered over ``after``, up to ``upto``."""
        out = []
        for number, path in self.listed():
            if number > after and (upto is None or number <= upto):
                with self.files.open_input_stream(path) as f:
                    out += json.loads(f.read())["runs"]
        return out

    def ends(self) -> dict[int, int]:
        """The next offset of each partition, as the last commit says."""
        listed = self.listed()
        if not listed:
            return {}
        with self.files.open_input_stream(listed[-1][1]) as f:
            return {int(p): n for p, n in json.loads(f.read())["ends"].items()}

    def commit(self, writer: str, epoch: int, runs: list[dict]) -> bool:
        """Adds ``runs``; False if this writer's epoch is in the log already."""
        listed, name = self.listed(), f"{writer}-{epoch}.json"
        if any(path.rsplit("/", 1)[-1].split("-", 1)[1] == name for _, path in listed):
            return False
        ends = self.ends()
        for run in sorted(runs, key=lambda r: (r["partition"], r["file"], r["group"])):
            run["offset"] = ends.get(run["partition"], 0)
            ends[run["partition"]] = run["offset"] + run["rows"]
        number = listed[-1][0] + 1 if listed else 0
        self.files.create_dir(self.commits)
        waiting = f"{self.commits}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(waiting) as f:
            f.write(json.dumps({"runs": runs, "ends": ends}).encode())
        self.files.move(waiting, f"{self.commits}/{number:012}-{name}")
        return True

    def drop(self, files: list[str]) -> None:
        for file in files:
            self.files.delete_file(f"{self.data}/{file}")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its file and the runs in it."""

    runs: list[dict] = field(default_factory=list)


def write_runs(folder: str, batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Written:
    """A task's records as one data file, a row group for each partition and about ``rows`` records; no records, no file."""
    store, name, out = Store(folder), f"{uuid.uuid4().hex}.parquet", Written()
    schema = pa.schema([f for f in to_arrow_schema(RAW) if f.name != "offset"])
    waiting: dict[int, list[pa.Table]] = {}
    writer = None

    def put(partition: int) -> None:
        nonlocal writer
        if writer is None:
            store.files.create_dir(store.data)
            writer = pq.ParquetWriter(store.files.open_output_stream(f"{store.data}/{name}"), schema, compression="zstd")
        table = pa.concat_tables(waiting.pop(partition))
        writer.write_table(table, row_group_size=len(table))
        out.runs.append({"file": name, "group": len(out.runs), "partition": partition, "rows": len(table)})

    for batch in batches:
        table = pa.Table.from_batches([batch]).select(schema.names).cast(schema)
        partitions = table.column("partition")
        if partitions.null_count:
            raise LakeError("a record of an offset log needs a partition")
        for p in pc.unique(partitions).to_pylist():
            waiting.setdefault(p, []).append(table.filter(pc.equal(partitions, p)))
            if sum(map(len, waiting[p])) >= rows:
                put(p)
    for p in sorted(waiting):
        put(p)
    if writer is not None:
        writer.close()
    return out


class _Commits:
    """Both writers: write in tasks, commit once on the driver."""

    def __init__(self, folder: str, writer: str):
        self.folder, self.writer = folder, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_runs(self.folder, iterator)

    def _files(self, messages: list) -> list[str]:
        return sorted({r["file"] for m in messages if m is not None for r in m.runs})

    def _commit(self, messages: list, epoch: int) -> None:
        store = Store(self.folder)
        if not store.commit(self.writer, epoch, [dict(r) for m in messages if m is not None for r in m.runs]):
            store.drop(self._files(messages))

    def _abort(self, messages: list) -> None:
        Store(self.folder).drop(self._files(messages))


class BatchWriter(_Commits, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, 0)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class StreamWriter(_Commits, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._abort(messages)


@dataclass
class Run(InputPartition):
    """One run of a partition's records: where it lies, its first offset, and which of its rows are wanted."""

    file: str
    group: int
    offset: int
    skip: int
    rows: int


def _planned(runs: list[dict], start: dict[int, int], end: dict[int, int]) -> list[Run]:
    out = []
    for r in runs:
        low, high = max(start.get(r["partition"], 0), r["offset"]), min(end.get(r["partition"], r["offset"] + r["rows"]), r["offset"] + r["rows"])
        if low < high:
            out.append(Run(r["file"], r["group"], low, low - r["offset"], high - low))
    return out


class _Reads:
    def __init__(self, options: dict):
        self.folder = options["folder"]
        self.start, self.end = ({int(p): n for p, n in json.loads(options.get(k, "{}")).items()} for k in ("from", "to"))

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark plans if there is nothing to read
            return
        store = Store(self.folder)
        with store.files.open_input_file(f"{store.data}/{partition.file}") as f:
            at, file = 0, pq.ParquetFile(f)
            schema = to_arrow_schema(RAW)
            for batch in file.iter_batches(row_groups=[partition.group]):
                low, high = max(partition.skip - at, 0), min(partition.skip + partition.rows - at, len(batch))
                if low < high:
                    first = partition.offset + at + low - partition.skip
                    table = pa.Table.from_batches([batch.slice(low, high - low)])
                    table = table.append_column("offset", pa.array(range(first, first + high - low), pa.int64())).select(schema.names).cast(schema)
                    yield from table.to_batches()
                at += len(batch)


class BatchReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Run]:
        return _planned(Store(self.folder).runs(), self.start, self.end)


class StreamReader(_Reads, DataSourceStreamReader):
    """Offsets are commit numbers, so a micro-batch is whole commits."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.most, self.seen = int(options.get("commits_per_batch", 0)), None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        listed = Store(self.folder).listed()
        last = listed[-1][0] if listed else -1
        if self.most and self.seen is not None:
            last = min(last, self.seen + self.most)
        elif self.most:
            last = min(last, self.most - 1)
        self.seen = last
        return {"commit": last}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        self.seen = max(end["commit"], self.seen if self.seen is not None else -1)
        return _planned(Store(self.folder).runs(start["commit"], end["commit"]), self.start, self.end)

    def commit(self, end: dict) -> None:
        return None


class OffsetLog(DataSource):
    """The data source ``offset_log``: raw records (key, value, timestamp, partition, offset, headers). What is written may lack the offset."""

    @classmethod
    def name(cls) -> str:
        return "offset_log"

    def schema(self) -> StructType:
        return RAW

    def _folder(self) -> str:
        if not self.options.get("folder"):
            raise LakeError("an offset log needs the option folder")
        return self.options["folder"]

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader({**self.options, "folder": self._folder()})

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader({**self.options, "folder": self._folder()})

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise LakeError("an offset log is appended to, not overwritten")
        return BatchWriter(self._folder(), uuid.uuid4().hex)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        # The same name after a restart tells an epoch's second commit from its first.
        return StreamWriter(self._folder(), self.options.get("writer", "stream").replace("-", "_"))
