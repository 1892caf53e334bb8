"""Codecs between raw records and columns: Arrow IPC blobs, rows (JSON or custom), gzip around any of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..errors import LakeError
from ..records import ESCAPE, HEADERS, KEY, OFFSET, ORIGINAL, PARTITION, RESERVED, TIMESTAMP, from_raw, metadata, payload, restore, to_raw

#: Largest Arrow record by default, and largest inflated gzip record (fixed values).
BLOB_BYTES, GZIP_BYTES = 900 * 1024, 16 * 1024 * 1024
#: Bytes of decoded rows after which a batch of them goes on.
DECODED_BYTES = 16 * 1024 * 1024
#: What ends an Arrow IPC stream (fixed value of the format).
IPC_END = b"\xff\xff\xff\xff\x00\x00\x00\x00"


class Codec:
    """Raw records to columns (payload, then envelope) and back."""

    def for_topic(self, topic: str) -> Codec:
        """The codec of one topic's records; a topology asks for it by the topic it reads or writes."""
        return self

    def decode(self, raw: DataFrame) -> DataFrame:
        raise NotImplementedError

    def encode(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class FrameCodec(Codec):
    """For batches that are columns already, as tables are: both directions leave the rows alone."""

    def decode(self, raw: DataFrame) -> DataFrame:
        return raw

    def encode(self, df: DataFrame) -> DataFrame:
        return df


def ipc_bytes(table: pa.Table | pa.RecordBatch) -> bytes:
    """One Arrow IPC stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        if isinstance(table, pa.Table):
            if any(c.num_chunks > 1 for c in table.columns):  # one batch
                table = table.combine_chunks()
            out.write_table(table, max_chunksize=max(1, len(table)))
        else:
            out.write_batch(table)
    return sink.getvalue().to_pybytes()


def ipc_batch(data: bytes | None) -> pa.RecordBatch | None:
    """The first record batch of an Arrow IPC stream (null: null). Anything else is an error."""
    if data is None:
        return None
    try:
        with pa.ipc.open_stream(data) as stream:
            try:
                return stream.read_next_batch()
            except StopIteration:
                return pa.RecordBatch.from_pylist([], schema=stream.schema)
    except pa.ArrowInvalid as e:
        raise LakeError(f"not an Arrow IPC stream: {e}") from e


class BlobCodec(Codec):
    """A record's value is an Arrow IPC stream of one batch; its envelope goes onto each of its rows.

    Encoding cuts a partition's rows, by offset, into longest runs of equal key, timestamp and
    headers, and each run into records of as many rows as fit in ``most`` bytes. A single row that
    doesn't fit is an error. The schema is that of ``schema``, or of the batch's first record; all
    records must have it.
    """

    def __init__(self, most: int = BLOB_BYTES, schema: T.StructType | None = None):
        self.most, self.schema = most, schema

    def decode(self, raw: DataFrame) -> DataFrame:
        rows = from_raw(raw)
        schema = self.schema
        if schema is None:
            first = rows.select("__value").filter("__value is not null").limit(1).collect()
            if not first:
                raise LakeError("an empty blob batch has no schema; give the codec one")
            schema = from_arrow_schema(ipc_batch(bytes(first[0][0])).schema)
        fields = []
        for f in schema.fields:
            name, meta = (ESCAPE + f.name, {**f.metadata, ORIGINAL: f.name}) if f.name in RESERVED else (f.name, f.metadata)
            fields.append(T.StructField(name, f.dataType, True, meta))
        envelope = [f for f in rows.schema.fields if f.name in RESERVED]
        out = T.StructType([*fields, *envelope])
        arrow = to_arrow_schema(out)
        wanted = [f.name for f in schema.fields]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made(batch: pa.RecordBatch, parts: list[pa.RecordBatch], first: int) -> pa.RecordBatch:
                """The rows of records from number ``first`` on, as one batch."""
                columns = [pa.concat_arrays([p.column(k).cast(arrow.field(k).type) for p in parts]) for k in range(len(fields))]
                at = pa.array(np.repeat(np.arange(first, first + len(parts)), [p.num_rows for p in parts]))
                columns += [batch.column(f.name).take(at) for f in envelope]
                return pa.RecordBatch.from_arrays(columns, schema=arrow)

            for batch in batches:
                parts: list[pa.RecordBatch] = []
                size = 0
                for i, value in enumerate(batch.column("__value")):
                    try:
                        part = ipc_batch(value.as_buffer() if value.is_valid else None)
                    except LakeError as e:
                        raise LakeError(f"record {i} of the batch: {e}") from e
                    if part is None:
                        raise LakeError(f"record {i} of the batch has no value")
                    if part.schema.names != wanted:
                        raise LakeError(f"record {i} of the batch has another schema: {part.schema.names}")
                    parts.append(part)
                    size += part.nbytes
                    if size > DECODED_BYTES:
                        yield made(batch, parts, i + 1 - len(parts))
                        parts, size = [], 0
                if parts:
                    yield made(batch, parts, batch.num_rows - len(parts))

        decoded = rows.mapInArrow(task, out)
        for f in fields:
            if f.metadata:
                decoded = decoded.withMetadata(f.name, f.metadata)
        return decoded

    def encode(self, df: DataFrame) -> DataFrame:
        most = self.most
        plain = restore(df)
        names = payload(df)
        schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, plain.schema.fields)])
        arrow = to_arrow_schema(schema).empty_table().rename_columns(plain.columns).schema
        have = {f.name: f.dataType for f in df.schema.fields}
        key = F.col(KEY) if KEY in have else F.lit(None).cast("binary")
        ts = F.coalesce(F.col(TIMESTAMP), F.lit(0)).cast("long") if TIMESTAMP in have else F.lit(0).cast("long")
        headers = F.col(HEADERS) if HEADERS in have else F.array().cast("array<struct<key:string,value:binary>>")
        partition = F.col(PARTITION) if PARTITION in have else F.lit(0)
        offset = F.col(OFFSET) if OFFSET in have else F.lit(0).cast("long")
        rows = df.select(*names, key.alias("__k"), ts.alias("__t"), headers.alias("__h"), partition.cast("int").alias("__p"), offset.alias("__o"), F.monotonically_increasing_id().alias("__i"))
        # A partition's rows lie in one task in their order, as its records must; runs are cut as they stream by.
        rows = rows.repartition("__p").sortWithinPartitions("__p", "__o", "__i")
        head = ["__k", "__t", "__p", "__o", "__h"]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run: list[pa.RecordBatch] = []  # rows of the run that are not sent yet
            envelope: tuple | None = None
            head_bytes = arrow.serialize().to_pybytes()

            def stream(body: pa.RecordBatch) -> bytes:
                """What :func:`ipc_bytes` makes, the schema's message made once."""
                return b"".join((head_bytes, body.serialize().to_pybytes(), IPC_END))

            def records(body: pa.RecordBatch, last: bool) -> Iterator[tuple[bytes, int]]:
                """Encoded prefixes with their row counts; the last one only if the run ends."""
                at = 0
                while at < len(body):
                    low = len(body) - at
                    data = stream(body.slice(at))
                    if len(data) > most:
                        low, high = 1, low - 1
                        while low < high:  # the most rows that fit
                            mid = (low + high + 1) // 2
                            low, high = (mid, high) if len(stream(body.slice(at, mid))) <= most else (low, mid - 1)
                        data = stream(body.slice(at, low))
                        if len(data) > most:
                            raise LakeError(f"one row takes {len(data)} bytes, more than {most}")
                    if at + low == len(body) and not last:
                        break
                    yield data, low
                    at += low

            def send(last: bool) -> list[tuple]:
                body = run[0] if len(run) == 1 else pa.concat_batches(run)
                done, out = 0, []
                for data, n in records(body, last):
                    out.append((data, *envelope))
                    done += n
                run[:] = [] if last else [body.slice(done)]
                return out

            def packed(out: list[tuple]) -> pa.RecordBatch:
                value, k, t, p, o, h = zip(*out)
                return pa.RecordBatch.from_pydict({"key": pa.array(k, pa.binary()), "value": pa.array(value, pa.binary()), "timestamp": pa.array(t, pa.int64()), "partition": pa.array(p, pa.int32()), "offset": pa.array(o, pa.int64()), "headers": pa.array(h, pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())])))})

            for batch in batches:
                body = pa.RecordBatch.from_arrays([batch.column(n) for n in names], schema=arrow)
                heads = list(zip(*(batch.column(c).to_pylist() for c in head)))
                out, start = [], 0
                for i, (k, t, p, o, h) in enumerate(heads):
                    if envelope is None or (k, t, p, h) != (*envelope[:3], envelope[4]):
                        if i > start:
                            run.append(body.slice(start, i - start))
                        if run:
                            out += send(True)
                        envelope, start = (k, t, p, o, h), i
                run.append(body.slice(start))
                if sum(r.nbytes for r in run) > 4 * most:
                    out += send(False)
                if out:
                    yield packed(out)
            if run:
                yield packed(send(True))

        return rows.mapInArrow(task, "key binary, value binary, timestamp long, partition int, offset long, headers array<struct<key:string,value:binary>>")


class RowCodec(Codec):
    """One record is one row. ``decoder`` gives payload columns from the column ``__value`` (and may read the
    envelope, headers too); ``encoder`` gives the value from the payload columns."""

    def __init__(self, decoder: Callable[[DataFrame], dict[str, Column]], encoder: Callable[[DataFrame], Column]):
        self.decoder, self.encoder = decoder, encoder

    def decode(self, raw: DataFrame) -> DataFrame:
        rows = from_raw(raw)
        made = self.decoder(rows)
        safe = {(ESCAPE + n if n in RESERVED else n): c for n, c in made.items()}
        out = rows.select(*[c.alias(n) for n, c in safe.items()], *metadata(rows))
        for n in made:
            if n in RESERVED:
                out = out.withMetadata(ESCAPE + n, {ORIGINAL: n})
        return out

    def encode(self, df: DataFrame) -> DataFrame:
        return to_raw(df.withColumn("__value", self.encoder(df)))


def string_codec() -> RowCodec:
    """Text values in a column ``value``."""
    return RowCodec(lambda df: {"value": F.col("__value").cast("string")}, lambda df: F.col("value").cast("binary"))


class JsonCodec(RowCodec):
    """JSON rows. Objects and arrays stay JSON text; their fields carry the metadata ``strandlake.json``.

    The columns are those of ``schema`` (nested types: JSON text), or of the JSON Schema document
    ``json_schema``, or else those of the first batch with rows, in the order of their first
    appearance, which then hold for all later batches. Rows that aren't objects are one column
    ``value``. Malformed JSON is an error.
    """

    def __init__(self, schema: T.StructType | None = None, json_schema: dict | None = None):
        self.schema = from_json_schema(json_schema) if json_schema is not None else _as_text(schema) if schema is not None else None
        super().__init__(self._columns, self._value)

    def decode(self, raw: DataFrame) -> DataFrame:
        if self.schema is None:
            self.schema = infer_json(raw)
        out = super().decode(raw)
        for f in self.schema.fields:
            name = ESCAPE + f.name if f.name in RESERVED else f.name
            meta = {**out.schema[name].metadata, **f.metadata}
            if meta:
                out = out.withMetadata(name, meta)
        return out

    def _columns(self, df: DataFrame) -> dict[str, Column]:
        text = F.col("__value").cast("string")
        if _single(self.schema):
            f = self.schema.fields[0]
            plain = T.StructType([T.StructField("value", T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType)])
            wrapped = F.from_json(F.concat(F.lit('{"value":'), text, F.lit("}")), plain, {"mode": "FAILFAST"})["value"]
            return {"value": F.unbase64(wrapped) if isinstance(f.dataType, T.BinaryType) else wrapped}
        plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in self.schema.fields])
        row = F.from_json(text, plain, {"mode": "FAILFAST"})
        return {f.name: F.unbase64(row[f.name]) if isinstance(f.dataType, T.BinaryType) else row[f.name] for f in self.schema.fields}

    def _value(self, df: DataFrame) -> Column:
        columns = []
        for n in payload(df):
            f = df.schema[n]
            c = F.col(f"`{n}`")
            if f.metadata.get("strandlake.json"):
                c = F.parse_json(c)
            elif isinstance(f.dataType, T.BinaryType):
                c = F.base64(c)
            columns.append(c.alias(f.metadata.get(ORIGINAL, n)))
        if self.schema is not None and _single(self.schema):
            return F.regexp_extract(F.to_json(F.struct(columns[0].alias("value")), {"ignoreNullFields": "false"}), r"(?s)^\{\"value\":(.*)\}$", 1).cast("binary")
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary")


def _single(schema: T.StructType) -> bool:
    return len(schema) == 1 and bool(schema.fields[0].metadata.get("strandlake.single"))


def _as_text(schema: T.StructType) -> T.StructType:
    nested = (T.StructType, T.ArrayType, T.MapType)
    return T.StructType([T.StructField(f.name, T.StringType(), f.nullable, {**f.metadata, "strandlake.json": True}) if isinstance(f.dataType, nested) else f for f in schema.fields])


def from_json_schema(document: dict) -> T.StructType:
    """Columns of a JSON Schema document: scalars by type, base64 content as binary, objects and arrays as JSON text.

    A property is nullable unless it is required and its type doesn't list null. Local references are followed.
    """

    def follow(s: dict, depth: int = 0) -> dict:
        if "$ref" not in s:
            return s
        ref = s["$ref"]
        if not ref.startswith("#/") or depth > 32:
            raise LakeError(f"can't follow {ref}")
        at = document
        for step in ref[2:].split("/"):
            at = at[step.replace("~1", "/").replace("~0", "~")]
        return follow(at, depth + 1)

    def field(name: str, s: dict, required: bool, extra: dict | None = None) -> T.StructField:
        s = follow(s)
        kinds = s.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        nullable = "null" in kinds or not required
        kinds = [k for k in kinds if k != "null"]
        meta = dict(extra or {})
        kind: T.DataType = T.StringType()
        if kinds == ["integer"]:
            kind = T.LongType()
        elif kinds and set(kinds) <= {"integer", "number"}:
            kind = T.DoubleType()
        elif kinds == ["boolean"]:
            kind = T.BooleanType()
        elif kinds and set(kinds) <= {"object", "array"} or not kinds and ("properties" in s or "items" in s):
            meta["strandlake.json"] = True
        elif s.get("contentEncoding") == "base64":
            kind = T.BinaryType()
        return T.StructField(name, kind, nullable, meta)

    root = follow(document)
    if root.get("type", "object") != "object":
        return T.StructType([field("value", root, True, {"strandlake.single": True})])
    required = set(root.get("required", []))
    return T.StructType([field(n, s, n in required) for n, s in root.get("properties", {}).items()])


def infer_json(raw: DataFrame) -> T.StructType:
    """Columns of JSON rows, from all rows of the batch (aggregated; only the names and kinds reach the driver)."""
    text = F.col("value").cast("string")
    order = F.struct(*[F.col(c) for c in ("partition", "offset") if c in raw.columns], F.monotonically_increasing_id())
    rows = raw.filter("value is not null").select(text.alias("v"), order.alias("o"))
    tops = {r["k"] for r in rows.select(F.schema_of_variant(F.parse_json("v")).alias("k")).select(F.regexp_extract("k", "^[A-Z]+", 0).alias("k")).distinct().collect()}
    if not tops:
        raise LakeError("no rows to infer a schema from")
    single = tops != {"OBJECT"}
    if single:
        entries = rows.select(F.lit("value").alias("name"), F.parse_json("v").alias("x"), F.struct("o", F.lit(0).alias("pos")).alias("at"))
    else:
        entries = rows.select("o", F.posexplode(F.from_json("v", T.MapType(T.StringType(), T.VariantType())))).select(F.col("key").alias("name"), F.col("value").alias("x"), F.struct("o", "pos").alias("at"))
    kinds = entries.groupBy("name").agg(F.min("at").alias("at"), F.collect_set(F.regexp_extract(F.schema_of_variant("x"), "^[A-Z]+", 0)).alias("kinds")).orderBy("at").collect()
    fields = []
    for r in kinds:
        k = set(r["kinds"]) - {"VOID", ""}
        meta = {"strandlake.single": True} if single else {}
        if k and k <= {"BIGINT"}:
            kind: T.DataType = T.LongType()
        elif k and k <= {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"}:
            kind = T.DoubleType()
        elif k == {"BOOLEAN"}:
            kind = T.BooleanType()
        else:
            kind = T.StringType()
            if k and k <= {"OBJECT", "ARRAY"}:
                meta["strandlake.json"] = True
        fields.append(T.StructField(r["name"], kind, True, meta))
    return T.StructType(fields)


def gzip_value(value: Column) -> Column:
    """The value compressed (null stays null)."""
    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> bytes | None:
            if b is None:
                return None
            c = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
            return c.compress(b) + c.flush()

        return values.map(one)

    return pack(value)


def gunzip_value(value: Column, most: int = GZIP_BYTES) -> Column:
    """The value inflated; more than ``most`` bytes, and what is no whole gzip stream, is an error."""
    @F.pandas_udf("binary")
    def unpack(values: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> bytes | None:
            if b is None:
                return None
            out, rest = [], b
            total = 0
            while rest:
                d = zlib.decompressobj(16 + zlib.MAX_WBITS)
                try:
                    part = d.decompress(rest, most + 1 - total)
                except zlib.error as e:
                    raise LakeError(f"not gzip: {e}") from e
                total += len(part)
                if total > most or d.unconsumed_tail:
                    raise LakeError(f"a record inflates to more than {most} bytes")
                if not d.eof:
                    raise LakeError("gzip stream is cut off")
                out.append(part)
                rest = d.unused_data
            return b"".join(out)

        return values.map(one)

    return unpack(value)


class GzipCodec(Codec):
    """Another codec's values, each gzipped."""

    def __init__(self, inner: Codec, most: int = GZIP_BYTES):
        if most < 1:
            raise LakeError("the inflated size must be at least 1 byte")
        self.inner, self.most = inner, most

    def for_topic(self, topic: str) -> Codec:
        return GzipCodec(self.inner.for_topic(topic), self.most)

    def decode(self, raw: DataFrame) -> DataFrame:
        return self.inner.decode(raw.withColumn("value", gunzip_value(F.col("value"), self.most)))

    def encode(self, df: DataFrame) -> DataFrame:
        return self.inner.encode(df).withColumn("value", gzip_value(F.col("value")))

