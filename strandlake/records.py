"""The record envelope: key, event time, partition, offset and headers as columns beside the payload.

The five reserved columns follow the payload, in the order of ``RESERVED``; all are nullable. A payload
column whose name is reserved is renamed inside the engine, with its own name in the field's
metadata, and gets it back at a sink.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import LakeError

KEY, TIMESTAMP, PARTITION, OFFSET, HEADERS = RESERVED = ("__key", "__timestamp", "__partition", "__offset", "__headers")
HEADER_TYPE = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))
ENVELOPE = T.StructType([
    T.StructField(KEY, T.BinaryType()), T.StructField(TIMESTAMP, T.LongType()), T.StructField(PARTITION, T.IntegerType()),
    T.StructField(OFFSET, T.LongType()), T.StructField(HEADERS, HEADER_TYPE),
])
#: Schema of raw records: what a topic holds. ``timestamp`` is in milliseconds.
RAW = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("timestamp", T.LongType()),
    T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("headers", HEADER_TYPE),
])
ESCAPE = "__payload_"
ORIGINAL = "strandlake.name"


def no_headers() -> Column:
    return F.array().cast(HEADER_TYPE)


def millis(timestamp: Column) -> Column:
    """Milliseconds since the epoch of a timestamp with or without zone (the session's zone must be UTC for the latter)."""
    return F.unix_millis(timestamp.cast("timestamp"))


def escape(df: DataFrame) -> DataFrame:
    """``df`` with reserved payload names escaped."""
    for name in df.columns:
        if name in RESERVED:
            df = df.withColumnRenamed(name, ESCAPE + name).withMetadata(ESCAPE + name, {ORIGINAL: name})
    return df


def as_records(df: DataFrame, key: Column | None = None, timestamp: Column | None = None, partition: Column | None = None, offset: Column | None = None, headers: Column | None = None) -> DataFrame:
    """``df`` as payload with an envelope after it. What isn't given is null (headers: none).

    ``key`` is cast to binary, ``timestamp`` is milliseconds. Expressions see the columns of ``df``.
    """
    given = (key, timestamp, partition, offset, headers)
    plain = [F.lit(None) if c is None else c for c in given]
    if headers is None:
        plain[-1] = no_headers()
    if key is not None:
        plain[0] = key if dict(df.select(key.alias("k")).dtypes)["k"] == "binary" else key.cast("string").cast("binary")
    # Names are escaped only after the expressions have seen the columns.
    temporary = [f"__new{n}" for n in RESERVED]
    df = df.select("*", *[c.cast(ENVELOPE[n].dataType).alias(t) for c, n, t in zip(plain, RESERVED, temporary)])
    df = escape(df)
    for t, n in zip(temporary, RESERVED):
        df = df.withColumnRenamed(t, n)
    return df


def payload(df: DataFrame) -> list[str]:
    """Names of the payload columns."""
    return [c for c in df.columns if c not in RESERVED]


def metadata(df: DataFrame) -> list[str]:
    """Names of the reserved columns present, in their order."""
    return [c for c in RESERVED if c in df.columns]


def restore(df: DataFrame) -> DataFrame:
    """The payload alone, escaped names given back."""
    df = df.select(*payload(df))
    for f in df.schema.fields:
        if ORIGINAL in f.metadata:
            own = {k: v for k, v in f.metadata.items() if k != ORIGINAL}
            df = df.withColumnRenamed(f.name, f.metadata[ORIGINAL]).withMetadata(f.metadata[ORIGINAL], own)
    return df


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise LakeError(f"column does not exist: {name}")


def from_raw(raw: DataFrame, value: str = "__value") -> DataFrame:
    """Raw records as an envelope beside the value column ``value``; Kafka's own source schema is taken too."""
    ts = F.col("timestamp")
    if isinstance(raw.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
        ts = millis(ts)
    headers = F.col("headers").cast(HEADER_TYPE) if "headers" in raw.columns else no_headers()
    return raw.select(F.col("value").alias(value), F.col("key").alias(KEY), ts.alias(TIMESTAMP), F.col("partition").cast("int").alias(PARTITION), F.col("offset").alias(OFFSET), F.coalesce(headers, no_headers()).alias(HEADERS))


def to_raw(df: DataFrame, value: str = "__value") -> DataFrame:
    """Records to produce: key, value, timestamp (null: 0), headers, and the partition and offset they stem from."""
    def have(name: str, kind: T.DataType) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    return df.select(
        have(KEY, T.BinaryType()).alias("key"), F.col(value).alias("value"), F.coalesce(have(TIMESTAMP, T.LongType()), F.lit(0)).cast("long").alias("timestamp"),
        have(PARTITION, T.IntegerType()).alias("partition"), have(OFFSET, T.LongType()).alias("offset"), F.coalesce(have(HEADERS, HEADER_TYPE), no_headers()).alias("headers"),
    )


def _int32(n: Column) -> Column:
    """Four bytes, big-endian."""
    return F.unhex(F.lpad(F.right(F.hex(n.cast("long")), F.lit(8)), 8, "0"))


def encode_headers(headers: Column) -> Column:
    """Headers as bytes: a count; for each a length and the key, a length (-1: null) and the value; big-endian."""
    def one(acc: Column, h: Column) -> Column:
        k = h["key"].cast("binary")
        return F.concat(acc, _int32(F.octet_length(k)), k, F.when(h["value"].isNull(), F.unhex(F.lit("FFFFFFFF"))).otherwise(F.concat(_int32(F.octet_length(h["value"])), h["value"])))

    return F.aggregate(F.coalesce(headers, no_headers()), _int32(F.size(F.coalesce(headers, no_headers()))), one)


def decode_headers(blob: Column) -> Column:
    """The headers of :func:`encode_headers`; order, repeats and null values kept. Null: none."""
    @F.pandas_udf(HEADER_TYPE)
    def decode(values: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> list[dict]:
            if b is None:
                return []
            at, out = 4, []
            take = lambda i: int.from_bytes(b[i : i + 4], "big", signed=True)
            for _ in range(take(0)):
                n = take(at)
                key = b[at + 4 : at + 4 + n].decode("utf-8")
                at += 4 + n
                n = take(at)
                out.append({"key": key, "value": None if n < 0 else b[at + 4 : at + 4 + n]})
                at += 4 + max(n, 0)
            if at != len(b):
                raise LakeError("header bytes left over")
            return out

        return values.map(one)

    return decode(blob)
