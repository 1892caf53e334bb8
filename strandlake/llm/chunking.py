"""Document fingerprints by content-defined chunking with a normalised gear hash.

A text's UTF-8 bytes are cut where a rolling gear hash of the bytes before ends in zero bits, a
stricter pattern below the normal chunk length and a looser one above it, so that lengths keep near
the normal one. The hash depends on the last 32 bytes only: after an insertion the same cuts
come back. A fingerprint is the set of the chunks' digests with their lengths, and one text's
containment in another is the share of its chunk bytes whose chunks the other has too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, map_texts, slices, without

#: One number for each byte, made by a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), seed=0x67656172) for i in range(256)], np.uint32)


@dataclass(frozen=True)
class Cuts:
    """Chunk lengths in bytes: least, normal (a power of two), most."""

    least: int = 24
    normal: int = 64
    most: int = 256


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[byte k back] << k, over 32 bytes, modulo 2**32."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            y = h.copy()
            y[width:] += h[:-width] << np.uint32(width)
            h = y
    return h


def chunks(data: bytes, cuts: Cuts = Cuts()) -> list[bytes]:
    """``data`` cut into chunks; none for no data."""
    bits = cuts.normal.bit_length() - 1
    h = gear_hashes(data)
    strict = (np.flatnonzero(h >> np.uint32(32 - bits - 1) == 0) + 1).tolist()
    loose = (np.flatnonzero(h >> np.uint32(32 - bits + 1) == 0) + 1).tolist()
    out, at, end = [], 0, len(data)
    while at < end:
        cut = end
        if end - at > cuts.least:
            cut = min(at + cuts.most, end)
            i = bisect_left(strict, at + cuts.least)
            if i < len(strict) and strict[i] < at + cuts.normal:
                cut = strict[i]
            else:
                i = bisect_left(loose, at + cuts.normal)
                if i < len(loose) and loose[i] < cut:
                    cut = loose[i]
        out.append(data[at:cut])
        at = cut
    return out


def fingerprint(data: bytes, cuts: Cuts = Cuts()) -> dict[int, int]:
    """Lengths of the different chunks by their 48-bit digest."""
    digest = xxhash.xxh3_64_intdigest
    return {digest(c) & 0xFFFFFFFFFFFF: len(c) for c in chunks(data, cuts)}


def text_form(fp: dict[int, int]) -> str:
    """A fingerprint as text: for each chunk, by digest, 12 hexadecimal digits of it and 3 of its length."""
    return "".join([f"{d:012x}{n:03x}" for d, n in sorted(fp.items())])


def from_text(s: str) -> dict[int, int]:
    return {int(s[i : i + 12], 16): int(s[i + 12 : i + 15], 16) for i in range(0, len(s), 15)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes in chunks that b has too, 0 to 1. An empty text is contained in an empty one only."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum([n for d, n in a.items() if d in b]) / total


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", cuts: Cuts = Cuts()) -> DataFrame:
    """``docs``, all columns kept, with each text's fingerprint in ``out``, in place of a column so named (null text: as empty)."""
    docs = without(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                fps = [text_form(fingerprint(t or b"", cuts)) for t in as_bytes(part.column(text_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps, pa.string())], [*part.schema.names, out])

    return map_texts(docs, task, schema)


def _above(k: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (descending) that are above ``k``, by binary search in one array."""
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))]) if bounds else F.array(F.lit(1))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) > k, F.lit(False)), at + step).otherwise(at))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """The rows dealt out in ranges of descending id and sorted there, so that each lies before the next.

    Columns: part, tail, k (the id, null as the least possible one, after it), id, text. Each range ends with the rows of
    the first id of the next range, marked as tail (the last range: with the first of all). Rows
    with equal ids are in the order of their texts. The texts are shuffled once.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(k.alias("k"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quantiles = rows.approxQuantile("k", [i / n for i in range(1, n)], max(0.1 / n, 2e-5)) if n > 1 else []
    bounds = sorted({int(q) for q in quantiles}, reverse=True)
    rows = rows.withColumn("part", _above(F.col("k"), bounds))
    heads = {r["part"]: r["k"] for r in rows.groupBy("part").agg(F.max("k").alias("k")).collect()}
    if not heads:
        return rows.select("part", F.lit(False).alias("tail"), "k", "id", "text")
    # By range: the first id in it, and the range before it that has rows (for the first one: the last).
    filled = sorted(heads)
    last = dict(zip(filled, [filled[-1], *filled]))
    head, before = (F.array(*[F.lit(x.get(p)).cast(t) for p in range(len(bounds) + 1)]) for x, t in ((heads, "long"), (last, "int")))
    own = F.struct(F.col("part"), F.lit(False).alias("tail"))
    also = F.struct(F.get(before, F.col("part")).alias("part"), F.lit(True).alias("tail"))
    places = F.when(F.col("k") == F.get(head, F.col("part")), F.array(own, also)).otherwise(F.array(own))
    dealt = rows.select("k", "id", "text", F.explode(places).alias("at")).select(F.col("at.part").alias("part"), F.col("at.tail").alias("tail"), "k", "id", "text")
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "tail", F.col("k").desc(), F.col("id").isNull(), "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: Cuts = Cuts()) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The next document is that with the next smaller id, after the last the first; an only document
    is its own next. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (containment of the text in the edited and in the next text).
    Null text: as empty. Rows with equal ids follow each other by text; null ids come last.
    Repeated rows come out repeatedly. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for part, tail, key, data in zip(piece.column("part").to_pylist(), piece.column("tail").to_pylist(), piece.column("id").to_pylist(), as_bytes(piece.column("text"))):
                    now = (part, tail, key, data.decode("utf-8"), fingerprint(data, cuts))
                    if last is not None and not last[1] and last[0] == part:
                        changed = edited(last[3], now[3]).encode("utf-8")
                        efp = fingerprint(changed, cuts)
                        out.append((last[2], len(last[3]), hashlib.sha256(changed).hexdigest(), text_form(last[4]), text_form(efp), containment(last[4], efp), containment(last[4], now[4])))
                    last = now
                columns = list(zip(*out)) if out else [[]] * 7
                types = [piece.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return map_texts(beside_next(docs, id_col, text_col), task, schema).withColumnRenamed("id", id_col)
