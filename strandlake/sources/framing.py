"""The registry's wire format: a zero byte, the schema id in four bytes, for Protobuf the message's index path, the body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import LakeError


def frame(body: Column, schema_id: Column | int) -> Column:
    """Framed bytes, JVM-side. Null body: null."""
    number = schema_id if isinstance(schema_id, Column) else F.lit(schema_id)
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), body)


def _checked(framed: Column) -> Column:
    bad_length = F.when(F.octet_length(framed) < 5, F.raise_error(F.lit("framed value is shorter than 5 bytes")))
    bad_magic = F.when(F.hex(F.substring(framed, 1, 1)) != "00", F.raise_error(F.lit("unknown magic byte")))
    return F.coalesce(bad_length.cast("binary"), bad_magic.cast("binary"), framed)


def schema_id(framed: Column) -> Column:
    """The schema id of framed bytes; too few bytes or another magic byte is an error."""
    return F.conv(F.hex(F.substring(_checked(framed), 2, 4)), 16, 10).cast("long").cast("int")


def body(framed: Column) -> Column:
    """What follows the id."""
    checked = _checked(framed)
    return F.substring(checked, F.lit(6), F.octet_length(checked))


def zigzag(n: int) -> bytes:
    """A number as a zig-zag varint."""
    u = (n << 1) ^ (n >> 63) if n < 0 else n << 1
    out = bytearray()
    while True:
        out.append(u & 0x7F | (0x80 if u > 0x7F else 0))
        u >>= 7
        if not u:
            return bytes(out)


def read_zigzag(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at`` and the place after it."""
    u = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise LakeError("varint is cut off or too long")
        b = data[at]
        u |= (b & 0x7F) << shift
        at += 1
        shift += 7
        if not b & 0x80:
            return (u >> 1) ^ -(u & 1), at


def frame_protobuf(body_: bytes, number: int, path: list[int]) -> bytes:
    """A framed Protobuf message; the path of a file's first message is a single zero byte."""
    index = b"\x00" if list(path) == [0] else zigzag(len(path)) + b"".join(map(zigzag, path))
    return b"\x00" + number.to_bytes(4, "big") + index + body_


def unframe_protobuf(data: bytes) -> tuple[int, list[int], bytes]:
    """Schema id, index path and body."""
    if len(data) < 5:
        raise LakeError("framed value is shorter than 5 bytes")
    if data[0]:
        raise LakeError("unknown magic byte")
    n, at = read_zigzag(data, 5)
    if n == 0:
        return int.from_bytes(data[1:5], "big"), [0], data[at:]
    if n < 0 or n > len(data):
        raise LakeError("bad message index path")
    path = []
    for _ in range(n):
        i, at = read_zigzag(data, at)
        path.append(i)
    return int.from_bytes(data[1:5], "big"), path, data[at:]
