"""Avro: schemas as Spark types, the binary encoding with schema resolution, and a registry-framed codec.

The binary work runs over Arrow batches in Python, for no Avro reader is built into Spark's core.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
import uuid
from collections.abc import Callable, Iterator
from decimal import Context, Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import LakeError
from ..records import ESCAPE, ORIGINAL, RESERVED, from_raw, metadata, payload, to_raw
from . import framing
from .codecs import Codec

PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
META = "strandlake.avro."
#: Decimals of up to 76 digits stay exact.
WIDE = Context(prec=90)


def parse(schema: str | dict | list) -> Any:
    """A schema with all names full and all later uses of a name as that name; keeps definitions once, as JSON does."""
    if isinstance(schema, str):
        schema = json.loads(schema) if schema.strip()[:1] in "{[\"" else schema
    names: dict[str, dict] = {}

    def walk(s: Any, space: str) -> Any:
        if isinstance(s, list):
            return [walk(x, space) for x in s]
        if isinstance(s, str):
            if s in PRIMITIVES:
                return s
            full = s if "." in s or not space else f"{space}.{s}"
            if full not in names and s in names:
                full = s
            if full not in names:
                raise LakeError(f"unknown Avro type {s}")
            return full
        kind = s["type"]
        if isinstance(kind, (dict, list)):
            return walk(kind, space)
        if kind in ("record", "error", "enum", "fixed"):
            own = s.get("namespace", space)
            full = s["name"] if "." in s["name"] else f"{own}.{s['name']}" if own else s["name"]
            inner = full.rpartition(".")[0]
            out = {**s, "name": full, "type": "record" if kind == "error" else kind}
            out.pop("namespace", None)
            if "aliases" in s:
                out["aliases"] = [a if "." in a or not inner else f"{inner}.{a}" for a in s["aliases"]]
            names[full] = out
            if out["type"] == "record":
                out["fields"] = [{**f, "type": walk(f["type"], inner)} for f in s["fields"]]
            return out
        if kind == "array":
            return {**s, "items": walk(s["items"], space)}
        if kind == "map":
            return {**s, "values": walk(s["values"], space)}
        if kind in PRIMITIVES:
            return dict(s) if len(s) > 1 else kind
        return walk(kind, space)

    return walk(schema, "")


def named(schema: Any, out: dict[str, dict] | None = None) -> dict[str, dict]:
    """Definitions in a parsed schema by full name."""
    out = {} if out is None else out
    if isinstance(schema, list):
        for s in schema:
            named(s, out)
    elif isinstance(schema, dict):
        if schema["type"] in ("record", "enum", "fixed"):
            out[schema["name"]] = schema
        for f in schema.get("fields", []):
            named(f["type"], out)
        for k in ("items", "values"):
            if k in schema:
                named(schema[k], out)
    return out


def canonical(schema: str | dict) -> str:
    """The parsing canonical form: full names, only the attributes that matter, in the fixed order, no white space."""

    def form(s: Any) -> str:
        if isinstance(s, str):
            return json.dumps(s)
        if isinstance(s, list):
            return "[" + ",".join(map(form, s)) + "]"
        kind = s["type"]
        if kind in PRIMITIVES:
            return json.dumps(kind)
        parts = []
        if "name" in s:
            parts.append(f'"name":{json.dumps(s["name"])}')
        parts.append(f'"type":{json.dumps(kind)}')
        if kind == "record":
            parts.append('"fields":[' + ",".join(f'{{"name":{json.dumps(f["name"])},"type":{form(f["type"])}}}' for f in s["fields"]) + "]")
        if kind == "enum":
            parts.append('"symbols":' + json.dumps(s["symbols"], separators=(",", ":")))
        if kind == "array":
            parts.append('"items":' + form(s["items"]))
        if kind == "map":
            parts.append('"values":' + form(s["values"]))
        if kind == "fixed":
            parts.append(f'"size":{int(s["size"])}')
        return "{" + ",".join(parts) + "}"

    return form(parse(schema))


def _kind(s: Any) -> str:
    return "union" if isinstance(s, list) else s if isinstance(s, str) else s["type"]


def _logical(s: Any) -> str | None:
    return s.get("logicalType") if isinstance(s, dict) else None


def _branch(s: Any) -> str:
    return s if isinstance(s, str) else s.get("name", s["type"])


def to_struct(schema: str | dict) -> T.StructType:
    """Spark columns of a record schema (another top level: one column ``value``)."""
    parsed = parse(schema)
    known = named(parsed)

    def spark(s: Any, open_: tuple[str, ...]) -> tuple[T.DataType, bool, dict]:
        """Type, nullability, metadata."""
        if isinstance(s, str) and s in known:
            s = known[s]
        kind, logical = _kind(s), _logical(s)
        meta = {META + "logical": logical} if logical else {}
        if kind == "union":
            rest = [x for x in s if x != "null"]
            if not rest:
                raise LakeError("a union of nothing but null has no column type")
            if len(rest) == 1:
                t, _, m = spark(rest[0], open_)
                return t, "null" in s, m
            fields = []
            for x in rest:
                t, _, m = spark(x, open_)
                if any(f.name == _branch(x) for f in fields):
                    raise LakeError(f"union branches share the name {_branch(x)}")
                fields.append(T.StructField(_branch(x), t, True, m))
            return T.StructType(fields), "null" in s, {META + "union": True}
        if kind == "null":
            raise LakeError("the null type has no column type")
        if logical == "decimal" and kind in ("bytes", "fixed"):
            p, scale = s["precision"], s.get("scale", 0)
            if p > 76:
                raise LakeError(f"decimal of {p} digits; 76 at most")
            if p > 38:  # no Spark type: canonical text
                return T.StringType(), False, {**meta, META + "precision": p, META + "scale": scale}
            return T.DecimalType(p, scale), False, meta
        plain = {"boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
        if kind in plain:
            return plain[kind], False, meta
        if kind == "int":
            return {"date": T.DateType(), "time-millis": T.TimeType(3)}.get(logical, T.IntegerType()), False, meta
        if kind == "long":
            if logical == "time-micros":
                return T.TimeType(6), False, meta
            if logical in ("timestamp-millis", "timestamp-micros"):
                return T.TimestampType(), False, meta
            if logical in ("local-timestamp-millis", "local-timestamp-micros"):
                return T.TimestampNTZType(), False, meta
            return T.LongType(), False, meta
        if kind == "fixed":
            return T.BinaryType(), False, {**meta, META + "name": s["name"], META + "size": s["size"]}
        if kind == "enum":
            return T.StringType(), False, {META + "name": s["name"], META + "symbols": ",".join(s["symbols"])}
        if kind == "array":
            t, n, _ = spark(s["items"], open_)
            return T.ArrayType(t, n), False, meta
        if kind == "map":
            t, n, _ = spark(s["values"], open_)
            return T.MapType(T.StringType(), t, n), False, meta
        if s["name"] in open_:
            return T.StringType(), False, {META + "json": True, META + "name": s["name"]}
        fields = []
        for f in s["fields"]:
            t, n, m = spark(f["type"], (*open_, s["name"]))
            fields.append(T.StructField(f["name"], t, n, m))
        return T.StructType(fields), False, {META + "name": s["name"]}

    t, n, m = spark(parsed, ())
    return t if isinstance(t, T.StructType) and _kind(parsed) == "record" else T.StructType([T.StructField("value", t, n, m)])


def _long(b: bytes, at: int) -> tuple[int, int]:
    """The zig-zag varint at ``at`` and the place after it."""
    u = shift = 0
    while at < len(b):
        c = b[at]
        at += 1
        u |= (c & 0x7F) << shift
        if c < 0x80:
            return (u >> 1) ^ -(u & 1), at
        shift += 7
        if shift > 63:
            raise LakeError("Avro number is too long")
    raise LakeError("Avro value is cut off")


def _bytes(b: bytes, at: int, n: int) -> tuple[bytes, int]:
    if n < 0 or at + n > len(b):
        raise LakeError("Avro value is cut off")
    return b[at : at + n], at + n


def fits(w: Any, r: Any, strict: bool) -> bool:
    """Whether a value written as ``w`` may be read as ``r``; ``strict``: without promotion, by full name."""
    a, b = _kind(w), _kind(r)
    if a == b:
        if a in ("record", "enum", "fixed"):
            same = w["name"] == r["name"] or w["name"] in r.get("aliases", []) or (not strict and w["name"].rpartition(".")[2] == r["name"].rpartition(".")[2])
            return same and (a != "fixed" or w["size"] == r["size"])
        return True
    return not strict and (a, b) in {("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("string", "bytes"), ("bytes", "string")}


#: Reads a value: from bytes and a place in them to the value and the place after it.
Read = Callable[[bytes, int], tuple[Any, int]]


class _Compiled:
    """Functions made once for each part of a schema; a part that holds itself is reached through its cell."""

    def __init__(self) -> None:
        self.made: dict[tuple, list[Callable]] = {}

    def once(self, key: tuple, make: Callable[[], Callable]) -> Callable:
        cell = self.made.get(key)
        if cell is None:
            cell = self.made[key] = []
            cell.append(make())
        return cell[0] if cell else lambda *a: cell[0](*a)


class _Reader(_Compiled):
    """Values of the writer's schema, resolved to the reader's. The schemas are interpreted once, not for each value."""

    def __init__(self, writer: Any, reader: Any, names: dict[str, dict] | None = None):
        super().__init__()
        self.writer_names = named(writer) if names is None else names
        self.reader_names = named(reader) if names is None else names
        self.skipping = self if names is not None else _Reader("null", "null", self.writer_names)
        self.read = self.of(writer, reader)

    def __call__(self, data: bytes) -> Any:
        value, at = self.read(data, 0)
        if at != len(data):
            raise LakeError("bytes left over after the Avro value")
        return value

    def of(self, w: Any, r: Any) -> Read:
        w = self.writer_names.get(w, w) if isinstance(w, str) else w
        r = self.reader_names.get(r, r) if isinstance(r, str) else r
        return self.once((id(w), id(r)), lambda: self.make(w, r))

    def make(self, w: Any, r: Any) -> Read:
        def fail(message: str) -> Read:
            def read(b: bytes, at: int) -> tuple[Any, int]:
                raise LakeError(message)

            return read

        if isinstance(w, list):
            branches = [self.of(x, r) for x in w]

            def union(b: bytes, at: int) -> tuple[Any, int]:
                i, at = _long(b, at)
                if not 0 <= i < len(branches):
                    raise LakeError(f"union branch {i} does not exist")
                return branches[i](b, at)

            return union
        if isinstance(r, list):
            several = len([x for x in r if x != "null"]) > 1
            for strict in (True, False):
                for branch in r:
                    full = self.reader_names.get(branch, branch) if isinstance(branch, str) else branch
                    if fits(w, full, strict):
                        inner, name = self.of(w, branch), _branch(full)
                        if not several or full == "null":
                            return inner

                        def marked(b: bytes, at: int) -> tuple[Any, int]:
                            value, at = inner(b, at)
                            return (name, value), at

                        return marked
            return fail(f"no branch for a written {_branch(w)}")
        if not fits(w, r, False):
            return fail(f"written {_branch(w)} can't be read as {_branch(r)}")
        return self.same(w, r)

    def same(self, w: Any, r: Any) -> Read:
        kind, wide, meaning = _kind(w), _kind(r), _logical(r) is not None
        if kind == "null":
            return lambda b, at: (None, at)
        if kind == "boolean":
            def boolean(b: bytes, at: int) -> tuple[Any, int]:
                data, at = _bytes(b, at, 1)
                return data != b"\x00", at

            return boolean
        if kind in ("int", "long"):
            if wide in ("float", "double"):
                def real(b: bytes, at: int) -> tuple[Any, int]:
                    n, at = _long(b, at)
                    return float(n), at

                return real
            if not meaning:
                return _long

            def number(b: bytes, at: int) -> tuple[Any, int]:
                n, at = _long(b, at)
                return from_logical(n, r), at

            return number
        if kind in ("float", "double"):
            form = struct.Struct("<f" if kind == "float" else "<d")

            def floating(b: bytes, at: int) -> tuple[Any, int]:
                data, at = _bytes(b, at, form.size)
                return form.unpack(data)[0], at

            return floating
        if kind in ("bytes", "string"):
            text = wide == "string"

            def data(b: bytes, at: int) -> tuple[Any, int]:
                n, at = _long(b, at)
                got, at = _bytes(b, at, n)
                return got.decode("utf-8") if text else from_logical(got, r) if meaning else got, at

            return data
        if kind == "fixed":
            def fixed(b: bytes, at: int) -> tuple[Any, int]:
                got, at = _bytes(b, at, w["size"])
                return from_logical(got, r), at

            return fixed
        if kind == "enum":
            known = {i: x for i, x in enumerate(w["symbols"]) if x in r["symbols"]}

            def enum(b: bytes, at: int) -> tuple[Any, int]:
                i, at = _long(b, at)
                if i not in known:
                    if "default" in r:
                        return r["default"], at
                    raise LakeError(f"symbol {w['symbols'][i] if 0 <= i < len(w['symbols']) else i} is unknown")
                return known[i], at

            return enum
        if kind in ("array", "map"):
            inner = self.of(w["items"], r["items"]) if kind == "array" else self.of(w["values"], r["values"])

            def several(b: bytes, at: int) -> tuple[Any, int]:
                out: Any = [] if kind == "array" else {}
                while True:
                    n, at = _long(b, at)
                    if n == 0:
                        return out, at
                    if n < 0:  # the block's size in bytes follows
                        n = -n
                        _, at = _long(b, at)
                    for _ in range(n):
                        if kind == "array":
                            value, at = inner(b, at)
                            out.append(value)
                        else:
                            size, at = _long(b, at)
                            key, at = _bytes(b, at, size)
                            out[key.decode("utf-8")], at = inner(b, at)

            return several
        return self.record(w, r)

    def record(self, w: dict, r: dict) -> Read:
        wanted: dict[str, dict] = {}
        for f in r["fields"]:
            wanted[f["name"]] = f
            for a in f.get("aliases", []):
                wanted.setdefault(a, f)
        steps: list[tuple[str | None, Read]] = []
        for f in w["fields"]:
            target = wanted.get(f["name"])
            steps.append((None, self.skipping.of(f["type"], f["type"])) if target is None else (target["name"], self.of(f["type"], target["type"])))
        filled = {name for name, _ in steps}
        absent = [f for f in r["fields"] if f["name"] not in filled]
        lost = next((f["name"] for f in absent if "default" not in f), None)
        order = [f["name"] for f in r["fields"]]

        def record(b: bytes, at: int) -> tuple[Any, int]:
            out = dict.fromkeys(order)
            for name, read in steps:
                value, at = read(b, at)
                if name is not None:
                    out[name] = value
            if lost is not None:
                raise LakeError(f"field {lost} was not written and has no default")
            for f in absent:
                out[f["name"]] = default_value(f["default"], f["type"], self.reader_names)
            return out, at

        return record


def from_logical(raw: Any, s: Any) -> Any:
    """A decoded primitive as its logical value."""
    logical = _logical(s)
    if logical is None:
        return raw
    kind = _kind(s)
    if logical == "decimal" and kind in ("bytes", "fixed"):
        return Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-s.get("scale", 0), WIDE)
    if kind == "int" and logical == "date":
        return dt.date(1970, 1, 1) + dt.timedelta(days=raw)
    if logical in ("time-millis", "time-micros"):
        return (dt.datetime.min + dt.timedelta(microseconds=raw * (1000 if logical == "time-millis" else 1))).time()
    if logical in ("timestamp-millis", "timestamp-micros", "local-timestamp-millis", "local-timestamp-micros"):
        at = EPOCH + dt.timedelta(microseconds=raw * (1000 if logical.endswith("millis") else 1))
        return at.replace(tzinfo=None) if logical.startswith("local") else at
    return raw


def to_logical(value: Any, s: Any) -> Any:
    """A logical value as the primitive that is encoded."""
    logical = _logical(s)
    if logical == "decimal" and _kind(s) in ("bytes", "fixed"):
        value = value if isinstance(value, Decimal) else Decimal(str(value))
        scaled = value.scaleb(s.get("scale", 0), WIDE)
        if scaled != scaled.to_integral_value(context=WIDE):
            raise LakeError(f"{value} has more than {s.get('scale', 0)} places")
        n = int(scaled)
        if len(str(abs(n))) > s["precision"]:
            raise LakeError(f"{value} has more than {s['precision']} digits")
        size = s["size"] if _kind(s) == "fixed" else max(1, (n.bit_length() + 8) // 8)
        return n.to_bytes(size, "big", signed=True)
    if isinstance(value, dt.datetime):
        at = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        us = (at - EPOCH) // dt.timedelta(microseconds=1)
        return us // 1000 if logical and logical.endswith("millis") else us
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days
    if isinstance(value, dt.time):
        us = ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond
        return us // 1000 if logical == "time-millis" else us
    return value


def default_value(value: Any, s: Any, names: dict) -> Any:
    """A default out of a schema's JSON."""
    s = names.get(s, s) if isinstance(s, str) else s
    kind = _kind(s)
    if kind == "union":
        first = names.get(s[0], s[0]) if isinstance(s[0], str) else s[0]
        own = default_value(value, first, names)
        return (_branch(first), own) if len([x for x in s if x != "null"]) > 1 and first != "null" else own
    if kind in ("bytes", "fixed"):
        return from_logical(value.encode("latin-1"), s)
    if kind == "array":
        return [default_value(v, s["items"], names) for v in value]
    if kind == "map":
        return {k: default_value(v, s["values"], names) for k, v in value.items()}
    if kind == "record":
        return {f["name"]: default_value(value[f["name"]] if f["name"] in value else f["default"], f["type"], names) for f in s["fields"]}
    return from_logical(value, s) if kind in ("int", "long") else value


def encode_long(n: int) -> bytes:
    return framing.zigzag(n)


class _Writer(_Compiled):
    """The binary form of values of a schema, which is interpreted once; null where the schema has none is an error."""

    def __init__(self, schema: Any):
        super().__init__()
        self.names = named(schema)
        self.write = self.of(schema)

    def __call__(self, value: Any) -> bytes:
        return self.write(value)

    def of(self, s: Any) -> Callable[[Any], bytes]:
        s = self.names.get(s, s) if isinstance(s, str) else s
        return self.once((id(s),), lambda: self.make(s))

    def make(self, s: Any) -> Callable[[Any], bytes]:
        kind = _kind(s)
        if kind == "union":
            return self.union(s)
        if kind == "null":
            return lambda value: b""
        inner, logical, name = self.plain(s, kind), _logical(s) is not None, _branch(s)

        def write(value: Any) -> bytes:
            if value is None:
                raise LakeError(f"null for a required {name}")
            return inner(to_logical(value, s) if logical or isinstance(value, (dt.date, dt.time)) else value)

        return write

    def union(self, s: list) -> Callable[[Any], bytes]:
        rest = [x for x in s if x != "null"]
        null = encode_long(s.index("null")) if "null" in s else None
        places = {_branch(self.names.get(x, x) if isinstance(x, str) else x): (encode_long(i), self.of(x)) for i, x in enumerate(s) if x != "null"}
        only = next(iter(places.values())) if len(rest) == 1 else None

        def write(value: Any) -> bytes:
            if value is not None and not only:
                name, value = value if isinstance(value, tuple) else next(((k, v) for k, v in value.items() if v is not None), (None, None))
                if name is not None and name not in places:
                    raise LakeError(f"no union branch {name}")
                value = None if name is None else (places[name], value)
            elif value is not None:
                value = (only, value)
            if value is None:
                if null is None:
                    raise LakeError("null for a union without null")
                return null
            (head, inner), own = value
            return head + inner(own)

        return write

    def plain(self, s: Any, kind: str) -> Callable[[Any], bytes]:
        if kind == "boolean":
            return lambda value: b"\x01" if value else b"\x00"
        if kind in ("int", "long"):
            most = 1 << (31 if kind == "int" else 63)

            def whole(value: Any) -> bytes:
                if not -most <= value < most:
                    raise LakeError(f"{value} does not fit {kind}")
                return encode_long(int(value))

            return whole
        if kind in ("float", "double"):
            return struct.Struct("<f" if kind == "float" else "<d").pack
        if kind in ("bytes", "string"):
            def data(value: Any) -> bytes:
                value = value.encode("utf-8") if isinstance(value, str) else bytes(value)
                return encode_long(len(value)) + value

            return data
        if kind == "fixed":
            def fixed(value: Any) -> bytes:
                if len(value) != s["size"]:
                    raise LakeError(f"{len(value)} bytes for fixed {s['name']} of {s['size']}")
                return bytes(value)

            return fixed
        if kind == "enum":
            symbols = {x: encode_long(i) for i, x in enumerate(s["symbols"])}

            def enum(value: Any) -> bytes:
                if value not in symbols:
                    raise LakeError(f"symbol {value} is unknown")
                return symbols[value]

            return enum
        if kind in ("array", "map"):
            inner, key = self.of(s["items"] if kind == "array" else s["values"]), self.of("string")

            def several(value: Any) -> bytes:
                if not value:
                    return b"\x00"
                if kind == "array":
                    return encode_long(len(value)) + b"".join([inner(v) for v in value]) + b"\x00"
                items = list(value.items()) if isinstance(value, dict) else list(value)
                return encode_long(len(items)) + b"".join([key(k) + inner(v) for k, v in items]) + b"\x00"

            return several
        fields = [(f["name"], self.of(f["type"])) for f in s["fields"]]
        return lambda value: b"".join([write(value.get(name)) for name, write in fields])


def _jsonable(v: Any) -> Any:
    if isinstance(v, tuple):
        return {v[0]: _jsonable(v[1])}
    if isinstance(v, dict):
        return {k: _jsonable(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_jsonable(x) for x in v]
    if isinstance(v, bytes):
        return v.decode("latin-1")
    if isinstance(v, uuid.UUID):
        return str(v)
    return v


def to_columns(value: Any, s: Any, names: dict, open_: tuple[str, ...] = ()) -> Any:
    """A decoded value as what its Spark column holds."""
    s = names.get(s, s) if isinstance(s, str) else s
    if value is None:
        return None
    kind = _kind(s)
    if kind == "union":
        rest = [x for x in s if x != "null"]
        if len(rest) == 1:
            return to_columns(value, rest[0], names, open_)
        return {_branch(full): to_columns(value[1], full, names, open_) if value[0] == _branch(full) else None for full in (names.get(x, x) if isinstance(x, str) else x for x in rest)}
    if kind == "array":
        return [to_columns(v, s["items"], names, open_) for v in value]
    if kind == "map":
        return [(k, to_columns(v, s["values"], names, open_)) for k, v in value.items()]
    if kind == "record":
        if s["name"] in open_:
            return json.dumps(_jsonable(value))
        return {f["name"]: to_columns(value[f["name"]], f["type"], names, (*open_, s["name"])) for f in s["fields"]}
    if _logical(s) == "decimal" and s["precision"] > 38:
        return format(value, "f")
    return value


def _as_is(s: Any, names: dict) -> bool:
    """Whether a column holds decoded values just so."""
    s = names.get(s, s) if isinstance(s, str) else s
    kind = _kind(s)
    if kind == "union":
        rest = [x for x in s if x != "null"]
        return len(rest) == 1 and _as_is(rest[0], names)
    if kind == "array":
        return _as_is(s["items"], names)
    return kind not in ("map", "record") and not (_logical(s) == "decimal" and s["precision"] > 38)


def from_columns(value: Any, s: Any, names: dict, open_: tuple[str, ...] = ()) -> Any:
    """The other way round."""
    s = names.get(s, s) if isinstance(s, str) else s
    if value is None:
        return None
    kind = _kind(s)
    if kind == "union":
        rest = [x for x in s if x != "null"]
        if len(rest) == 1:
            return from_columns(value, rest[0], names, open_)
        for x in rest:
            full = names.get(x, x) if isinstance(x, str) else x
            if value.get(_branch(full)) is not None:
                return (_branch(full), from_columns(value[_branch(full)], full, names, open_))
        return None
    if kind == "array":
        return [from_columns(v, s["items"], names, open_) for v in value]
    if kind == "map":
        return {k: from_columns(v, s["values"], names, open_) for k, v in (value.items() if isinstance(value, dict) else value)}
    if kind == "record":
        if s["name"] in open_:
            return _from_json(json.loads(value), s, names)
        return {f["name"]: from_columns(value.get(f["name"]), f["type"], names, (*open_, s["name"])) for f in s["fields"]}
    return value


def _from_json(v: Any, s: Any, names: dict) -> Any:
    s = names.get(s, s) if isinstance(s, str) else s
    if v is None:
        return None
    kind = _kind(s)
    if kind == "union":
        rest = [x for x in s if x != "null"]
        if len(rest) == 1:
            return _from_json(v, rest[0], names)
        (name, own), = v.items()
        full = next(x for x in rest if _branch(names.get(x, x) if isinstance(x, str) else x) == name)
        return (name, _from_json(own, full, names))
    if kind == "record":
        return {f["name"]: _from_json(v.get(f["name"]), f["type"], names) for f in s["fields"]}
    if kind == "array":
        return [_from_json(x, s["items"], names) for x in v]
    if kind == "map":
        return {k: _from_json(x, s["values"], names) for k, x in v.items()}
    if kind in ("bytes", "fixed"):
        return v.encode("latin-1")
    return v


class AvroCodec(Codec):
    """Registry-framed Avro records of one reader schema.

    ``writer(id)`` gives a writer schema's text (a registry cache's method, or a dict's); columns come
    from the reader schema alone. The ids in a batch are looked up on the driver before it is
    decoded, so a task never calls the registry.
    """

    def __init__(self, schema: str | dict, writer: Callable[[int], str] | None = None, write_id: int | Callable[[], int] = 0):
        self.schema = parse(schema)
        if _kind(self.schema) != "record":
            raise LakeError("an Avro row must be a record")
        self.struct, self.writer, self.write_id = to_struct(schema), writer, write_id

    def decode(self, raw: DataFrame) -> DataFrame:
        rows = from_raw(raw)
        reader = self.schema
        if self.writer is not None:
            ids = [r[0] for r in rows.filter("__value is not null").select(framing.schema_id(F.col("__value"))).distinct().collect()]
            writers = {i: parse(self.writer(i)) for i in ids}
        else:
            writers = None
        fields = [T.StructField(ESCAPE + f.name if f.name in RESERVED else f.name, f.dataType, True, {**f.metadata, **({ORIGINAL: f.name} if f.name in RESERVED else {})}) for f in self.struct.fields]
        out = T.StructType([*[T.StructField(f.name, _loose(f.dataType), True) for f in fields], *[f for f in rows.schema.fields if f.name in RESERVED]])
        arrow = to_arrow_schema(out)
        names = named(reader)
        as_is = {f["name"]: _as_is(f["type"], names) for f in reader["fields"]}

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            readers: dict[int, _Reader] = {}
            for batch in batches:
                values = []
                for data in batch.column("__value").to_pylist():  # each an own record, parsed by functions made once
                    if data is None:
                        raise LakeError("an Avro record has no value")
                    if len(data) < 5 or data[0]:
                        raise LakeError("not a framed value")
                    i = int.from_bytes(data[1:5], "big")
                    if i not in readers:
                        readers[i] = _Reader(writers[i] if writers is not None else reader, reader)
                    values.append(readers[i](data[5:]))
                columns = []
                for k, f in enumerate(reader["fields"]):
                    column = [v[f["name"]] for v in values]
                    if not as_is[f["name"]]:
                        column = [to_columns(v, f["type"], names, (reader["name"],)) for v in column]
                    columns.append(pa.array(column, arrow.field(k).type))
                yield pa.RecordBatch.from_arrays([*columns, *[batch.column(f.name) for f in out.fields[len(columns) :]]], schema=arrow)

        decoded = rows.mapInArrow(task, out)
        for f in fields:
            if f.metadata:
                decoded = decoded.withMetadata(f.name, f.metadata)
        return decoded

    def encode(self, df: DataFrame) -> DataFrame:
        schema = self.schema
        names = named(schema)
        number = self.write_id() if callable(self.write_id) else self.write_id
        head = b"\x00" + number.to_bytes(4, "big")
        own = [c for c in payload(df)]
        original = [df.schema[c].metadata.get(ORIGINAL, c) for c in own]
        missing = [f["name"] for f in schema["fields"] if f["name"] not in original]
        if missing:
            raise LakeError(f"column does not exist: {missing[0]}")
        kept = metadata(df)
        out = T.StructType([T.StructField("__value", T.BinaryType()), *[df.schema[c] for c in kept]])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            write = _Writer(schema)
            fields = [(f["name"], write.of(f["type"]), None if _as_is(f["type"], names) else f["type"]) for f in schema["fields"]]
            for batch in batches:
                columns = {n: batch.column(c).to_pylist() for c, n in zip(own, original)}
                parts = []
                for name, encode, kind in fields:
                    column = columns[name] if kind is None else [from_columns(v, kind, names, (schema["name"],)) for v in columns[name]]
                    parts.append(map(encode, column))
                values = [head + b"".join(x) for x in zip(*parts)] if parts else [head] * batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), *[batch.column(c) for c in kept]], ["__value", *kept])

        return to_raw(df.select(*own, *kept).mapInArrow(task, out))


def _loose(t: T.DataType) -> T.DataType:
    """``t`` with everything nullable."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType), True, f.metadata) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_loose(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, _loose(t.valueType), True)
    return t


def decode_value(data: bytes, reader: str | dict, writer: str | dict | None = None) -> Any:
    """One unframed value, resolved from the writer's to the reader's schema."""
    r = parse(reader)
    return _Reader(parse(writer) if writer is not None else r, r)(data)


def encode_value(value: Any, schema: str | dict) -> bytes:
    """One unframed value."""
    return _Writer(parse(schema))(value)
