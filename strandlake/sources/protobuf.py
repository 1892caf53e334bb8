"""Protobuf: message descriptors as Spark types, rows to messages and back, a registry-framed codec, schema printing.

Needs the google.protobuf package; importing this module without it raises.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory
from google.protobuf.descriptor import Descriptor, FieldDescriptor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import LakeError
from ..records import ESCAPE, ORIGINAL, RESERVED, from_raw, metadata, payload, to_raw
from . import framing
from .avro import _loose
from .codecs import Codec

META = "strandlake.proto."
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
WRAPPERS = ("DoubleValue", "FloatValue", "Int64Value", "UInt64Value", "Int32Value", "UInt32Value", "BoolValue", "StringValue", "BytesValue")
DYNAMIC = ("google.protobuf.Struct", "google.protobuf.Value", "google.protobuf.ListValue")

_SCALARS = {
    FieldDescriptor.TYPE_DOUBLE: T.DoubleType(), FieldDescriptor.TYPE_FLOAT: T.FloatType(),
    FieldDescriptor.TYPE_INT32: T.IntegerType(), FieldDescriptor.TYPE_SINT32: T.IntegerType(), FieldDescriptor.TYPE_SFIXED32: T.IntegerType(),
    FieldDescriptor.TYPE_INT64: T.LongType(), FieldDescriptor.TYPE_SINT64: T.LongType(), FieldDescriptor.TYPE_SFIXED64: T.LongType(),
    FieldDescriptor.TYPE_UINT32: T.LongType(), FieldDescriptor.TYPE_FIXED32: T.LongType(),
    FieldDescriptor.TYPE_UINT64: T.DecimalType(20, 0), FieldDescriptor.TYPE_FIXED64: T.DecimalType(20, 0),
    FieldDescriptor.TYPE_BOOL: T.BooleanType(), FieldDescriptor.TYPE_STRING: T.StringType(), FieldDescriptor.TYPE_BYTES: T.BinaryType(),
    FieldDescriptor.TYPE_ENUM: T.StringType(),
}


def load(files: list[bytes], message: str) -> Descriptor:
    """The descriptor of a message in serialized FileDescriptorProtos (imports first; well-known types need not be given)."""
    pool = descriptor_pool.DescriptorPool()
    from google.protobuf import struct_pb2, timestamp_pb2, wrappers_pb2

    for known in (timestamp_pb2, wrappers_pb2, struct_pb2):
        proto = descriptor_pb2.FileDescriptorProto()
        known.DESCRIPTOR.CopyToProto(proto)
        pool.Add(proto)
    for data in files:
        proto = descriptor_pb2.FileDescriptorProto.FromString(data)
        if not proto.name.startswith("google/protobuf/"):
            pool.Add(proto)
    return pool.FindMessageTypeByName(message)


def files_of(descriptor: Descriptor) -> list[bytes]:
    """The serialized files that a message needs, imports first; :func:`load` takes them."""
    seen: dict[str, bytes] = {}

    def add(f) -> None:
        if f.name in seen:
            return
        for d in f.dependencies:
            add(d)
        seen[f.name] = f.serialized_pb

    add(descriptor.file)
    return list(seen.values())


def _repeated(f: FieldDescriptor) -> bool:
    return f.is_repeated if hasattr(f, "is_repeated") else f.label == FieldDescriptor.LABEL_REPEATED


def _is_map(f: FieldDescriptor) -> bool:
    return f.type == FieldDescriptor.TYPE_MESSAGE and f.message_type.GetOptions().map_entry


def to_struct(d: Descriptor) -> T.StructType:
    """Spark columns of a message. Fields with presence are nullable, others hold defaults; oneof members name their oneof."""

    def single(f: FieldDescriptor, open_: tuple[str, ...]) -> tuple[T.DataType, dict]:
        if f.type == FieldDescriptor.TYPE_GROUP:
            raise LakeError(f"groups are not supported: {f.full_name}")
        if f.type == FieldDescriptor.TYPE_ENUM:
            return T.StringType(), {META + "enum": f.enum_type.full_name}
        if f.type != FieldDescriptor.TYPE_MESSAGE:
            unsigned = f.type in (FieldDescriptor.TYPE_UINT64, FieldDescriptor.TYPE_FIXED64)
            return _SCALARS[f.type], {META + "unsigned": True} if unsigned else {}
        m = f.message_type
        if m.full_name == "google.protobuf.Timestamp":
            return T.TimestampType(), {META + "message": m.full_name}
        if m.full_name.removeprefix("google.protobuf.") in WRAPPERS and m.full_name.startswith("google.protobuf."):
            return _SCALARS[m.fields_by_name["value"].type], {META + "message": m.full_name}
        if m.full_name in DYNAMIC or m.full_name in open_:
            return T.StringType(), {META + "json": True, META + "message": m.full_name}
        return struct(m, open_), {META + "message": m.full_name}

    def struct(m: Descriptor, open_: tuple[str, ...]) -> T.StructType:
        open_ = (*open_, m.full_name)
        fields = []
        for f in m.fields:
            meta: dict[str, Any] = {META + "number": f.number}
            if f.containing_oneof is not None and not f.containing_oneof.name.startswith("_"):
                meta[META + "oneof"] = f.containing_oneof.name
            if _is_map(f):
                k, _ = single(f.message_type.fields_by_name["key"], open_)
                v, more = single(f.message_type.fields_by_name["value"], open_)
                fields.append(T.StructField(f.name, T.MapType(k, v, True), False, meta | more))
            elif _repeated(f):
                t, more = single(f, open_)
                fields.append(T.StructField(f.name, T.ArrayType(t, False), False, meta | more))
            else:
                t, more = single(f, open_)
                fields.append(T.StructField(f.name, t, f.has_presence, meta | more))
        return T.StructType(fields)

    return struct(d, ())


def to_row(m: Any, open_: tuple[str, ...] = ()) -> dict[str, Any]:
    """A message as a row."""
    open_ = (*open_, m.DESCRIPTOR.full_name)

    def one(f: FieldDescriptor, v: Any) -> Any:
        if f.type == FieldDescriptor.TYPE_ENUM:
            known = f.enum_type.values_by_number.get(v)
            return known.name if known else str(v)
        if f.type in (FieldDescriptor.TYPE_UINT64, FieldDescriptor.TYPE_FIXED64):
            return Decimal(v)
        if f.type != FieldDescriptor.TYPE_MESSAGE:
            return v
        name = f.message_type.full_name
        if name == "google.protobuf.Timestamp":  # what is below a microsecond is cut off
            return EPOCH + dt.timedelta(seconds=v.seconds, microseconds=v.nanos // 1000)
        if name.startswith("google.protobuf.") and name.removeprefix("google.protobuf.") in WRAPPERS:
            return one(f.message_type.fields_by_name["value"], v.value)
        if name in DYNAMIC or name in open_:
            return json_format.MessageToJson(v, indent=None, preserving_proto_field_name=True)
        return to_row(v, open_)

    out = {}
    for f in m.DESCRIPTOR.fields:
        if _is_map(f):
            vf = f.message_type.fields_by_name["value"]
            items = getattr(m, f.name)
            out[f.name] = [(k, one(vf, items[k])) for k in items]
        elif _repeated(f):
            out[f.name] = [one(f, v) for v in getattr(m, f.name)]
        elif f.has_presence and not m.HasField(f.name):
            out[f.name] = None
        else:
            out[f.name] = one(f, getattr(m, f.name))
    return out


def from_row(m: Any, row: dict[str, Any], open_: tuple[str, ...] = ()) -> Any:
    """Fills message ``m`` from a row."""
    open_ = (*open_, m.DESCRIPTOR.full_name)

    def scalar(f: FieldDescriptor, v: Any) -> Any:
        if f.type == FieldDescriptor.TYPE_ENUM:
            known = f.enum_type.values_by_name.get(v)
            if known is None and not v.lstrip("-").isdigit():
                raise LakeError(f"{v} is no symbol of {f.enum_type.full_name}")
            return known.number if known else int(v)
        if f.cpp_type in (FieldDescriptor.CPPTYPE_INT32, FieldDescriptor.CPPTYPE_INT64, FieldDescriptor.CPPTYPE_UINT32, FieldDescriptor.CPPTYPE_UINT64):
            return int(v)
        return v

    def fill(target: Any, f: FieldDescriptor, v: Any) -> None:
        name = f.message_type.full_name
        if name == "google.protobuf.Timestamp":
            at = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
            us = (at - EPOCH) // dt.timedelta(microseconds=1)
            target.seconds, target.nanos = us // 1_000_000, us % 1_000_000 * 1000
        elif name.startswith("google.protobuf.") and name.removeprefix("google.protobuf.") in WRAPPERS:
            target.value = scalar(f.message_type.fields_by_name["value"], v)
            target.SetInParent()
        elif name in DYNAMIC or name in open_:
            json_format.Parse(v, target)
            target.SetInParent()
        else:
            from_row(target, v, open_)
            target.SetInParent()

    for f in m.DESCRIPTOR.fields:
        v = row.get(f.name)
        if v is None:
            continue
        field = getattr(m, f.name)
        if _is_map(f):
            kf, vf = f.message_type.fields_by_name["key"], f.message_type.fields_by_name["value"]
            for k, x in v.items() if isinstance(v, dict) else v:
                if x is None:
                    raise LakeError(f"null value in map {f.full_name}")
                if vf.type == FieldDescriptor.TYPE_MESSAGE:
                    fill(field[scalar(kf, k)], vf, x)
                else:
                    field[scalar(kf, k)] = scalar(vf, x)
        elif _repeated(f):
            for x in v:
                if x is None:
                    raise LakeError(f"null element in {f.full_name}")
                fill(field.add(), f, x) if f.type == FieldDescriptor.TYPE_MESSAGE else field.append(scalar(f, x))
        elif f.type == FieldDescriptor.TYPE_MESSAGE:
            fill(field, f, v)
        else:
            setattr(m, f.name, scalar(f, v))
    return m


def index_path(d: Descriptor) -> list[int]:
    """Where a message lies in its file: indexes from the outermost message inwards."""
    path = []
    while d is not None:
        siblings = d.containing_type.nested_types if d.containing_type is not None else list(d.file.message_types_by_name.values())
        path.append([s.full_name for s in siblings].index(d.full_name))
        d = d.containing_type
    return path[::-1]


class ProtobufCodec(Codec):
    """Registry-framed messages of one type. Unknown fields of newer writers are skipped; another index path is an error."""

    def __init__(self, descriptor: Descriptor, write_id: int | Callable[[], int] = 0):
        self.files, self.name = files_of(descriptor), descriptor.full_name
        self.struct, self.path, self.write_id = to_struct(descriptor), index_path(descriptor), write_id

    def decode(self, raw: DataFrame) -> DataFrame:
        rows = from_raw(raw)
        files, name, path = self.files, self.name, self.path
        fields = [T.StructField(ESCAPE + f.name if f.name in RESERVED else f.name, f.dataType, True, {**f.metadata, **({ORIGINAL: f.name} if f.name in RESERVED else {})}) for f in self.struct.fields]
        out = T.StructType([*[T.StructField(f.name, _loose(f.dataType), True) for f in fields], *[f for f in rows.schema.fields if f.name in RESERVED]])
        arrow = to_arrow_schema(out)
        names = [f.name for f in self.struct.fields]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = message_factory.GetMessageClass(load(files, name))
            for batch in batches:
                values = []
                for data in batch.column("__value").to_pylist():
                    if data is None:
                        raise LakeError("a Protobuf record has no value")
                    _, at, body = framing.unframe_protobuf(data)
                    if at != path:
                        raise LakeError(f"written message {at} is not {name}")
                    try:
                        values.append(to_row(make.FromString(body)))
                    except Exception as e:
                        raise LakeError(f"not a {name}: {e}") from e
                columns = [pa.array([v[n] for v in values], arrow.field(k).type) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*columns, *[batch.column(f.name) for f in out.fields[len(columns) :]]], schema=arrow)

        decoded = rows.mapInArrow(task, out)
        for f in fields:
            if f.metadata:
                decoded = decoded.withMetadata(f.name, f.metadata)
        return decoded

    def encode(self, df: DataFrame) -> DataFrame:
        files, name, path = self.files, self.name, self.path
        number = self.write_id() if callable(self.write_id) else self.write_id
        own, kept = payload(df), metadata(df)
        original = [df.schema[c].metadata.get(ORIGINAL, c) for c in own]
        out = T.StructType([T.StructField("__value", T.BinaryType()), *[df.schema[c] for c in kept]])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = message_factory.GetMessageClass(load(files, name))
            for batch in batches:
                columns = {n: batch.column(c).to_pylist() for c, n in zip(own, original)}
                values = [framing.frame_protobuf(from_row(make(), {n: v[i] for n, v in columns.items()}).SerializeToString(deterministic=True), number, path) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), *[batch.column(c) for c in kept]], ["__value", *kept])

        return to_raw(df.select(*own, *kept).mapInArrow(task, out))


_NAMES = {v: k.removeprefix("TYPE_").lower() for k, v in vars(FieldDescriptor).items() if k.startswith("TYPE_")}
#: Options that a printed schema keeps, by where they stand.
_OPTIONS = {
    "file": ("java_package", "java_outer_classname", "java_multiple_files", "optimize_for", "go_package", "cc_enable_arenas", "objc_class_prefix", "csharp_namespace", "swift_prefix", "php_namespace", "ruby_package", "deprecated"),
    "message": ("message_set_wire_format", "no_standard_descriptor_accessor", "deprecated"),
    "enum": ("allow_alias", "deprecated"), "value": ("deprecated",), "field": ("ctype", "packed", "jstype", "lazy", "deprecated"), "service": ("deprecated",), "method": ("deprecated", "idempotency_level"),
}


def _quoted(text: str, escaped: bool = False) -> str:
    """Text as a quoted literal; ``escaped`` if it holds escapes already, as defaults of bytes do."""
    if not escaped:
        text = text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        text = text.replace('"', '\\"')
    return f'"{text}"'


def _options(options: Any, place: str) -> list[str]:
    """``name = value`` of the options that are set."""
    out = []
    for name in _OPTIONS[place]:
        if not options.HasField(name):
            continue
        field, value = options.DESCRIPTOR.fields_by_name[name], getattr(options, name)
        if field.enum_type is not None:
            value = field.enum_type.values_by_number[value].name
        elif isinstance(value, bool):
            value = str(value).lower()
        elif isinstance(value, str):
            value = _quoted(value)
        out.append(f"{name} = {value}")
    return out


class _Printer:
    """Lines of a .proto file."""

    def __init__(self, proto3: bool):
        self.proto3, self.lines, self.depth = proto3, [], 0

    def say(self, text: str) -> None:
        self.lines.append("  " * self.depth + text)

    def open(self, text: str) -> None:
        self.say(text + " {")
        self.depth += 1

    def close(self) -> None:
        self.depth -= 1
        self.say("}")

    def options(self, options: Any, place: str) -> None:
        for o in _options(options, place):
            self.say(f"option {o};")

    def reserved(self, ranges: list[tuple[int, int]], names: Any, most: int) -> None:
        """Ranges with both ends in them."""
        if ranges:
            self.say(f"reserved {self.ranges(ranges, most)};")
        if names:
            self.say("reserved " + ", ".join(map(_quoted, names)) + ";")

    @staticmethod
    def ranges(ranges: list[tuple[int, int]], most: int) -> str:
        return ", ".join(str(a) if a == b else f"{a} to {'max' if b >= most else b}" for a, b in ranges)

    def enum(self, e: Any) -> None:
        self.open(f"enum {e.name}")
        self.options(e.options, "enum")
        self.reserved([(r.start, r.end) for r in e.reserved_range], e.reserved_name, 2**31 - 1)
        for v in e.value:
            own = _options(v.options, "value")
            self.say(f"{v.name} = {v.number}{' [' + ', '.join(own) + ']' if own else ''};")
        self.close()

    def field(self, f: Any, inner: dict[str, Any], plain: bool = False) -> None:
        """A field; ``inner``: the nested messages of its message by full name, for maps and groups. ``plain``: in a oneof."""
        nested = inner.get(f.type_name)
        label = {1: "" if self.proto3 and not f.proto3_optional else "optional ", 2: "required ", 3: "repeated "}[f.label]
        kind = f.type_name or _NAMES[f.type]
        if nested is not None and nested.options.map_entry:
            label, kind = "", "map<{}, {}>".format(*(x.type_name or _NAMES[x.type] for x in nested.field))
        own = _options(f.options, "field")
        if f.HasField("default_value"):
            text = f.type in (FieldDescriptor.TYPE_STRING, FieldDescriptor.TYPE_BYTES)
            own.insert(0, "default = " + (_quoted(f.default_value, f.type == FieldDescriptor.TYPE_BYTES) if text else f.default_value))
        tail = f" = {f.number}{' [' + ', '.join(own) + ']' if own else ''}"
        label = "" if plain else label
        if f.type == FieldDescriptor.TYPE_GROUP and nested is not None:
            self.open(f"{label}group {nested.name}{tail}")
            self.body(nested, f.type_name)
            self.close()
        else:
            self.say(f"{label}{kind} {f.name}{tail};")

    def extensions(self, fields: Any, inner: dict[str, Any]) -> None:
        for target in dict.fromkeys(f.extendee for f in fields):
            self.open(f"extend {target}")
            for f in fields:
                if f.extendee == target:
                    self.field(f, inner)
            self.close()

    def message(self, m: Any, full: str) -> None:
        self.open(f"message {m.name}")
        self.body(m, full)
        self.close()

    def body(self, m: Any, full: str) -> None:
        self.options(m.options, "message")
        self.reserved([(r.start, r.end - 1) for r in m.reserved_range], m.reserved_name, 2**29 - 1)
        if m.extension_range:
            self.say(f"extensions {self.ranges([(r.start, r.end - 1) for r in m.extension_range], 2**29 - 1)};")
        inner = {f"{full}.{n.name}": n for n in m.nested_type}
        groups = {f.type_name for f in (*m.field, *m.extension) if f.type == FieldDescriptor.TYPE_GROUP}
        for e in m.enum_type:
            self.enum(e)
        for name, n in inner.items():
            if not n.options.map_entry and name not in groups:
                self.message(n, name)
        # A lone member that stands for "optional" makes a oneof that isn't written.
        members: dict[int, list[Any]] = {}
        for f in m.field:
            if f.HasField("oneof_index") and not f.proto3_optional:
                members.setdefault(f.oneof_index, []).append(f)
        for f in m.field:
            own = members.get(f.oneof_index) if f.HasField("oneof_index") else None
            if not own:
                self.field(f, inner)
            elif own[0] is f or own[0].number == f.number:
                self.open(f"oneof {m.oneof_decl[f.oneof_index].name}")
                for g in own:
                    self.field(g, inner, plain=True)
                self.close()
        self.extensions(m.extension, inner)

    def service(self, s: Any) -> None:
        self.open(f"service {s.name}")
        self.options(s.options, "service")
        for r in s.method:
            sides = [("stream " if streams else "") + name for streams, name in ((r.client_streaming, r.input_type), (r.server_streaming, r.output_type))]
            head, own = f"rpc {r.name} ({sides[0]}) returns ({sides[1]})", _options(r.options, "method")
            if own:
                self.open(head)
                self.options(r.options, "method")
                self.close()
            else:
                self.say(head + ";")
        self.close()


def print_schema(file: Any) -> str:
    """A file descriptor as .proto text: syntax, package, imports, options, enums, messages, extensions, services.

    Options of Protobuf itself are kept; custom ones are not.
    """
    proto = descriptor_pb2.FileDescriptorProto()
    file.CopyToProto(proto)
    out = _Printer(proto.syntax == "proto3")
    out.say(f"syntax = {_quoted(proto.syntax or 'proto2')};")
    if proto.package:
        out.say(f"package {proto.package};")
    for i, name in enumerate(proto.dependency):
        out.say(f"import {'public ' if i in proto.public_dependency else 'weak ' if i in proto.weak_dependency else ''}{_quoted(name)};")
    out.options(proto.options, "file")
    for e in proto.enum_type:
        out.enum(e)
    space = f".{proto.package}" if proto.package else ""
    for m in proto.message_type:
        out.message(m, f"{space}.{m.name}")
    out.extensions(proto.extension, {})
    for s in proto.service:
        out.service(s)
    return "\n".join(out.lines) + "\n"
