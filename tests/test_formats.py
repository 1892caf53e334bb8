import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.errors import LakeError, RegistryError, SchemaPending
from strandlake.functions.jsonschema import dialect, errors
from strandlake.records import RAW
from strandlake.sources import avro, compatibility, framing
from strandlake.sources.codecs import JsonCodec
from strandlake.sources.compatibility import Mode
from strandlake.sources.registry import JsonSerde, RegisterMode, RegistryClient, RegistryStub, Role, Schema, SchemaCache, avro_codec, protobuf_codec, topic_name


def record(name, **fields):
    """An Avro record; a field is a type, or (type, default)."""
    return {"type": "record", "name": name, "fields": [{"name": n, "type": t[0], "default": t[1]} if isinstance(t, tuple) else {"name": n, "type": t} for n, t in fields.items()]}


def logical(base, kind, **more):
    return {**(base if isinstance(base, dict) else {"type": base}), "logicalType": kind, **more}


READING = record("lab.Reading", station="string", celsius="double")
READING_WITH_REMARK = record("lab.Reading", station="string", celsius="double", remark="string")
#: Every type without inner ones: schema and a value.
PLAIN = {
    "ratio": ("float", 0.25), "far": ("double", -1e300), "steps": ("int", -(2**31)), "ticks": ("long", 2**63 - 1), "on": ("boolean", False), "blob": ("bytes", b"\xff\x00"), "label": ("string", "naïve ☃"),
    "cost": (logical("bytes", "decimal", precision=7, scale=3), Decimal("-12.005")), "mass": (logical({"type": "fixed", "name": "Mass", "size": 28}, "decimal", precision=60, scale=10), Decimal("1" * 45 + ".0000000001")),
    "key": (logical("string", "uuid"), "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), "born": (logical("int", "date"), dt.date(1969, 7, 20)), "wake": (logical("int", "time-millis"), dt.time(6, 30, 0, 5000)),
    "exact": (logical("long", "time-micros"), dt.time(0, 0, 0, 1)), "sent": (logical("long", "timestamp-micros"), dt.datetime(1999, 12, 31, 23, 59, 59, 1, dt.timezone.utc)), "wall": (logical("long", "local-timestamp-millis"), dt.datetime(2040, 2, 29, 12, 0, 0, 250000)),
    "spare": (["null", "double"], None),
}
INNER = record(
    "Flight",
    route=record("Route", start="string", stops={"type": "array", "items": "int"}),
    fares={"type": "map", "values": ["null", "float"]},
    cabin={"type": "enum", "name": "Cabin", "symbols": ["FRONT", "MIDDLE", "REAR"]},
    tag={"type": "fixed", "name": "Tag", "size": 3},
    gate=["string", "long", "boolean"],
)
FLIGHT = {"route": {"start": "OSL", "stops": [4, -7]}, "fares": {"low": 9.5, "none": None}, "cabin": "REAR", "tag": b"abc", "gate": ("long", 17)}
TREE = record("Branch", width="int", twigs={"type": "array", "items": "Branch"})


def framed(spark, *bodies, number=1):
    return spark.createDataFrame([(None, b"\x00" + number.to_bytes(4, "big") + b, 5, 0, i, []) for i, b in enumerate(bodies)], RAW)


@pytest.mark.parametrize("number", [0, 1, 70_000, 2**31 - 1])
def test_frames(spark, number):
    df = spark.createDataFrame([(b"payload",), (b"",), (None,)], "b binary").select("b", framing.frame(F.col("b"), number).alias("f"))
    for body, f in df.collect():
        assert f is None if body is None else bytes(f) == b"\x00" + number.to_bytes(4, "big") + bytes(body)
    back = df.filter("f is not null").select("b", framing.schema_id(F.col("f")).alias("n"), framing.body(F.col("f")).alias("again")).collect()
    assert all(r["n"] == number and r["again"] == r["b"] for r in back)


@pytest.mark.parametrize("bad", [b"", b"\x00\x01", b"\x07\x00\x00\x00\x01body"])
def test_broken_frames_are_errors(spark, bad):
    with pytest.raises(Exception, match="shorter|magic"):
        spark.createDataFrame([(bad,)], "f binary").select(framing.schema_id(F.col("f"))).collect()
    with pytest.raises(LakeError):
        framing.unframe_protobuf(bad)


@pytest.mark.parametrize("path", [[0], [1], [0, 0], [3, 200, 5], [2**20]])
def test_protobuf_frames(path):
    data = framing.frame_protobuf(b"tail", 513, path)
    assert framing.unframe_protobuf(data) == (513, path, b"tail")
    for cut in range(5, len(data) - 4):
        if path != [0]:
            with pytest.raises(LakeError):
                framing.unframe_protobuf(data[:cut])
    for n in (0, -1, 1, 63, -64, 64, 2**40, -(2**40)):
        assert framing.read_zigzag(framing.zigzag(n), 0) == (n, len(framing.zigzag(n)))


def test_avro_schemas_as_spark_types():
    struct = avro.to_struct(record("Plain", **{n: t for n, (t, _) in PLAIN.items()}))
    want = {"ratio": T.FloatType(), "far": T.DoubleType(), "steps": T.IntegerType(), "ticks": T.LongType(), "on": T.BooleanType(), "blob": T.BinaryType(), "label": T.StringType(), "cost": T.DecimalType(7, 3), "mass": T.StringType(), "key": T.StringType(), "born": T.DateType(), "wake": T.TimeType(3), "exact": T.TimeType(6), "sent": T.TimestampType(), "wall": T.TimestampNTZType(), "spare": T.DoubleType()}
    assert {f.name: f.dataType for f in struct} == want
    assert [f.name for f in struct if f.nullable] == ["spare"] and struct["mass"].metadata["strandlake.avro.precision"] == 60
    inner = avro.to_struct(INNER)
    assert inner["fares"].dataType == T.MapType(T.StringType(), T.FloatType(), True) and inner["gate"].dataType.names == ["string", "long", "boolean"]
    assert avro.to_struct(TREE)["twigs"].dataType.elementType == T.StringType()  # a branch of a branch is JSON text
    assert avro.to_struct('"boolean"').names == ["value"]
    for bad in ("null", logical("bytes", "decimal", precision=77, scale=0)):
        with pytest.raises(LakeError):
            avro.to_struct(record("Bad", x=bad))


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_avro_values_of_each_type(name):
    kind, value = PLAIN[name]
    schema = record("One", x=kind)
    assert avro.decode_value(avro.encode_value({"x": value}, schema), schema) == {"x": value}


def test_avro_through_the_codec(spark):
    plain = record("Plain", **{n: t for n, (t, _) in PLAIN.items()})
    tree = {"width": 5, "twigs": [{"width": 3, "twigs": []}, {"width": 2, "twigs": [{"width": 1, "twigs": []}]}]}
    for schema, value in ((plain, {n: v for n, (_, v) in PLAIN.items()}), (INNER, FLIGHT), (TREE, tree)):
        body = avro.encode_value(value, schema)
        codec = avro.AvroCodec(schema, write_id=77)
        df = codec.decode(framed(spark, body, body))
        assert df.columns[: len(value)] == list(value)
        assert [bytes(r["value"]) for r in codec.encode(df).collect()] == 2 * [b"\x00" + (77).to_bytes(4, "big") + body]
    row = avro.AvroCodec(INNER).decode(framed(spark, avro.encode_value(FLIGHT, INNER))).head()
    assert row["route"]["stops"] == [4, -7] and row["fares"] == {"low": 9.5, "none": None} and (row["gate"]["long"], row["gate"]["string"], row["cabin"]) == (17, None, "REAR")
    row = avro.AvroCodec(TREE).decode(framed(spark, avro.encode_value(tree, TREE))).head()
    assert [json.loads(t) for t in row["twigs"]] == tree["twigs"]


def test_avro_readers_and_writers_differ():
    told = {"station": "north", "celsius": -3.5, "remark": "windy"}
    assert avro.decode_value(avro.encode_value(told, READING_WITH_REMARK), READING, READING_WITH_REMARK) == {"station": "north", "celsius": -3.5}
    ints = record("lab.Reading", station="string", degrees="int")
    newer = {"type": "record", "name": "lab.Reading", "fields": [{"name": "unit", "type": "string", "default": "C"}, {"name": "celsius", "aliases": ["degrees"], "type": "float"}, {"name": "station", "type": "bytes"}]}
    assert avro.decode_value(avro.encode_value({"station": "x", "degrees": 8}, ints), newer, ints) == {"unit": "C", "celsius": 8.0, "station": b"x"}
    body = avro.encode_value({"station": "x", "celsius": 1.0}, READING)
    for data, reader, word in ((body, READING_WITH_REMARK, "no default"), (body[:-1], READING, "cut off"), (body + b"\x00", READING, "left over")):
        with pytest.raises(LakeError, match=word):
            avro.decode_value(data, reader, READING)
    with pytest.raises(LakeError, match="null for a required"):
        avro.encode_value({"station": "x", "celsius": None}, READING)
    assert avro.canonical({**READING, "doc": "gone", "aliases": ["Old"]}) == '{"name":"lab.Reading","type":"record","fields":[{"name":"station","type":"string"},{"name":"celsius","type":"double"}]}'


@pytest.fixture(scope="module")
def parcel():
    """A message with each kind of field, in a file with a message before it."""
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2 as d

    from strandlake.sources import protobuf as P

    text, big, whole, real, raw, yes, kind, sub = 9, 3, 17, 2, 12, 8, 14, 11
    f = d.FileDescriptorProto(name="depot/parcel.proto", package="depot", syntax="proto3", dependency=[f"google/protobuf/{n}.proto" for n in ("struct", "timestamp", "wrappers")])
    f.message_type.add(name="Depot").field.add(name="city", number=1, type=text, label=1)
    m = f.message_type.add(name="Parcel")
    state = m.enum_type.add(name="State")
    for i, n in enumerate(("PACKED", "MOVING", "GIVEN")):
        state.value.add(name=n, number=i)
    part = m.nested_type.add(name="Part")
    part.field.add(name="grams", number=1, type=13, label=1)
    part.field.add(name="parts", number=2, type=sub, label=3, type_name=".depot.Parcel.Part")
    entry = m.nested_type.add(name="CountsEntry")
    entry.options.map_entry = True
    entry.field.add(name="key", number=1, type=text, label=1)
    entry.field.add(name="value", number=2, type=whole, label=1)
    wrap = {"type_name": ".google.protobuf.Int32Value"}
    for number, (name, type_, more) in {
        2: ("weight", real, {}), 3: ("serial", 4, {}), 4: ("offset", big, {}), 7: ("sealed", yes, {}), 8: ("stamp", raw, {}), 9: ("state", kind, {"type_name": ".depot.Parcel.State"}), 10: ("first", sub, {"type_name": ".depot.Parcel.Part"}),
        11: ("signs", text, {"label": 3}), 12: ("counts", sub, {"label": 3, "type_name": ".depot.Parcel.CountsEntry"}), 15: ("left", sub, {"type_name": ".google.protobuf.Timestamp"}), 16: ("floor", sub, wrap), 17: ("notes", sub, {"type_name": ".google.protobuf.Value"}),
        20: ("by_road", text, {"oneof_index": 0}), 21: ("by_air", yes, {"oneof_index": 0}),
    }.items():
        m.field.add(**{"name": name, "number": number, "type": type_, "label": 1, **more})
    m.oneof_decl.add(name="way")
    m.reserved_range.add(start=5, end=7)
    m.reserved_name.append("colour")
    s = f.service.add(name="Tracking")
    s.method.add(name="Follow", input_type=".depot.Depot", output_type=".depot.Parcel", server_streaming=True)
    return P.load([f.SerializeToString()], "depot.Parcel")


def test_protobuf_types(parcel):
    from strandlake.sources import protobuf as P

    s = P.to_struct(parcel)
    assert s["serial"].dataType == T.DecimalType(20, 0) and s["counts"].dataType == T.MapType(T.StringType(), T.IntegerType(), True) and s["signs"].dataType == T.ArrayType(T.StringType(), False)
    assert s["first"].dataType["grams"].dataType == T.LongType() and s["first"].dataType["parts"].dataType == T.ArrayType(T.StringType(), False) and s["left"].dataType == T.TimestampType()
    assert {f.name for f in s if f.nullable} == {"first", "left", "floor", "notes", "by_road", "by_air"} and s["by_air"].metadata["strandlake.proto.oneof"] == "way"


def test_protobuf_through_the_codec(spark, parcel):
    from google.protobuf import message_factory

    from strandlake.sources import protobuf as P

    make = message_factory.GetMessageClass(parcel)
    full = make(weight=1.5, serial=2**64 - 2, offset=-(2**63), sealed=True, stamp=b"\x00\x09", state=2, signs=["", "x"], counts={"a": -1, "b": 2}, by_air=False)
    full.first.grams = 2**32 - 1
    full.first.parts.add(grams=4)
    full.left.FromSeconds(-1)
    full.left.nanos = 999_999_999
    full.floor.value = 0
    full.notes.list_value.values.add(bool_value=True)
    strange = make(state=41)
    codec = P.ProtobufCodec(parcel, 9)
    assert codec.path == [1]
    raw = spark.createDataFrame([(None, framing.frame_protobuf(x.SerializeToString(), 9, [1]), 1, 0, i, []) for i, x in enumerate((full, strange))], RAW)
    df = codec.decode(raw)
    a, b = sorted(df.collect(), key=lambda r: r["__offset"])
    assert (a["weight"], int(a["serial"]), a["offset"], a["sealed"], bytes(a["stamp"]), a["state"], a["signs"], a["counts"]) == (1.5, 2**64 - 2, -(2**63), True, b"\x00\x09", "GIVEN", ["", "x"], {"a": -1, "b": 2})
    assert a["first"]["grams"] == 2**32 - 1 and [json.loads(p) for p in a["first"]["parts"]] == [{"grams": 4}] and a["left"].microsecond == 999_999 and (a["floor"], a["by_air"], a["by_road"]) == (0, False, None) and json.loads(a["notes"]) == [True]
    assert (b["weight"], b["state"], b["first"], b["floor"], b["signs"], b["counts"]) == (0.0, "41", None, None, [], {})
    back = [make.FromString(framing.unframe_protobuf(bytes(r["value"]))[2]) for r in sorted(codec.encode(df).collect(), key=lambda r: r["offset"])]
    full.left.nanos = 999_999_000  # what is below a microsecond goes
    assert back == [full, strange]
    with pytest.raises(Exception, match="is not depot.Parcel"):
        codec.decode(spark.createDataFrame([(None, framing.frame_protobuf(b"", 9, [0]), 1, 0, 0, [])], RAW)).collect()


def test_printed_schema(parcel):
    from google.protobuf import descriptor_pb2 as d
    from google.protobuf import descriptor_pool

    from strandlake.sources import protobuf as P

    text = P.print_schema(parcel.file)
    lines = [x.strip() for x in text.splitlines()]
    assert lines[:2] == ['syntax = "proto3";', "package depot;"] and 'import "google/protobuf/wrappers.proto";' in lines
    for line in ("map<string, sint32> counts = 12;", "oneof way {", "bool by_air = 21;", "reserved 5 to 6;", 'reserved "colour";', "repeated string signs = 11;", "service Tracking {", "rpc Follow (.depot.Depot) returns (stream .depot.Parcel);"):
        assert line in lines, line
    old = d.FileDescriptorProto(name="old.proto", syntax="proto2", package="old")
    m = old.message_type.add(name="M")
    m.field.add(name="quoted", number=1, type=9, label=1, default_value='a"b\\c\n')
    m.field.add(name="data", number=2, type=12, label=1, default_value="\\001\\377")
    m.field.add(name="many", number=3, type=5, label=3).options.packed = True
    m.field.add(name="Inner", number=4, type=10, label=1, type_name=".old.M.Inner")
    m.nested_type.add(name="Inner").field.add(name="x", number=1, type=5, label=2)
    m.extension_range.add(start=100, end=536870912)
    m.options.deprecated = True
    old.extension.add(name="more", number=120, type=5, label=1, extendee=".old.M")
    e = old.enum_type.add(name="E")
    e.value.add(name="A", number=0)
    e.value.add(name="B", number=0).options.deprecated = True
    e.options.allow_alias = True
    e.reserved_range.add(start=5, end=7)
    old.options.java_package = "x.y"
    pool = descriptor_pool.DescriptorPool()
    pool.Add(old)
    lines = [x.strip() for x in P.print_schema(pool.FindFileByName("old.proto")).splitlines()]
    for line in (r'optional string quoted = 1 [default = "a\"b\\c\n"];', r'optional bytes data = 2 [default = "\001\377"];', "repeated int32 many = 3 [packed = true];", "optional group Inner = 4 {", "required int32 x = 1;", "extensions 100 to max;", "option deprecated = true;", "extend .old.M {", "optional int32 more = 120;", "option allow_alias = true;", "B = 0 [deprecated = true];", "reserved 5 to 7;", 'option java_package = "x.y";'):
        assert line in lines, line
    assert lines.count("message Inner {") == 0


@pytest.fixture
def stub():
    s = RegistryStub()
    yield s
    s.close()


def test_registry_client(stub):
    c = RegistryClient(stub.url, token="t", pause=0.01)
    reading, shared = Schema(json.dumps(READING)), Schema('{"title":"unit"}', "JSON")
    assert c.register("weather", reading) == 1 and c.register("unit/json", shared) == 2 and c.register("weather", reading) == 1
    assert "POST /subjects/unit%2Fjson/versions" in stub.requests
    user = Schema('{"$ref":"unit"}', "JSON", (("unit", "unit/json", 1),))
    number = c.register("sensor", user)
    assert c.resolved(number).resolved == (shared,) and c.schema(number) == user and c.lookup("sensor", user) == c.latest_id("sensor") == number
    assert sorted(c.subjects()) == ["sensor", "unit/json", "weather"] and c.versions("sensor") == [1] and c.version("sensor", 1)["id"] == number
    assert c.set_compatibility("NONE", "sensor") == "NONE" == c.compatibility("sensor") and c.compatibility() != "NONE"
    stub.fail = [429, 502]
    assert c.schema(2) == shared  # the third try
    stub.fail = [503] * 3
    for call, status in ((lambda: c.schema(2), 503), (lambda: c.schema(12345), 404), (lambda: c.latest("nobody"), 404), (lambda: RegistryClient("http://127.0.0.1:9", pause=0.01).versions("x"), 0)):
        with pytest.raises(RegistryError) as e:
            call()
        assert e.value.status == status
    assert c.delete_version("weather", 1) == 1 and c.delete_subject("sensor") == [1]


def test_ids_are_known_before_they_are_asked_for(stub):
    client = RegistryClient(stub.url, pause=0.01)
    auto = SchemaCache(client)
    auto.intern("t-key", Schema('"string"'))
    auto.intern("t-key", Schema('"long"'))  # the first one counts
    with pytest.raises(LakeError, match="prewarm"):
        auto.id_for("t-key")
    auto.prewarm()
    assert auto.text(auto.id_for("t-key")) == '"string"'
    known = len(stub.requests)
    auto.prewarm()
    auto.id_for("t-key")
    assert len(stub.requests) == known  # nothing is asked twice


def test_register_modes(stub):
    client = RegistryClient(stub.url, pause=0.01)
    client.register("a", Schema('"int"'))
    client.register("a", Schema('"double"'))
    latest, strict = SchemaCache(client, RegisterMode.USE_LATEST), SchemaCache(client, RegisterMode.LOOKUP_ONLY)
    latest.intern("a", Schema('"boolean"'))
    latest.prewarm()
    assert latest.text(latest.id_for("a")) == '"double"'
    strict.intern("a", Schema('"int"'))
    strict.intern("b", Schema('"int"'))
    report = strict.prewarm_report()
    assert report["a"] == 1 and isinstance(report["b"], RegistryError) and client.subjects() == ["a"]
    with pytest.raises(RegistryError):
        strict.prewarm()


def test_writer_schemas_are_fetched_in_the_background(stub):
    client = RegistryClient(stub.url, pause=0.01)
    number = client.register("late", Schema('"bytes"'))
    cache = SchemaCache(client)
    with pytest.raises(SchemaPending) as e:
        cache.writer_schema(number)
    assert e.value.schema_id == number
    cache._pool.shutdown(wait=True)
    assert cache.writer_schema(number).text == '"bytes"'
    assert topic_name("t", Role.KEY) == "t-key" and topic_name("t", Role.VALUE) == "t-value"


def test_registry_framed_codecs(spark, stub, parcel):
    cache = SchemaCache(RegistryClient(stub.url))
    writer, proto = avro_codec(cache, "weather", json.dumps(READING_WITH_REMARK)), protobuf_codec(cache, "parcels", parcel)
    cache.prewarm()
    struct = T.StructType([T.StructField("station", T.StringType()), T.StructField("celsius", T.DoubleType()), T.StructField("remark", T.StringType())])
    rows = JsonCodec(struct).decode(spark.createDataFrame([(None, b'{"station":"s","celsius":2.5,"remark":"calm"}', 1, 0, 0, [])], RAW))
    got = avro_codec(SchemaCache(RegistryClient(stub.url)), "weather", json.dumps(READING)).decode(writer.encode(rows))
    assert [(r["station"], r["celsius"]) for r in got.collect()] == [("s", 2.5)] and "remark" not in got.columns
    assert proto.write_id() == cache.id_for("parcels-value") and cache.schemas[proto.write_id()].kind == "PROTOBUF"


def test_json_serde(spark, stub):
    schema = {"type": "object", "required": ["seat"], "properties": {"seat": {"type": "integer", "minimum": 1}}}
    serde = JsonSerde(SchemaCache(RegistryClient(stub.url)), schema)
    serde.register("cinema")
    serde.cache.prewarm()
    df = spark.createDataFrame([('{"seat":3}',), (None,)], "j string").select(serde.encode("cinema", F.col("j")).alias("f"))
    assert {r[0] for r in df.select(serde.decode(F.col("f"))).collect()} == {None, '{"seat":3}'}
    for bad, word in (("{}", "seat is missing"), ('{"seat":0}', "seat")):
        wrong = spark.createDataFrame([(bad,)], "j string")
        for checked in (serde.encode("cinema", F.col("j")), serde.decode(framing.frame(F.col("j").cast("binary"), 1))):
            with pytest.raises(Exception, match=word):
                wrong.select(checked).collect()
    lax = JsonSerde(serde.cache, schema, validate=False)
    assert bytes(spark.createDataFrame([("{}",)], "j string").select(lax.encode("cinema", F.col("j"))).head()[0]).endswith(b"{}")
    with pytest.raises(LakeError):
        serde.encode("cinema", F.col("j"), Role.KEY)


@pytest.mark.parametrize("schema,good,bad", [
    ({"type": "number", "exclusiveMinimum": 0}, 0.5, 0), ({"type": ["array", "null"], "maxItems": 1}, None, [1, 2]), ({"enum": [None, "x"]}, None, "y"), ({"const": [1]}, [1], [2]),
    ({"type": "array", "items": {"type": "string"}, "uniqueItems": True}, ["a", "b"], ["a", "a"]), ({"prefixItems": [{"type": "null"}], "items": False}, [None], [None, 0]),
    ({"properties": {"p": {"type": "boolean"}}, "additionalProperties": False}, {"p": True}, {"q": True}), ({"patternProperties": {"_id$": {"type": "string"}}}, {"my_id": "x"}, {"my_id": 4}),
    ({"anyOf": [{"type": "null"}, {"maximum": 2}]}, 1, 3), ({"oneOf": [{"type": "integer"}, {"maximum": 4}]}, 9, 3), ({"not": {"required": ["z"]}}, {}, {"z": 1}), ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, {"b": 1}, {"a": 1}),
    ({"$ref": "#/$defs/word", "$defs": {"word": {"pattern": "^[a-z]+$"}}}, "abc", "a1"), ({"multipleOf": 0.25}, 1.75, 1.8), ({"contains": {"type": "string"}}, [1, "x"], [1]), ({"dependentRequired": {"card": ["name"]}}, {"name": 1}, {"card": 1}),
    ({"$schema": "http://json-schema.org/draft-04/schema#", "maximum": 7, "exclusiveMaximum": True}, 6, 7), ({"minLength": 2}, "☃☃", "☃"), ({"propertyNames": {"pattern": "^k"}}, {"k1": 0}, {"v": 0}), ({"allOf": [{"minimum": 2}, {"maximum": 3}]}, 2.5, 4),
])
def test_json_schema_keywords(schema, good, bad):
    assert errors(good, schema) == [] and errors(bad, schema)


def test_dialects():
    assert dialect({}) == "2020-12" and dialect({"$schema": "http://json-schema.org/draft-06/schema#"}) == "6"
    with pytest.raises(LakeError):
        dialect({"$schema": "https://example.org/own"})


def both(check, old, new):
    """Whether the new version reads the old (BACKWARD) and the old reads the new (FORWARD); FULL is both."""
    backward, forward, full = (check(old, new, m) for m in (Mode.BACKWARD, Mode.FORWARD, Mode.FULL))
    assert sorted(full) == sorted([*backward, *forward])
    return not backward, not forward


@pytest.mark.parametrize("old,new,want", [
    (READING, READING_WITH_REMARK, (False, True)), (READING, record("lab.Reading", station="string", celsius="double", remark=(["null", "string"], None)), (True, True)), (READING, record("lab.Reading", station="string", celsius="boolean"), (False, False)),
    (record("R", x="int"), record("R", x="double"), (True, False)), (record("R", x="string"), record("R", x="bytes"), (True, True)), (record("R", x="long"), record("R", x=["null", "long"]), (True, False)),
    (record("R", x={"type": "enum", "name": "E", "symbols": ["A"]}), record("R", x={"type": "enum", "name": "E", "symbols": ["A", "B"]}), (True, False)), (record("R", x={"type": "array", "items": "int"}), record("R", x={"type": "array", "items": "string"}), (False, False)),
    (TREE, TREE, (True, True)), (record("R", x={"type": "map", "values": "int"}), record("R", x={"type": "map", "values": "float"}), (True, False)),
])
def test_avro_compatibility(old, new, want):
    assert both(compatibility.avro, json.dumps(old), json.dumps(new)) == want


def obj(required=(), more=True, **properties):
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": more}


NUMBER, WHOLE, TEXT, LINK = {"type": "number"}, {"type": "integer"}, {"type": "string"}, {"$ref": "#/$defs/n"}


@pytest.mark.parametrize("old,new,want", [
    (obj(a=WHOLE), obj(a=NUMBER), (True, False)), (obj(a=WHOLE), obj(a=TEXT), (False, False)), (obj(a=WHOLE), obj(a=WHOLE, b=TEXT), (True, True)), (obj(a=WHOLE), obj(["a"], a=WHOLE), (False, True)),
    (obj(a=WHOLE, b=TEXT), obj(more=False, a=WHOLE), (False, True)), (obj(a=obj(b=WHOLE)), obj(a=obj(["b"], b=WHOLE)), (False, True)), ({"type": "string", "maxLength": 4}, {"type": "string", "maxLength": 9}, (True, False)),
    ({"enum": ["x"]}, {"enum": ["x", "y"]}, (True, False)), ({"enum": ["x"]}, TEXT, (True, False)), ({"type": "array", "items": WHOLE}, {"type": "array", "items": NUMBER}, (True, False)), (WHOLE, {"anyOf": [TEXT, NUMBER]}, (True, False)),
    (TEXT, {"type": "string", "pattern": "^a"}, (False, True)), (WHOLE, {"type": ["integer", "null"]}, (True, False)), ({"allOf": [NUMBER, {"minimum": 3}]}, {"type": "number", "minimum": 1}, (True, False)), (True, WHOLE, (False, True)),
    ({**LINK, "$defs": {"n": obj(next=LINK)}}, {**LINK, "$defs": {"n": obj(next=LINK, at=WHOLE)}}, (True, True)),
])
def test_json_schema_compatibility(old, new, want):
    assert both(compatibility.json_schema, json.dumps(old), json.dumps(new)) == want
    with pytest.raises(ValueError):
        compatibility.json_schema(json.dumps(old), "not json", Mode.FULL)


def proto_file(**messages):
    """A file of messages; a field is (number, type, label) or (number, message name)."""
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2 as d
    from google.protobuf import descriptor_pool

    f = d.FileDescriptorProto(name="c.proto", package="c", syntax="proto2")
    for name, fields in messages.items():
        m = f.message_type.add(name=name)
        for field, (number, kind, *label) in fields.items():
            m.field.add(name=field, number=number, label=(label or [1])[0], **({"type": 11, "type_name": f".c.{kind}"} if isinstance(kind, str) else {"type": kind}))
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return pool.FindFileByName("c.proto")


@pytest.mark.parametrize("old,new,want", [
    ({"A": {"x": (1, 5)}}, {"A": {"renamed": (1, 3)}}, (True, True)), ({"A": {"x": (1, 5)}}, {"A": {"x": (1, 17)}}, (False, False)), ({"A": {"x": (1, 9)}}, {"A": {"x": (1, 12)}}, (True, True)), ({"A": {"x": (1, 7)}}, {"A": {"x": (1, 15)}}, (True, True)),
    ({"A": {"x": (1, 5)}}, {"A": {"x": (1, 5), "y": (2, 9)}}, (True, True)), ({"A": {"x": (1, 5)}}, {"A": {"x": (1, 5), "y": (2, 9, 2)}}, (False, True)), ({"A": {"x": (1, 5)}}, {"A": {"x": (1, 5, 3)}}, (False, False)), ({"A": {}, "B": {}}, {"A": {}}, (False, True)),
    ({"A": {"x": (1, "B")}, "B": {"y": (1, 5)}}, {"A": {"x": (1, "B")}, "B": {"y": (1, 1)}}, (False, False)), ({"A": {"x": (1, "A")}}, {"A": {"x": (1, "A"), "z": (3, 8)}}, (True, True)),
])
def test_protobuf_compatibility(old, new, want):
    assert both(compatibility.protobuf, proto_file(**old), proto_file(**new)) == want


@pytest.mark.parametrize(
    "reader,writer,fits",
    [
        ({"type": "object", "required": ["a"], "anyOf": [{}]}, {"type": "object"}, False),
        ({"type": "object", "required": ["a"], "oneOf": [{}]}, {"type": "object", "required": ["a"]}, True),
        ({"allOf": [{"minimum": 5}], "minimum": 1}, {"minimum": 1}, False),
        ({"allOf": [{"minimum": 5}], "minimum": 1}, {"minimum": 5}, True),
        ({"minimum": 5}, {"allOf": [{"minimum": 0}, {"minimum": 5}]}, True),
        ({"minimum": 6}, {"allOf": [{"minimum": 0}, {"minimum": 5}]}, False),
        ({"patternProperties": {"^x": {"type": "string"}}}, {"type": "object"}, False),
        ({"contains": {"type": "string"}}, {"type": "array"}, False),
        ({"dependentRequired": {"a": ["b"]}}, {"type": "object"}, False),
        ({"dependentRequired": {"a": ["b"]}}, {"type": "object", "dependentRequired": {"a": ["b"]}}, True),
        ({"type": "integer", "minimum": 2}, {"type": "integer", "anyOf": [{"minimum": 3}, {"enum": [2, 4], "minimum": 2}]}, True),
        ({"type": "integer", "minimum": 3}, {"minimum": 3, "anyOf": [{"type": "integer"}, {"type": "string"}]}, False),
        ({"enum": [1, 2]}, {"allOf": [{"enum": [1, 2, 3]}, {"enum": [2, 5]}]}, True),
        ({"properties": {"a": {"minimum": 3}}}, {"allOf": [{"properties": {"a": {"minimum": 4}}}, {"properties": {"a": {"minimum": 0}}}]}, True),
        ({"properties": {"n": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}}, "type": "object"}, {"type": "object", "title": "t", "properties": {"n": {"title": "t", "anyOf": [{"type": "null"}, {"$ref": "#"}]}}}, True),
    ],
)
def test_json_schema_alternatives_and_parts(reader, writer, fits):
    assert (compatibility.json_schema(json.dumps(writer), json.dumps(reader), Mode.BACKWARD) == []) is fits
