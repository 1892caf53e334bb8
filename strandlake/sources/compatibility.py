"""Local compatibility checks of two schema versions: Avro, JSON Schema, Protobuf.

BACKWARD: the candidate reads what the previous one wrote. FORWARD: the other way round. FULL: both. The result
is a list of what is incompatible, empty if nothing is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from enum import Enum
from typing import Any

from . import avro as A


class Mode(Enum):
    BACKWARD = "backward"
    FORWARD = "forward"
    FULL = "full"


def _pairs(previous: Any, candidate: Any, mode: Mode) -> list[tuple[str, Any, Any]]:
    """(direction, reader, writer)."""
    both = {"BACKWARD": ("BACKWARD", candidate, previous), "FORWARD": ("FORWARD", previous, candidate)}
    return [both[m] for m in (("BACKWARD", "FORWARD") if mode is Mode.FULL else (mode.name,))]


def avro(previous: str, candidate: str, mode: Mode) -> list[str]:
    out = []
    for direction, r, w in _pairs(A.parse(previous), A.parse(candidate), mode):
        out += [f"{direction}: {e}" for e in _avro(r, w, A.named(r), A.named(w), "", set())]
    return out


def _avro(r: Any, w: Any, rn: dict, wn: dict, path: str, seen: set) -> list[str]:
    r = rn.get(r, r) if isinstance(r, str) else r
    w = wn.get(w, w) if isinstance(w, str) else w
    rk, wk = A._kind(r), A._kind(w)
    if wk == "union":
        return [e for x in w for e in _avro(r, x, rn, wn, path, seen)]
    if rk == "union":
        return [] if any(not _avro(x, w, rn, wn, path, set(seen)) for x in r) else [f"{path or '/'}: no branch reads {A._branch(w)}"]
    if rk in ("record", "enum", "fixed") and rk == wk:
        key = (r["name"], w["name"])
        if key in seen:
            return []
        seen.add(key)
    if not A.fits(w, r, False):
        return [f"{path or '/'}: {A._branch(w)} can't be read as {A._branch(r)}"]
    if rk == "record":
        written, out = {f["name"]: f for f in w["fields"]}, []
        for f in r["fields"]:
            source = next((written[n] for n in (f["name"], *f.get("aliases", [])) if n in written), None)
            if source is not None:
                out += _avro(f["type"], source["type"], rn, wn, f"{path}/{f['name']}", seen)
            elif "default" not in f:
                out.append(f"{path}/{f['name']}: was not written and has no default")
        return out
    if rk == "enum" and "default" not in r:
        missing = [s for s in w["symbols"] if s not in r["symbols"]]
        return [f"{path or '/'}: symbols {missing} are missing"] if missing else []
    if rk == "array":
        return _avro(r["items"], w["items"], rn, wn, path + "/items", seen)
    if rk == "map":
        return _avro(r["values"], w["values"], rn, wn, path + "/values", seen)
    return []


_KINDS = ("null", "boolean", "integer", "number", "string", "array", "object")
_LEAST, _MOST = (("minimum", 1), ("exclusiveMinimum", 1), ("minLength", 1), ("minItems", 1), ("minProperties", 1)), (("maximum", -1), ("exclusiveMaximum", -1), ("maxLength", -1), ("maxItems", -1), ("maxProperties", -1))


def json_schema(previous: str, candidate: str, mode: Mode) -> list[str]:
    """Whether the reader's schema admits every document that the writer's schema describes.

    Writers are taken to write declared properties only, so a new optional property does no harm. An integer is a
    number. A reader must take each part of its ``allOf``, a writer keeps to all parts of its own; ``anyOf`` and ``oneOf`` are alternatives
    beside the other keywords; local references are followed; of
    other keywords that restrict, a reader may not have one that the writer hasn't just so.
    """
    try:
        documents = [json.loads(x) for x in (previous, candidate)]
    except json.JSONDecodeError as e:
        raise ValueError("a schema is no JSON") from e
    out = []
    for direction, reader, writer in _pairs(*documents, mode):
        out += [f"{direction}: {e}" for e in _Containment(reader, writer).of(reader, writer, "$")]
    return out


#: Words that restrict documents in ways that aren't compared: a reader's must be the writer's too.
_AS_WRITTEN = (
    "pattern", "format", "multipleOf", "uniqueItems", "not", "patternProperties", "propertyNames", "dependencies", "dependentRequired", "dependentSchemas",
    "contains", "minContains", "maxContains", "prefixItems", "additionalItems", "unevaluatedItems", "unevaluatedProperties", "if", "then", "else",
)


class _Containment:
    """Search for documents that a writer's schema describes and a reader's doesn't."""

    def __init__(self, reader_root: Any, writer_root: Any):
        self.roots = {True: reader_root, False: writer_root}
        self.open: set[tuple[int, int]] = set()
        self.joined: dict[tuple[int, int], tuple] = {}

    def plain(self, schema: Any, reads: bool) -> dict:
        """A schema as an object, its reference followed; of a writer's ``allOf`` the parts are joined to one."""
        hops = 0
        while isinstance(schema, dict) and "$ref" in schema:
            target: Any = self.roots[reads]
            for step in schema["$ref"].removeprefix("#").strip("/").split("/"):
                target = target[step.replace("~1", "/").replace("~0", "~")] if step else target
            schema, hops = target, hops + 1
            if hops > 50:
                raise ValueError("a reference leads back to itself")
        if isinstance(schema, bool):
            return {} if schema else {"enum": []}
        if not reads and "allOf" in schema:
            whole = {k: v for k, v in schema.items() if k != "allOf"}
            for part in schema["allOf"]:
                whole = self.both(whole, self.plain(part, False))
            return whole
        return schema

    def both(self, a: dict, b: dict) -> dict:
        """What a writer gives that keeps to both. Of two patterns and the like the first is kept: that gives more, so nothing is wrongly let through."""
        if not a or not b:
            return a or b
        if (id(a), id(b)) not in self.joined:
            out = {**b, **a}
            for word, sign in (*_LEAST, *_MOST):
                if word in a and word in b:
                    out[word] = sign * max(sign * a[word], sign * b[word])
            if "type" in a and "type" in b:
                out["type"] = sorted(self.kinds({"type": a["type"]}) & self.kinds({"type": b["type"]}))
            lists = [x["enum"] if "enum" in x else [x["const"]] for x in (a, b) if "enum" in x or "const" in x]
            if lists:
                out.pop("const", None)
                out["enum"] = [v for v in lists[0] if all(v in x for x in lists)]
            mine, other = a.get("properties", {}), b.get("properties", {})
            if mine or other:
                out["properties"] = {n: {"allOf": [mine[n], other[n]]} if n in mine and n in other else mine.get(n, other.get(n)) for n in {**mine, **other}}
            if "required" in a or "required" in b:
                out["required"] = [*a.get("required", []), *b.get("required", [])]
            if "items" in a and "items" in b:
                out["items"] = {"allOf": [a["items"], b["items"]]}
            self.joined[id(a), id(b)] = (a, b, out)
        return self.joined[id(a), id(b)][2]

    @staticmethod
    def kinds(schema: dict) -> set[str]:
        """JSON types that a schema admits."""
        if "enum" in schema or "const" in schema:
            values = schema["enum"] if "enum" in schema else [schema["const"]]
            names = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}
            return {names[type(v)] for v in values}
        named = schema.get("type", list(_KINDS))
        named = {named} if isinstance(named, str) else set(named)
        return named | {"integer"} if "number" in named else named

    def of(self, reader: Any, writer: Any, at: str) -> list[str]:
        key = (id(reader), id(writer))
        if key in self.open:  # a recursive schema: what holds above holds here
            return []
        self.open.add(key)
        try:
            return self._compared(self.plain(reader, True), self.plain(writer, False), at)
        finally:
            self.open.discard(key)

    def _within(self, reader: Any, w: dict, at: str) -> list[str]:
        """One part of a reader's schema against a writer's that is plain already."""
        key = (id(reader), id(w))
        if key in self.open:
            return []
        self.open.add(key)
        try:
            return self._compared(self.plain(reader, True), w, at)
        finally:
            self.open.discard(key)

    def _compared(self, r: dict, w: dict, at: str) -> list[str]:
        for word in ("anyOf", "oneOf"):
            if word in w:
                # Each alternative gives documents together with what stands beside it.
                beside = {k: v for k, v in w.items() if k != word}
                return [e for x in w[word] for e in (self._compared(r, self.both(beside, self.plain(x, False)), at) if beside else self.of(r, x, at))]
        for word in ("allOf", "anyOf", "oneOf"):
            if word in r:
                beside = {k: v for k, v in r.items() if k != word}
                out = self._compared(beside, w, at)
                if word == "allOf":
                    return out + [e for x in r[word] for e in self._within(x, w, at)]
                return out if any(not self._within(x, w, at) for x in r[word]) else [*out, f"{at} fits no alternative of the reader"]
        out = []
        strange = self.kinds(w) - self.kinds(r)
        if strange:
            out.append(f"{at} may be {' or '.join(sorted(strange))}, which the reader does not take")
        if "enum" in r or "const" in r:
            taken = r["enum"] if "enum" in r else [r["const"]]
            given = w.get("enum", [w["const"]] if "const" in w else None)
            if given is None or any(v not in taken for v in given):
                out.append(f"{at} may have values that the reader does not list")
        for word, sign in (*_LEAST, *_MOST):
            if word in r and not (word in w and sign * w[word] >= sign * r[word]):
                out.append(f"{at} may lie beyond the reader's {word}")
        for word in _AS_WRITTEN:
            if r.get(word) and r[word] != w.get(word):
                out.append(f"{at} need not meet the reader's {word}")
        if "object" in self.kinds(w) & self.kinds(r):
            out += self._objects(r, w, at)
        if "array" in self.kinds(w) & self.kinds(r) and "items" in r:
            out += self.of(r["items"], w.get("items", True), at + "[]")
        return out

    def _objects(self, r: dict, w: dict, at: str) -> list[str]:
        always = set(w.get("required", []))
        out = [f"{at}.{name} may be left out, but the reader needs it" for name in r.get("required", []) if name not in always]
        declared, others = r.get("properties", {}), r.get("additionalProperties", True)
        for name, schema in w.get("properties", {}).items():
            if name in declared:
                out += self.of(declared[name], schema, f"{at}.{name}")
            elif others is not True:
                out += self.of(others, schema, f"{at}.{name}")
        return out


#: Types that a parser takes for one another, by how they are written (Protobuf's rules for updating a message type).
_WIRE = (
    ("INT32", "INT64", "UINT32", "UINT64", "BOOL", "ENUM"), ("SINT32", "SINT64"), ("FIXED32", "SFIXED32"), ("FIXED64", "SFIXED64"),
    ("FLOAT",), ("DOUBLE",), ("STRING", "BYTES"), ("MESSAGE",), ("GROUP",),
)


def protobuf(previous: Any, candidate: Any, mode: Mode) -> list[str]:
    """File descriptors. The writer's top messages must be in the reader's file, and all fields that both have be readable.

    Fields are the same by their number. Messages inside fields are compared by what they hold, not by name.
    """
    return [f"{direction}: {e}" for direction, reader, writer in _pairs(previous, candidate, mode) for e in _files(reader, writer)]


def _files(reader: Any, writer: Any) -> Iterator[str]:
    done: set[tuple[str, str]] = set()
    for name, message in writer.message_types_by_name.items():
        if name in reader.message_types_by_name:
            yield from _messages(reader.message_types_by_name[name], message, name, done)
        else:
            yield f"{name} is not known to the reader"


def _messages(reader: Any, writer: Any, at: str, done: set[tuple[str, str]]) -> Iterator[str]:
    from google.protobuf.descriptor import FieldDescriptor

    from .protobuf import _repeated

    if (reader.full_name, writer.full_name) in done:
        return
    done.add((reader.full_name, writer.full_name))
    family = {getattr(FieldDescriptor, f"TYPE_{t}"): names[0] for names in _WIRE for t in names}
    for number, field in reader.fields_by_number.items():
        place = f"{at}.{field.name}"
        written = writer.fields_by_number.get(number)
        if written is None:
            if field.is_required if hasattr(field, "is_required") else field.label == FieldDescriptor.LABEL_REQUIRED:
                yield f"{place} must be there, and no writer sets number {number}"
        elif family[field.type] != family[written.type]:
            yield f"{place} (number {number}) is written as {family[written.type].lower()} and read as {family[field.type].lower()}"
        elif _repeated(field) != _repeated(written):
            yield f"{place} (number {number}) is {'one value' if _repeated(field) else 'many values'} at the writer"
        elif field.message_type is not None:
            yield from _messages(field.message_type, written.message_type, place, done)
    for nested in writer.nested_types:
        if nested.name in reader.nested_types_by_name:
            yield from _messages(reader.nested_types_by_name[nested.name], nested, f"{at}.{nested.name}", done)
        elif not nested.GetOptions().map_entry:
            yield f"{at}.{nested.name} is not known to the reader"
