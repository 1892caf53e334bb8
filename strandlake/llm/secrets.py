"""Secret scans: fixed patterns, and literals that reach a sensitively named target.

A text is lexed once into names, string literals, bare values and the marks between them, whatever it is: source
code, JSON, YAML, INI, shell, command lines or prose. From these come pairs of a target name and the
literals given to it (``name = "x"``, ``"name": "x"``, ``name: x``, ``cfg["name"] = "x"``, ``f(name="x")``, ``--name=x``), parts joined by +
included. A literal given to one name and that name given to another reaches both: constants are propagated,
also through ``$name`` and ``${name}``, in whatever order the file has them. A literal is reported if the
sensitivity of a target name that it reaches, weighed by how random the literal looks, is high enough.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, slices

# The patterns of the three base kinds, and the least length of what counts.
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: The kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "literal")

#: How sensitive a name is that has one of these parts, or two neighbouring ones.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "token": 0.8, "apikey": 0.9, "api key": 0.9, "access key": 0.9, "private key": 0.9, "secret key": 1.0, "signing key": 0.9, "encryption key": 0.9, "auth key": 0.8, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "bearer": 0.7, "key": 0.35, "salt": 0.5, "pin": 0.4}
#: Parts that say a name holds something about a secret, not the secret.
ABOUT = frozenset("count length len size limit max min name id url uri path file field label type format expiry expires ttl hint prompt policy regex pattern header public".split())
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?ai)^(?:changeme|change_me|example|sample|test|dummy|password|secret|token|none|null|nil|true|false|todo|redacted|placeholder|your[-_ ].*|my[-_ ].*|x+|\*+|\.+|-+|0+)$|^<.*>$|^\{\{.*\}\}$")

_LEX = re.compile(
    r"""(?P<comment>^[ \t]*(?:\#|//)[ \t]?)
      | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
      | (?P<ref>\$\{\w+\}|\$\w+)
      | (?P<op>===?|!=|<=|>=|:=|=>|->|[=:+\[\]\n,;(){}])
      | (?P<word>[^\s"'`$=:+\[\],;(){}<>!]+)""",
    re.VERBOSE | re.MULTILINE,
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"^-{0,2}[A-Za-z_][\w.-]*$")
_GIVES = frozenset(("=", ":", ":=", "=>"))


def sensitivity(name: str) -> float:
    """0 to 1: how likely what is given to ``name`` is a secret, by the parts of the name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max([SENSITIVE.get(p, 0.0) for p in parts] + [SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(parts, parts[1:])], default=0.0)
    return best * (0.3 if ABOUT.intersection(parts) else 1.0)


def randomness(value: str) -> float:
    """0 to 1: how random a literal looks, by its length, classes of characters and entropy."""
    n = len(value)
    if n < LEAST_VALUE or PLACEHOLDER.match(value):
        return 0.0
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^\sA-Za-z0-9]"))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    out = 0.4 + 0.15 * (classes - 1) + 0.1 * min(entropy, 4.0)
    return max(0.0, min(1.0, out - (0.4 if re.search(r"\s", value) else 0.0)))


def pairs(text: str) -> list[tuple[str, list[tuple]]]:
    """(target name, parts of its value) in order; a part is ("literal", start, end) or ("name", name)."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _LEX.finditer(text)]
    out, n = [], len(tokens)

    def named(at: int) -> str | None:
        """The target that the token at ``at`` ends: a name, a quoted name, or a name's subscript."""
        kind, a, b = tokens[at]
        if kind == "op" and text[a:b] == "]" and at >= 2:
            at -= 1
            kind, a, b = tokens[at]
        name = text[a + 1 : b - 1] if kind == "string" else text[a:b]
        return name.lstrip("-") if kind in ("string", "word") and _NAME.match(name) else None

    for i, (kind, a, b) in enumerate(tokens):
        if kind != "op" or not i or text[a:b] not in _GIVES:
            continue
        target = named(i - 1)
        if target is None:
            continue
        parts, at = [], i + 1
        while at < n:
            kind, a, b = tokens[at]
            if kind == "string":
                inner = text[a + 1 : b - 1]
                ref = re.fullmatch(r"\$\{?(\w+)\}?", inner)
                parts.append(("name", ref[1]) if ref else ("literal", a + 1, b - 1))
            elif kind == "ref":
                parts.append(("name", text[a:b].strip("${}")))
            elif kind == "word" and at + 1 < n and tokens[at + 1][0] == "op" and text[slice(*tokens[at + 1][1:])] in ("(", *_GIVES):
                break  # a call, or the next pair's target
            elif kind == "word":
                # A bare value is a literal, and perhaps a name that has one.
                parts.append(("bare", a, b))
            else:
                break
            if at + 1 < n and text[slice(*tokens[at + 1][1:])] == "+":
                at += 2
            else:
                break
        if parts:
            out.append((target, parts))
    return out


def reaching(found: list[tuple[str, list[tuple]]], text: str) -> dict[tuple[int, int], set[str]]:
    """The names that each literal (start, end) reaches, through other names too."""
    known = {target for target, _ in found}
    into: dict[str, set[str]] = {}
    direct: list[tuple[tuple[int, int], str]] = []
    for target, parts in found:
        for kind, *rest in parts:
            name = rest[0] if kind == "name" else text[slice(*rest)] if kind == "bare" else None
            if name is not None and name in known:
                if name != target:
                    into.setdefault(name, set()).add(target)
            elif kind != "name":
                direct.append((tuple(rest), target))
    out: dict[tuple[int, int], set[str]] = {}
    for place, target in direct:
        names = out.setdefault(place, set())
        stack = [target]
        while stack:
            name = stack.pop()
            if name not in names:
                names.add(name)
                stack += into.get(name, ())
    return out


def literals(text: str, least: float = 0.5) -> list[tuple[int, int]]:
    """Places of literals whose best target name's sensitivity times their randomness reaches ``least``."""
    found = pairs(text)
    if not any(sensitivity(t) for t in {t for t, _ in found}):
        return []
    scores: dict[str, float] = {}
    out = []
    for (a, b), names in reaching(found, text).items():
        worst = max(scores[n] if n in scores else scores.setdefault(n, sensitivity(n)) for n in names)
        if worst and worst * randomness(text[a:b]) >= least:
            out.append((a, b))
    return out


def scan(text: str, least: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets of a text, in order; places are code points."""
    gives = "=" in text or ":" in text  # else nothing is assigned
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if gives else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(a, 3, b) for a, b in literals(text, least)] if gives else []
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


OUT = "n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """For every row: its id, how many secrets of each kind its text has, a digest of those by fixed patterns, and all spans.

    A span is kind:start:end in code points, the end excluded; spans are listed by start, then kind as in ``KINDS``. A
    literal may also lie in a span of another kind; both are listed. Null and empty texts have no secrets; repeated
    rows come out repeatedly; null ids stay; an empty table gives no rows; further columns are not looked at. One pass, no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(OUT).fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = [[] for _ in range(6)]
                for text in part.column("text").to_pylist():
                    spans = scan(text, least) if text else []
                    counts = Counter(k for _, k, _ in spans)
                    base = listed([s for s in spans if s[1] < 3])
                    for column, value in zip(made, (*[counts[k] for k in range(4)], hashlib.sha256(base.encode()).hexdigest(), listed(spans))):
                        column.append(value)
                arrays = [pa.array(c, f) for c, f in zip(made, [pa.int64()] * 4 + [pa.string()] * 2)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], schema.names)

    return map_texts(rows, task, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", least: float = 0.5) -> DataFrame:
    """``docs``, all columns and rows kept, with each secret's value replaced by ``mark``: of an assignment only what is assigned. Null texts stay null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                texts = [None if t is None else _redacted(t, mark, least) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return map_texts(docs, task, docs.schema)


def _redacted(text: str, mark: str, least: float) -> str:
    places = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    places += [(a, b) for a, k, b in scan(text, least) if k]
    out, upto = [], 0
    for a, b in sorted(places):
        if a >= upto:
            out += [text[upto:a], mark]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])
