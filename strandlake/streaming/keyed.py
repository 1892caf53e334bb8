"""Operators on streaming frames whose state lies in Spark's own state store, typed and readable by key.

Groupings and interval joins keep map state for each logical partition, with the partition's own stream time, and
show batch by batch what :mod:`strandlake.operators.stateful` shows. Table joins, as-of joins and sessions keep state for each key and give signed
changes: a row with ``change`` -1 takes back one that was shown before, a row with +1 is new. Signed changes add up in any
order, so what tasks and batches show at different times needs no order: :func:`settled_rows` of all changes is the current result.

The RocksDB state store provider is needed (``streaming.runner.with_defaults``). Output is appended.
"""

from __future__ import annotations

import decimal
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import LakeError
from ..functions.aggregates import Aggregate, Aggregation
from ..operators.relational import WINDOW_END, WINDOW_START, _sides, event_time, windowed
from ..records import PARTITION, TIMESTAMP, metadata, payload, require

CHANGE = "change"
_NAN = float("nan")
#: Times keep their microseconds in JSON.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _packed(df: DataFrame, names: Sequence[str]) -> Column:
    """The columns ``names`` as one JSON text: a payload that state keeps and shows, but doesn't look into."""
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), _JSON) if names else F.lit("{}")


def _unpacked(text: Column, schema: T.StructType) -> Column:
    return F.from_json(text, schema, _JSON)


def _nullable(schema: T.StructType, names: Sequence[str], prefix: str = "") -> list[T.StructField]:
    return [T.StructField(prefix + n, schema[n].dataType, True) for n in names]


class _Keyed(StatefulProcessor):
    """Base: no timers, nothing to close."""

    def close(self) -> None:
        return None


def _ordered(v):
    """Spark's order of doubles: NaN after all others."""
    return (v != v, v) if isinstance(v, float) else v


def _fold(function: Aggregate) -> Callable:
    """(state, value) -> state, nulls skipped; also for two states, but for counts."""
    if function is Aggregate.SUM:
        return lambda s, v: s if v is None else v if s is None else s + v
    if function is Aggregate.MIN:
        return lambda s, v: s if v is None or s is not None and _ordered(s) <= _ordered(v) else v
    return lambda s, v: s if v is None or s is not None and _ordered(s) >= _ordered(v) else v


class _Groups(_Keyed):
    """A partition's groups: map state from group (and window) to partial aggregates, and the partition's stream time."""

    def __init__(self, key: T.StructType, value: T.StructType, functions: list[Aggregate], size: int | None, retention: int | None, changed_only: bool, names: list[str]):
        self.key, self.value, self.functions, self.size, self.retention, self.changed_only, self.names = key, value, functions, size, retention, changed_only, names
        self.whole = [f is Aggregate.SUM and isinstance(v.dataType, T.DecimalType) and not v.dataType.scale for f, v in zip(functions, value)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.time = handle.getValueState("time", "latest bigint, oldest_end bigint")
        self.groups = handle.getMapState("groups", self.key, self.value)

    def _own(self, v):
        return bytes(v) if isinstance(v, bytearray) else _NAN if isinstance(v, float) and v != v else v

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        k, folds = len(self.key), [None if f is Aggregate.COUNT else _fold(f) for f in self.functions]
        touched: dict[tuple, list] = {}
        latest = None
        with decimal.localcontext(prec=76):
            for row in rows:
                values = tuple(row)[1:]  # after the partition
                if self.size and (latest is None or values[-1] > latest):
                    latest = values[-1]
                group = tuple(self._own(v) for v in values[:k])
                state = touched.get(group)
                if state is None:
                    state = touched[group] = [0 if f is None else None for f in folds]
                for i, f in enumerate(folds):
                    state[i] = state[i] + 1 if f is None else f(state[i], values[k + i])
            floor = None
            if self.size:
                before = self.time.get() if self.time.exists() else (None, None)
                latest = latest if before[0] is None else max(latest, before[0])
                floor = latest - self.retention
                ends = [g[-1] + self.size for g in touched if g[-1] + self.size >= floor]
                oldest = min([*ends, *([before[1]] if before[1] is not None else [])], default=None)
                if oldest is not None and oldest < floor:
                    gone = [g for g in map(tuple, self.groups.keys()) if g[-1] + self.size < floor]
                    for g in gone:
                        self.groups.removeKey(g)
                    oldest = min([g[-1] + self.size for g in map(tuple, self.groups.keys())] + ends, default=None)
                self.time.update((latest, oldest))
            out = []
            for group, state in touched.items():
                if floor is not None and group[-1] + self.size < floor:
                    continue
                if self.groups.containsKey(group):
                    for i, (f, old) in enumerate(zip(folds, self.groups.getValue(group))):
                        old = int(old) if self.whole[i] and old is not None else old
                        state[i] = old + state[i] if f is None else f(old, state[i])
                state = tuple(decimal.Decimal(s) if w and s is not None else s for w, s in zip(self.whole, state))
                self.groups.updateValue(group, state)
                out.append((group, state))
        make = Row(*self.names)
        for group, state in out if self.changed_only else self.groups.iterator():
            yield make(*tuple(group), *tuple(state), key[0])


def group_by(df: DataFrame, keys: Sequence[str], *aggregations: Aggregation, size: int | None = None, retention: int | None = None, changed_only: bool = False) -> DataFrame:
    """A grouping by logical partition of a streaming frame of records, cumulative or by tumbling windows.

    After a batch each partition that had rows shows all its groups (``changed_only``: those it touched). With ``size``, the
    partition's stream time takes in the whole batch, then windows that end before it less ``retention`` go.
    Columns as of ``operators.stateful.GroupBy``. One task serves a partition, as a partition's stream time asks for.
    """
    if not keys:
        raise LakeError("group_by needs at least one key")
    require(df, PARTITION, *keys, *[a.input for a in aggregations])
    if size is not None:
        retention = size if retention is None else retention
        if size < 1 or retention < size:
            raise LakeError("a window needs a millisecond at least, and retention at least the window size")
    rows = windowed(df, size) if size else df
    groups = [*keys, *([WINDOW_START] if size else [])]
    states = [f"__s{i}" for i in range(len(aggregations))]
    key = T.StructType(_nullable(rows.schema, groups, "k_"))
    value = T.StructType([T.StructField(f"{a.function.value}_{i}", a.state_type(df.schema), True) for i, a in enumerate(aggregations)])
    inputs = []
    for i, a in enumerate(aggregations):
        # Whole numbers come as such and are added up as Python's, without bounds.
        inputs.append((F.lit(None).cast("int") if a.function is Aggregate.COUNT else F.col(a.input).cast(a.state_type(df.schema)) if a.function is Aggregate.SUM and isinstance(a.state_type(df.schema), T.DoubleType) else F.col(a.input)).alias(f"__v{i}"))
    time = event_time() if size else F.lit(0).cast("long")
    slim = rows.select(F.col(PARTITION).alias("__p"), *[F.col(g).alias(f"__k{i}") for i, g in enumerate(groups)], *inputs, time.alias("__t"))
    schema = T.StructType([*[T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(key)], *[T.StructField(n, f.dataType) for n, f in zip(states, value)], T.StructField("__p", df.schema[PARTITION].dataType)])
    processor = _Groups(key, value, [a.function for a in aggregations], size, retention, changed_only, schema.names)
    out = slim.groupBy("__p").transformWithState(processor, schema, "append", "None")
    window = [F.col(f"__k{len(keys)}").alias(WINDOW_START), (F.col(f"__k{len(keys)}") + size).alias(WINDOW_END)] if size else []
    rest = [F.col("__p").alias(PARTITION)] if PARTITION not in keys else []
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *window, *[a.result(F.col(s), df.schema).alias(a.output) for a, s in zip(aggregations, states)], *rest)


class _Intervals(_Keyed):
    """A partition's retained rows by side and key, its retained batches with their keys, and its stream time."""

    def __init__(self, key: T.DataType, window: int):
        self.key, self.window = key, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.time = handle.getValueState("time", "latest bigint, batches bigint")
        key = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("k", self.key)])
        self.rows = handle.getMapState("rows", key, "batch array<bigint>, ts array<bigint>, payload array<string>")
        self.batches = handle.getMapState("batches", "side int, batch bigint", T.StructType([T.StructField("latest", T.LongType()), T.StructField("keys", T.ArrayType(self.key))]))

    def _kept(self, side: int, key) -> list[tuple]:
        return list(zip(*self.rows.getValue((side, key)))) if self.rows.containsKey((side, key)) else []

    def _put(self, side: int, key, rows: list[tuple]) -> None:
        if rows:
            self.rows.updateValue((side, key), tuple(list(c) for c in zip(*rows)))
        else:
            self.rows.removeKey((side, key))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new: tuple[dict, dict] = ({}, {})
        tops = [None, None]
        before, number = self.time.get() if self.time.exists() else (None, 0)
        for _, side, k, ts, text in rows:
            tops[side] = ts if tops[side] is None else max(ts, tops[side])
            if k is not None:
                new[side].setdefault(bytes(k) if isinstance(k, bytearray) else k, []).append((number, ts, text))
        latest = max(t for t in (*tops, before) if t is not None)
        self.time.update((latest, number + 1))
        for (side, batch), (top, keys) in [(tuple(k), tuple(v)) for k, v in self.batches.iterator()]:
            if top < latest - self.window:
                for k in keys:
                    self._put(side, k, [r for r in self._kept(side, k) if r[0] != batch])
                self.batches.removeKey((side, batch))
        make = Row("__l", "__r")
        old = tuple({k: self._kept(side, k) for k in new[0].keys() | new[1].keys()} for side in (0, 1))
        for k in old[0]:
            fresh = new[0].get(k, []), new[1].get(k, [])
            for ones, others in ((fresh[0], fresh[1]), (fresh[0], old[1][k]), (old[0][k], fresh[1])):
                for _, a, x in ones:
                    for _, b, y in others:
                        if abs(a - b) <= self.window:
                            yield make(x, y)
        for side in (0, 1):
            for k, added in new[side].items():
                self._put(side, k, old[side][k] + added)
            if tops[side] is not None:
                self.batches.updateValue((side, number), (tops[side], list(new[side])))


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, left_prefix: str = "left_", right_prefix: str = "right_") -> DataFrame:
    """Pairs of two streaming frames with equal keys, in one partition, at most ``window`` milliseconds apart.

    A batch first moves its partition's one stream time; retained batches whose latest row lies before it less the window
    go whole; then new rows meet retained and new ones. Columns as of ``operators.relational.interval_join``.
    """
    left_names, right_names = _sides(left, right, left_key, right_key, window, left_prefix, right_prefix)
    require(left, PARTITION), require(right, PARTITION)

    def slim(df: DataFrame, side: int, key: str, names: list[str]) -> DataFrame:
        return df.select(F.col(PARTITION).alias("__p"), F.lit(side).alias("side"), F.col(key).alias("k"), event_time().alias("ts"), _packed(df, names).alias("payload"))

    kept = [*payload(left), *metadata(left)]
    both = slim(left, 0, left_key, kept).union(slim(right, 1, right_key, payload(right)))
    out = both.groupBy("__p").transformWithState(_Intervals(left.schema[left_key].dataType, window), "__l string, __r string", "append", "None")
    out = out.select(_unpacked(F.col("__l"), T.StructType(_nullable(left.schema, kept))).alias("__l"), _unpacked(F.col("__r"), T.StructType(_nullable(right.schema, payload(right)))).alias("__r"))
    columns = [F.col(f"__l.`{c}`").alias(n) for c, n in zip(payload(left), left_names)] + [F.col(f"__r.`{c}`").alias(n) for c, n in zip(payload(right), right_names)]
    return out.select(*columns, *[F.col(f"__l.`{m}`").alias(m) for m in metadata(left)])


# Tables as changelogs: frames with a key, a ``version`` that orders a key's rows (the largest counts, whenever it comes),
# payload columns, and perhaps ``deleted``, which makes a row a tombstone.

VERSION, DELETED = "version", "deleted"


def _values(df: DataFrame, key: str, side: str, prefix: str) -> tuple[list[str], list[str]]:
    names = [c for c in df.columns if c not in (key, VERSION, DELETED)]
    require(df, key, VERSION)
    return names, [prefix + n for n in names]


def _changes(df: DataFrame, key: str, side: int, names: list[str], *more: Column) -> DataFrame:
    """(key, side, version, text or null for a tombstone, more)."""
    text = _packed(df, names)
    text = F.when(F.coalesce(F.col(DELETED), F.lit(False)), F.lit(None)).otherwise(text) if DELETED in df.columns else text
    return df.select(F.col(key).alias("__k"), F.lit(side).alias("side"), F.col(VERSION).cast("long").alias("v"), text.alias("payload"), *more)


class _TableJoin(_Keyed):
    """Both sides' current row of a key. A batch's last rows replace them; the join's old row is taken back, the new one shown."""

    def __init__(self, how: str):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = [handle.getValueState(n, "version bigint, payload string") for n in ("left_row", "right_row")]

    def _joined(self, rows: list) -> tuple | None:
        left, right = rows
        need = {"inner": left is not None and right is not None, "left": left is not None, "full": left is not None or right is not None}
        return (left, right) if need[self.how] else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = [tuple(s.get()) if s.exists() else (None, None) for s in self.sides]
        was = self._joined([n[1] for n in now])
        moved = [False, False]
        for _, side, version, text in rows:
            if now[side][0] is None or version >= now[side][0]:
                now[side], moved[side] = (version, text), True
        for state, value, m in zip(self.sides, now, moved):
            if m:
                state.update(value)  # a tombstone stays, with its version: older rows may still come
        shown = self._joined([n[1] for n in now])
        make = Row("__k", "__l", "__r", CHANGE)
        if was != shown:
            if was is not None:
                yield make(key[0], *was, -1)
            if shown is not None:
                yield make(key[0], *shown, 1)


def table_join(left: DataFrame, right: DataFrame, key: str = "key", how: str = "inner", left_prefix: str = "left_", right_prefix: str = "right_") -> DataFrame:
    """Two tables' changelogs joined by key (inner, left or full), as signed changes: key, both sides' columns prefixed, ``change``.

    Each batch shows at most one row taken back and one new row for a key. A null key joins nothing and shows nothing.
    """
    if how not in ("inner", "left", "full"):
        raise LakeError(f"tables are joined inner, left or full, not {how}")
    (a, an), (b, bn) = _values(left, key, "left", left_prefix), _values(right, key, "right", right_prefix)
    both = _changes(left, key, 0, a).union(_changes(right, key, 1, b)).filter("__k is not null")
    schema = T.StructType([T.StructField("__k", left.schema[key].dataType), T.StructField("__l", T.StringType()), T.StructField("__r", T.StringType()), T.StructField(CHANGE, T.IntegerType())])
    out = both.groupBy("__k").transformWithState(_TableJoin(how), schema, "append", "None")
    return _both_sides(out, F.col("__k").alias(key), left, a, an, right, b, bn)


def _both_sides(out: DataFrame, key: Column, left: DataFrame, a: list[str], an: list[str], right: DataFrame, b: list[str], bn: list[str]) -> DataFrame:
    parts = out.withColumns({"__l": _unpacked(F.col("__l"), T.StructType(_nullable(left.schema, a))), "__r": _unpacked(F.col("__r"), T.StructType(_nullable(right.schema, b)))})
    return parts.select(key, *[F.col(f"__l.`{c}`").alias(n) for c, n in zip(a, an)], *[F.col(f"__r.`{c}`").alias(n) for c, n in zip(b, bn)], CHANGE)


#: Groups of keys of a foreign-key join, by hash: one visit to the store serves all rows that a batch has for a group. As long as a checkpoint lasts, this stays.
GROUPS = 4096
#: Rows of a leaf at most, and rows of an output frame.
LEAF = 8192


def _group(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(GROUPS)).cast("int").alias("g")


def _identity(df: DataFrame, key: str) -> Column:
    """A key as a text that is equal if and only if the keys are."""
    kind, value = df.schema[key].dataType, F.col(key)
    if isinstance(kind, (T.StringType, T.IntegralType)):
        return value.cast("string")
    return F.to_json(F.struct((value + F.lit(0).cast(kind) if isinstance(kind, T.FractionalType) else value).alias("k")), _JSON)  # -0.0 is 0.0


class _Leaves:
    """A group's entries: map state from a leaf to the entries whose last key part hashes to it, as arrays. A leaf is read and written whole, and leaves double as they fill."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, keys: str, values: str):
        self.width = len(keys.split())
        self.leaves = handle.getMapState(name, "leaf int", ", ".join([f"{n} array<string>" for n in keys.split()] + [f"{v} array<{'bigint' if v == 'version' else 'string'}>" for v in values.split()]))
        self.size = handle.getValueState(f"{name}_size", "leaves int, entries bigint")

    def open(self) -> None:
        """For the group at hand."""
        told = self.size.get()
        self.known = told is not None
        self.n, self.entries = told or (1, 0)
        self.was = self.n, self.entries

    def leaf(self, key: tuple, n: int | None = None) -> int:
        n = n or self.n
        return crc32(key[-1].encode()) % n if n > 1 else 0

    def dealt(self, keys) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {}
        for key in keys:
            out.setdefault(self.leaf(key), []).append(key)
        return out

    def get(self, leaf: int) -> dict[tuple, tuple]:
        columns = self.leaves.getValue((leaf,)) if self.known else None
        return {} if columns is None else dict(zip(zip(*columns[: self.width]), zip(*columns[self.width :])))

    def put(self, leaf: int, entries: dict[tuple, tuple], before: int) -> None:
        self.entries += len(entries) - before
        if entries:
            self.leaves.updateValue((leaf,), (*map(list, zip(*entries)), *map(list, zip(*entries.values()))))
        elif before:
            self.leaves.removeKey((leaf,))

    def close(self) -> None:
        while self.entries > self.n * LEAF:
            self.known = True
            for leaf in range(self.n):
                whole, moved = self.get(leaf), {}
                for key in [k for k in whole if self.leaf(k, 2 * self.n) != leaf]:
                    moved[key] = whole.pop(key)
                if moved:
                    self.put(leaf, whole, len(whole) + len(moved))
                    self.put(leaf + self.n, moved, 0)
            self.n *= 2
        if (self.n, self.entries) != self.was:
            self.size.update((self.n, self.entries))


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, LEAF)):
        yield pd.DataFrame(dict(zip(names, map(list, zip(*part)))))


class _Subscriber(_Keyed):
    """Primary keys' versions and the places of their rows (which foreign key, or nowhere): tells the places whose row is there now, and whose no more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = _Leaves(handle, "rows", "pk", "version place")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[tuple, tuple] = {}
        for df in rows:
            for pk, version, foreign, text in zip(*(df[c].tolist() for c in ("pk", "v", "fk", "payload"))):
                old = new.get((pk,))
                if old is None or version >= old[0]:
                    # Where nothing is named, each primary key has a place of its own, so that null is no hot key.
                    new[(pk,)] = version, None if text is None else f"-{pk}" if foreign is None else f"+{foreign}", text
        yield from _frames(self._told(new), ["fk", "pk", "payload"])

    def _told(self, new: dict[tuple, tuple]) -> Iterator[tuple]:
        self.rows.open()
        for leaf, keys in self.rows.dealt(new).items():
            kept = self.rows.get(leaf)
            before = len(kept)
            for k in keys:
                version, place, text = new[k]
                was, left = kept.get(k, (version, None))
                if version < was:
                    continue
                kept[k] = version, place  # a tombstone stays, with its version: older rows may still come
                if left is not None and left != place:
                    yield left, k[0], None
                if place is not None:
                    yield place, k[0], text
            self.rows.put(leaf, kept, before)
        self.rows.close()


class _Subscriptions(_Keyed):
    """Foreign keys' rows, and who names them with what: an inverted index from foreign to primary keys."""

    def __init__(self, how: str):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = _Leaves(handle, "rows", "fk", "version payload")
        self.named = _Leaves(handle, "subscriptions", "fk pk", "payload")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        orders: dict[tuple, str | None] = {}
        others: dict[tuple, tuple] = {}
        for df in rows:
            for side, fk, pk, version, text in zip(*(df[c].tolist() for c in ("side", "fk", "pk", "v", "payload"))):
                if side == 0:
                    orders[(fk, pk)] = text
                elif (fk,) not in others or version >= others[(fk,)][0]:
                    others[(fk,)] = version, text
        yield from _frames(self._shown(orders, others), ["__l", "__r", CHANGE])

    def _foreign(self, new: dict[tuple, tuple]) -> tuple[dict[str, str | None], dict[str, str | None]]:
        """The group's foreign rows before the batch, and those that it changes."""
        before, changed = {}, {}
        self.rows.open()
        dealt = self.rows.dealt(new)
        for leaf in range(self.rows.n):
            kept = self.rows.get(leaf)
            n = len(kept)
            before.update((fk, text) for (fk,), (_, text) in kept.items())
            for k in dealt.get(leaf, []):
                version, text = kept.get(k, (None, None))
                if version is None or new[k][0] >= version:
                    kept[k] = new[k]
                    if new[k][1] != text:
                        changed[k[0]] = new[k][1]
            if leaf in dealt:
                self.rows.put(leaf, kept, n)
        self.rows.close()
        return before, changed

    def _shown(self, orders: dict[tuple, str | None], others: dict[tuple, tuple]) -> Iterator[tuple]:
        before, changed = self._foreign(others)
        shows = lambda text: text is not None or self.how == "left"
        self.named.open()
        dealt = self.named.dealt(orders)
        # The old row of each whose own row changes, then everyone's of the foreign rows that changed.
        for leaf in range(self.named.n) if changed else list(dealt):
            kept, mine = self.named.get(leaf), dealt.get(leaf, [])
            n = len(kept)
            for k in mine:
                was, text = before.get(k[0]), orders[k]
                now = changed.get(k[0], was)
                if kept.get(k) == (text,) and was == now:
                    continue
                if k in kept and shows(was):
                    yield kept[k][0], was, -1
                if text is None:
                    kept.pop(k, None)
                else:
                    kept[k] = (text,)
                    if shows(now):
                        yield text, now, 1
            if changed:
                for k, (text,) in kept.items():
                    if k[0] in changed and k not in orders:
                        was, now = before.get(k[0]), changed[k[0]]
                        if shows(was):
                            yield text, was, -1
                        if shows(now):
                            yield text, now, 1
            if mine:
                self.named.put(leaf, kept, n)
        self.named.close()


def foreign_join(left: DataFrame, right: DataFrame, foreign_key: Column, key: str = "key", right_key: str = "key", how: str = "inner", left_prefix: str = "left_", right_prefix: str = "right_") -> DataFrame:
    """A table's changelog joined by a foreign key with another's, kept up as both change (inner or left), as signed changes.

    A first operator, by primary key, sends each row to the foreign key that it names, and leaves the one named before; a second, by foreign
    key, keeps the rows that name it, so a change of the other table's row is shown for just these. Both keep their rows by groups of keys (``GROUPS``), in
    leaves of at most ``LEAF`` rows or so that are read and written whole. Rows of a left join that name nothing
    are dealt by primary key. Columns: key, both sides' columns prefixed, ``change``.
    """
    if how not in ("inner", "left"):
        raise LakeError(f"a foreign-key join is inner or left, not {how}")
    (a, an), (b, bn) = _values(left, key, "left", left_prefix), _values(right, right_key, "right", right_prefix)
    # The key goes along in the row's text. A row without a version comes before all others.
    version = F.coalesce("v", F.lit(-(2**63))).alias("v")
    one = _changes(left, key, 0, [*a, key], _identity(left, key).alias("pk"), foreign_key.cast("string").alias("fk")).filter("__k is not null")
    sent = one.select(_group("pk"), "pk", version, "fk", "payload").groupBy("g").transformWithStateInPandas(_Subscriber(), "fk string, pk string, payload string", "append", "None")
    sent = sent.select(_group("fk"), F.lit(0).alias("side"), "fk", "pk", F.lit(0).cast("long").alias("v"), "payload")
    other = _changes(right, right_key, 1, b).filter("__k is not null").withColumn("fk", F.concat(F.lit("+"), F.col("__k").cast("string")))
    other = other.select(_group("fk"), "side", "fk", F.lit(None).cast("string").alias("pk"), version, "payload")
    out = sent.union(other).groupBy("g").transformWithStateInPandas(_Subscriptions(how), f"__l string, __r string, {CHANGE} int", "append", "None")
    return _both_sides(out, F.col(f"__l.`{key}`").alias(key), left, [*a, key], an, right, b, bn)


class _Versions(_Keyed):
    """A key's versions as intervals of validity, and the records that met them, both as far back as the history goes."""

    def __init__(self, history: int, how: str):
        self.history, self.how = history, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "latest bigint, starts array<bigint>")
        self.versions = handle.getMapState("versions", "valid_from bigint", "valid_to bigint, rank bigint, payload string")
        self.records = handle.getMapState("records", "ts bigint", "payload array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        make = Row("__k", "__l", "__r", CHANGE)
        latest, starts = (lambda s: (s[0], list(s[1])))(self.index.get()) if self.index.exists() else (None, [])
        horizon = float("-inf") if latest is None else latest - self.history
        records, changed = {}, {}
        for _, side, ts, rank, text in rows:
            latest = ts if latest is None else max(latest, ts)
            if side == 0:
                records.setdefault(ts, []).append(text)
            elif ts not in changed or rank >= changed[ts][0]:
                changed[ts] = (rank, text)

        def valid(ts: int, begins: list[int]) -> int | None:
            at = bisect_right(begins, ts) - 1
            return begins[at] if at >= 0 else None

        def said(begin: int | None) -> str | None:
            return None if begin is None else self.versions.getValue((begin,))[2]

        def shown(ts: int, text: str, version: str | None, sign: int) -> list[Row]:
            return [make(key[0], text, version, sign)] if version is not None or self.how == "left" else []

        # Records that a new version is about: those from its time to the next version's. Versions before the history change nothing.
        new = sorted(t for t, (rank, _) in changed.items() if t >= horizon and not (self.versions.containsKey((t,)) and self.versions.getValue((t,))[1] > rank))
        was = {}
        if new:
            kept = sorted(tuple(k)[0] for k in self.records.keys())
            for ts in {t for v in new for t in kept[bisect_left(kept, v) : bisect_left(kept, min([s for s in starts if s > v], default=float("inf")))]}:
                was[ts] = said(valid(ts, starts))
        for v in new:
            if not self.versions.containsKey((v,)):
                insort(starts, v)
            at = bisect_left(starts, v)
            following = starts[at + 1] if at + 1 < len(starts) else None
            self.versions.updateValue((v,), (following, *changed[v]))
            if at:
                _, rank, text = tuple(self.versions.getValue((starts[at - 1],)))
                self.versions.updateValue((starts[at - 1],), (v, rank, text))
        for ts, old in was.items():
            now = said(valid(ts, starts))
            if now != old:
                for text in self.records.getValue((ts,))[0]:
                    yield from shown(ts, text, old, -1)
                    yield from shown(ts, text, now, 1)
        for ts, texts in records.items():
            version = said(valid(ts, starts)) if ts >= horizon else None
            for text in texts:
                yield from shown(ts, text, version, 1)
            if ts >= horizon:
                before = list(self.records.getValue((ts,))[0]) if self.records.containsKey((ts,)) else []
                self.records.updateValue((ts,), (before + texts,))
        # What now lies before the history goes, but for the version that is valid at its beginning.
        horizon = latest - self.history
        for ts in [tuple(k)[0] for k in self.records.keys() if tuple(k)[0] < horizon]:
            self.records.removeKey((ts,))
        first = max(0, bisect_right(starts, horizon) - 1)
        for v in starts[:first]:
            self.versions.removeKey((v,))
        self.index.update((latest, starts[first:]))


def as_of_join(records: DataFrame, versions: DataFrame, history: int, key: str = "key", time: str = "ts", how: str = "inner", record_prefix: str = "", version_prefix: str = "version_") -> DataFrame:
    """Each record of a stream with its key's version as of its time (the latest not after it), as signed changes.

    ``versions`` come with a ``time`` from which they hold and perhaps ``version`` (of equal times the largest counts), or ``deleted``. A key's
    time is the latest that it had seen before the batch. A version that comes late takes back what records up to ``history`` milliseconds before that
    time were shown with, and shows them anew; older ones change nothing, and records older than that find no version. So
    the sum of all changes does not depend on how rows come, as long as none is later than ``history``. Null keys and times take no part.
    """
    if how not in ("inner", "left") or history < 0:
        raise LakeError("an as-of join is inner or left, and its history not negative")
    a = [c for c in records.columns if c != key]
    b = [c for c in versions.columns if c not in (key, VERSION, DELETED)]
    rank = F.col(VERSION).cast("long") if VERSION in versions.columns else F.lit(0).cast("long")
    text = F.when(F.coalesce(F.col(DELETED), F.lit(False)), F.lit(None)).otherwise(_packed(versions, b)) if DELETED in versions.columns else _packed(versions, b)
    one = records.select(F.col(key).alias("__k"), F.lit(0).alias("side"), F.col(time).cast("long").alias("ts"), F.lit(0).cast("long").alias("rank"), _packed(records, a).alias("payload"))
    other = versions.select(F.col(key).alias("__k"), F.lit(1).alias("side"), F.col(time).cast("long").alias("ts"), rank.alias("rank"), text.alias("payload"))
    both = one.union(other).filter("__k is not null and ts is not null")
    schema = T.StructType([T.StructField("__k", records.schema[key].dataType), T.StructField("__l", T.StringType()), T.StructField("__r", T.StringType()), T.StructField(CHANGE, T.IntegerType())])
    out = both.groupBy("__k").transformWithState(_Versions(history, how), schema, "append", "None")
    return _both_sides(out, F.col("__k").alias(key), records, a, [record_prefix + c for c in a], versions, b, [version_prefix + c for c in b])


class _Sessions(_Keyed):
    """A key's sessions: map state from a session's start to its end and aggregates. A record joins, extends or connects sessions."""

    def __init__(self, gap: int, functions: list[Aggregate], value: T.StructType, retention: int | None, names: list[str]):
        self.gap, self.functions, self.value, self.retention, self.names = gap, functions, value, retention, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "latest bigint, starts array<bigint>")
        self.sessions = handle.getMapState("sessions", "window_start bigint", T.StructType([T.StructField("window_end", T.LongType()), *self.value.fields]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        folds = [None if f is Aggregate.COUNT else _fold(f) for f in self.functions]
        latest, starts = (lambda s: (s[0], list(s[1])))(self.index.get()) if self.index.exists() else (None, [])
        load = lambda s: list(self.sessions.getValue((s,)))
        before, now = {}, {}
        with decimal.localcontext(prec=76):
            for row in sorted(rows, key=lambda r: r[1]):
                ts, values = row[1], tuple(row)[2:]
                latest = ts if latest is None else max(latest, ts)
                if self.retention is not None and ts < latest - self.retention:
                    continue
                mine = [ts, ts, *[1 if f is None else f(None, v) for f, v in zip(folds, values)]]
                at = bisect_right(starts, ts)
                for s in [*starts[max(0, at - 1) : at], *starts[at : at + 1]]:
                    other = now.get(s) or load(s)
                    if s - self.gap <= ts <= other[0] + self.gap:
                        if s not in now:
                            before[s] = other
                        now.pop(s, None)
                        starts.remove(s)
                        mine = [min(mine[0], s), max(mine[1], other[0]), *[x + y if f is None else f(x, y) for f, x, y in zip(folds, other[1:], mine[2:])]]
                insort(starts, mine[0])
                now[mine[0]] = mine[1:]
        make = Row(*self.names)
        for s, old in before.items():
            if now.get(s) != old:
                yield make(key[0], s, *old, -1)
                if s not in now:
                    self.sessions.removeKey((s,))
        for s, new in now.items():
            if before.get(s) != new:
                yield make(key[0], s, *new, 1)
                self.sessions.updateValue((s,), tuple(new))
        if self.retention is not None:
            gone = [s for s in starts if load(s)[0] < latest - self.retention]
            for s in gone:
                self.sessions.removeKey((s,))
                starts.remove(s)
        self.index.update((latest, starts))


def sessions(df: DataFrame, gap: int, *aggregations: Aggregation, key: str = "key", time: str = "ts", retention: int | None = None) -> DataFrame:
    """Sessions of a streaming frame: a key's records at most ``gap`` milliseconds apart, as signed changes.

    Columns: key, window_start, window_end (times of the first and the last record), outputs, ``change``. Sessions may grow to both sides and connect
    as late records come; with ``retention``, those that end before a key's latest time less it are left alone, and
    records before that are dropped. Null keys and times take no part.
    """
    require(df, key, time, *[a.input for a in aggregations])
    value = T.StructType([T.StructField(f"{a.function.value}_{i}", a.state_type(df.schema), True) for i, a in enumerate(aggregations)])
    inputs = [(F.lit(None).cast("int") if a.function is Aggregate.COUNT else F.col(a.input).cast(a.state_type(df.schema))).alias(f"__v{i}") for i, a in enumerate(aggregations)]
    slim = df.select(F.col(key).alias("__k"), F.col(time).cast("long").alias("__t"), *inputs).filter("__k is not null and __t is not null")
    schema = T.StructType([T.StructField("__k", df.schema[key].dataType), T.StructField("window_start", T.LongType()), T.StructField("window_end", T.LongType()), *[T.StructField(f"__s{i}", f.dataType) for i, f in enumerate(value)], T.StructField(CHANGE, T.IntegerType())])
    out = slim.groupBy("__k").transformWithState(_Sessions(gap, [a.function for a in aggregations], value, retention, schema.names), schema, "append", "None")
    return out.select(F.col("__k").alias(key), "window_start", "window_end", *[a.result(F.col(f"__s{i}"), df.schema).alias(a.output) for i, a in enumerate(aggregations)], CHANGE)


class _Fold(_Keyed):
    """A key's state, a batch's rows folded into it in order."""

    def __init__(self, zero: tuple, step: Callable, schema: T.StructType, order: list[str], names: list[str]):
        self.zero, self.step, self.schema, self.order, self.names = zero, step, schema, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("folded", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = tuple(self.state.get()) if self.state.exists() else None
        now, make = old or self.zero, Row(*self.names)
        for row in sorted((r.asDict() for r in rows), key=lambda r: [(r[o] is not None, r[o]) for o in self.order]):
            now = self.step(now, row)
        self.state.update(now)
        if now != old:
            if old is not None:
                yield make(key[0], *old, -1)
            yield make(key[0], *now, 1)


def fold(df: DataFrame, key: str, order: Sequence[str], zero: tuple, step: Callable[[tuple, dict], tuple], schema: T.StructType) -> DataFrame:
    """A fold over each key's rows as they come (a batch's rows in ``order``), as signed changes: key, the columns of ``schema``, ``change``.

    ``step(state, row)`` as of ``operators.folds.fold``, which does the same for bounded frames. Null keys take no part.
    """
    require(df, key, *order)
    kind = T.StructField(key, df.schema[key].dataType)
    out = T.StructType([kind, *schema.fields, T.StructField(CHANGE, T.IntegerType())])
    return df.filter(F.col(key).isNotNull()).groupBy(key).transformWithState(_Fold(zero, step, schema, list(order), out.names), out, "append", "None")


class _Sliding(_Keyed):
    """A key's times in order, and the aggregates of the records of each time, as far back as windows may still change."""

    def __init__(self, difference: int, functions: list[Aggregate], value: T.StructType, retention: int, names: list[str]):
        self.difference, self.functions, self.value, self.retention, self.names = difference, functions, value, retention, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "latest bigint, times array<bigint>")
        self.moments = handle.getMapState("moments", "ts bigint", self.value)

    def _windows(self, times: list[int], at: Callable[[int], tuple], low: int, high: int, merged: Callable) -> dict[int, tuple]:
        """The windows that start from ``low`` to ``high``: their aggregates by start."""
        d, out = self.difference, {}
        starts = {t - d for t in times[bisect_left(times, low + d) : bisect_right(times, high + d)]}
        starts |= {t + 1 for t in times[bisect_left(times, low - 1) : bisect_right(times, high - 1)]}
        for s in starts:
            inside = times[bisect_left(times, s) : bisect_right(times, s + d)]
            if inside:
                state = at(inside[0])
                for t in inside[1:]:
                    state = merged(state, at(t))
                out[s] = state
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        folds = [None if f is Aggregate.COUNT else _fold(f) for f in self.functions]
        merged = lambda a, b: tuple(x + y if f is None else f(x, y) for f, x, y in zip(folds, a, b))
        latest, times = (lambda s: (s[0], list(s[1])))(self.index.get()) if self.index.exists() else (None, [])
        floor = float("-inf") if latest is None else latest - self.retention
        new: dict[int, tuple] = {}
        loaded: dict[int, tuple] = {}

        def at(t: int) -> tuple:
            if t not in loaded:
                loaded[t] = tuple(self.moments.getValue((t,)))
            return loaded[t]

        make = Row(*self.names)
        with decimal.localcontext(prec=76):
            for row in rows:
                ts = row[1]
                if ts >= floor:
                    mine = tuple(1 if f is None else f(None, v) for f, v in zip(folds, tuple(row)[2:]))
                    new[ts] = merged(new[ts], mine) if ts in new else mine
            # A record changes the windows that hold it: those that start up to the difference before it. Such stretches are compared before and after.
            spans: list[list[int]] = []
            for ts in sorted(new):
                if spans and ts - self.difference <= spans[-1][1] + 1:
                    spans[-1][1] = ts + 1
                else:
                    spans.append([ts - self.difference, ts + 1])
            before = [self._windows(times, at, low, high, merged) for low, high in spans]
            for ts, state in new.items():
                if self.moments.containsKey((ts,)):
                    state = merged(at(ts), state)
                else:
                    insort(times, ts)
                loaded[ts] = state
                self.moments.updateValue((ts,), state)
            for (low, high), old in zip(spans, before):
                now = self._windows(times, at, low, high, merged)
                for s in sorted(old.keys() | now.keys()):
                    if old.get(s) != now.get(s):
                        if s in old:
                            yield make(key[0], s, *old[s], -1)
                        if s in now:
                            yield make(key[0], s, *now[s], 1)
        latest = max([*new, *([latest] if latest is not None else [])], default=latest)
        if latest is not None:
            keep = bisect_left(times, latest - self.retention - self.difference - 1)
            for t in times[:keep]:
                self.moments.removeKey((t,))
            self.index.update((latest, times[keep:]))


def sliding(df: DataFrame, difference: int, *aggregations: Aggregation, retention: int, key: str = "key", time: str = "ts") -> DataFrame:
    """Windows of a streaming frame that are aligned to records, as signed changes: those that end at a record, and those that begin right after one and aren't empty.

    Both ends belong to a window, ``difference`` milliseconds apart. Columns: key, window_start, window_end, outputs, ``change``. A record that is more than
    ``retention`` before what its key had seen before the batch is left out, so windows older than that don't change any more.
    Null keys and times take no part. Doubles are added up in order of time.
    """
    require(df, key, time, *[a.input for a in aggregations])
    if difference < 0 or retention < 0:
        raise LakeError("a window's difference and retention are not negative")
    value = T.StructType([T.StructField(f"{a.function.value}_{i}", a.state_type(df.schema), True) for i, a in enumerate(aggregations)])
    inputs = [(F.lit(None).cast("int") if a.function is Aggregate.COUNT else F.col(a.input).cast(a.state_type(df.schema))).alias(f"__v{i}") for i, a in enumerate(aggregations)]
    slim = df.select(F.col(key).alias("__k"), F.col(time).cast("long").alias("__t"), *inputs).filter("__k is not null and __t is not null")
    schema = T.StructType([T.StructField("__k", df.schema[key].dataType), T.StructField("window_start", T.LongType()), *[T.StructField(f"__s{i}", f.dataType) for i, f in enumerate(value)], T.StructField(CHANGE, T.IntegerType())])
    out = slim.groupBy("__k").transformWithState(_Sliding(difference, [a.function for a in aggregations], value, retention, schema.names), schema, "append", "None")
    return out.select(F.col("__k").alias(key), "window_start", (F.col("window_start") + difference).alias("window_end"), *[a.result(F.col(f"__s{i}"), df.schema).alias(a.output) for i, a in enumerate(aggregations)], CHANGE)


def settled_rows(changes: DataFrame) -> DataFrame:
    """The rows that are left when all signed changes of a bounded frame are added up, each as often as it counts; without ``change``."""
    names = [c for c in changes.columns if c != CHANGE]
    counted = changes.groupBy(*names).agg(F.sum(CHANGE).alias("__n")).filter("__n > 0")
    return counted.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*names)


def _state(spark, checkpoint: str, variable: str, **options) -> DataFrame:
    return spark.read.format("statestore").options(stateVarName=variable, **{k: str(v) for k, v in options.items()}).load(checkpoint)


def read_map(spark, checkpoint: str, variable: str, **options) -> DataFrame:
    """A map state of a query, by its checkpoint, as a frame: the grouping key as ``key``, then the map's own key and value columns.

    The variables: groups (of ``group_by``: a window store), rows, batches (``interval_join``), subscriptions (``foreign_join``), versions,
    records (``as_of_join``), sessions. Filters on the frame are lookups by key, by range of keys or of times. Options as
    Spark's state reader has them: operatorId, batchId (an earlier batch's state).
    """
    return _state(spark, checkpoint, variable, **options).select("key", "user_map_key.*", "user_map_value.*")


def read_value(spark, checkpoint: str, variable: str, **options) -> DataFrame:
    """A value state of a query (time, index, row, left_row, right_row), one row for each grouping key."""
    return _state(spark, checkpoint, variable, **options).select("key", "value.*")
