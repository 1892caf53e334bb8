"""A stream and table DSL over DataFrames: keyed records, latest-by-key tables, windows and joins.

A frame has a key column, a time column (milliseconds) and payload columns. Everything that has a
streaming meaning works on streaming DataFrames too (set watermarks with :meth:`Stream.watermark`);
what needs whole inputs says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LakeError

START, END = "window_start", "window_end"


def _span(ms: int) -> str:
    return f"{ms} milliseconds"


@dataclass(frozen=True)
class Stream:
    """Keyed records in time."""

    df: DataFrame
    key: str = "key"
    time: str = "ts"

    def _with(self, df: DataFrame, **changes) -> Stream:
        return replace(self, df=df, **changes)

    def watermark(self, delay: int) -> Stream:
        """Lateness allowed in event time, for streaming frames: adds the column ``event_time``."""
        return self._with(self.df.withColumn("event_time", F.timestamp_millis(self.time)).withWatermark("event_time", _span(delay)))

    # Stateless.
    def filter(self, predicate: Column) -> Stream:
        return self._with(self.df.filter(predicate))

    def filter_not(self, predicate: Column) -> Stream:
        return self._with(self.df.filter(~predicate))

    def map(self, key: Column, **values: Column) -> Stream:
        """New key and payload; the time stays."""
        return self._with(self.df.select(key.alias(self.key), F.col(self.time), *[c.alias(n) for n, c in values.items()]))

    def map_values(self, **values: Column) -> Stream:
        return self._with(self.df.select(self.key, self.time, *[c.alias(n) for n, c in values.items()]))

    def flat_map_values(self, name: str, values: Column) -> Stream:
        """A row for each element of the array ``values``, as column ``name``."""
        return self._with(self.df.withColumn(name, F.explode(values)))

    def flat_map(self, records: Column) -> Stream:
        """A row for each struct in the array ``records``, which names the key and payload; the time stays."""
        exploded = self.df.select(F.col(self.time).alias("__t"), F.explode(records).alias("__r"))
        out = exploded.select("__r.*", F.col("__t").alias(self.time))
        if self.key not in out.columns:
            raise LakeError(f"flat_map's records need the key {self.key}")
        return self._with(out)

    def peek(self, name: str, *measures: Column) -> Stream:
        """Observed while it runs: ``measures`` appear under ``name`` in query listeners."""
        return self._with(self.df.observe(name, *(measures or (F.count(F.lit(1)).alias("rows"),))))

    def foreach(self, function: Callable) -> None:
        """Runs ``function`` on each row where it lies; bounded frames."""
        self.df.foreach(function)

    def select_key(self, key: Column) -> Stream:
        return self._with(self.df.withColumn(self.key, key))

    def branch(self, *predicates: Column) -> list[Stream]:
        """Each record to the first predicate that accepts it."""
        from ..operators.relational import split

        return [self._with(d) for d in split(self.df, *predicates)]

    def merge(self, other: Stream) -> Stream:
        return self._with(self.df.unionByName(other.df))

    def repartition(self, n: int | None = None) -> Stream:
        return self._with(self.df.repartition(n, self.key) if n else self.df.repartition(self.key))

    def to_table(self, *order: str) -> Table:
        """The latest record of each key, by time and then ``order``."""
        return Table.latest(self, *order)

    # Grouping.
    def group_by_key(self) -> Grouped:
        return Grouped(self)

    def group_by(self, key: Column) -> Grouped:
        return Grouped(self.select_key(key))

    # Joins.
    def join(self, other: Stream, before: int, after: int | None = None, how: str = "inner") -> DataFrame:
        """Pairs with equal keys whose other record lies from ``before`` ms before to ``after`` ms after this one's.

        ``how``: inner, left or full. Columns of both sides get the prefixes left_ and right_. On streaming
        frames both sides need watermarks.
        """
        after = before if after is None else after
        a, b = (s.df.select(*[F.col(c).alias(p + c) for c in s.df.columns]) for s, p in ((self, "left_"), (other, "right_")))
        on = F.col("left_" + self.key) == F.col("right_" + other.key)
        if self.df.isStreaming:
            lt, rt = F.col("left_event_time"), F.col("right_event_time")
            on &= (rt >= lt - F.expr(f"INTERVAL {before} MILLISECOND")) & (rt <= lt + F.expr(f"INTERVAL {after} MILLISECOND"))
            return a.join(b, on, {"inner": "inner", "left": "leftOuter", "full": "fullOuter"}[how])
        # A key's records meet by time bucket, so a hot key is spread over its time. One side lies in one bucket, the other in those it can meet.
        lt, rt, width = F.col("left_" + self.time), F.col("right_" + other.time), max(1, before + after)
        on &= rt.between(lt - before, lt + after) & (F.col("__l") == F.col("__r"))

        def bucket(t: Column) -> Column:
            return F.floor(t / width)

        met = b.withColumn("__r", F.explode(F.sequence(bucket(rt - after), bucket(rt + before))))
        out = a.withColumn("__l", bucket(lt)).join(met, on, "inner" if how == "inner" else "leftOuter").drop("__l", "__r")
        if how != "full":
            return out
        met = a.withColumn("__l", F.explode(F.sequence(bucket(lt - before), bucket(lt + after))))
        alone = b.withColumn("__r", bucket(rt)).join(met, on, "left_anti").drop("__r")
        untimed = rt.isNull() | F.col("right_" + other.key).isNull()
        return out.unionByName(alone.filter(~untimed).unionByName(b.filter(untimed)), allowMissingColumns=True)

    def to(self, topic: str, sink: Callable[[str, DataFrame, int], None], batch: int = 0) -> None:
        """Hands the records to a sink (of ``streaming.runner``, or any function of topic, frame and batch number)."""
        sink(topic, self.df, batch)

    def print(self, rows: int = 20) -> Stream:
        """Shows the first records of a bounded stream, and goes on."""
        self.df.show(rows, truncate=False)
        return self

    def join_table(self, table: Table, how: str = "inner") -> DataFrame:
        """Each record with its key's current row of the table (payload columns prefixed table_)."""
        right = table.df.select(F.col(table.key).alias("__k"), *[F.col(c).alias("table_" + c) for c in table.df.columns if c != table.key])
        return self.df.join(right, F.col(self.key) == F.col("__k"), {"inner": "inner", "left": "leftOuter"}[how]).drop("__k")

    def join_global(self, table: Table, key: Column, how: str = "inner", limit: int = 1_000_000) -> DataFrame:
        """Each record with the table's row for any key expression; the table is broadcast if it has at most ``limit`` rows."""
        right = table.df.select(F.col(table.key).alias("__k"), *[F.col(c).alias("table_" + c) for c in table.df.columns if c != table.key])
        if not right.isStreaming and right.limit(limit + 1).count() <= limit:
            right = F.broadcast(right)
        return self.df.join(right, key == F.col("__k"), {"inner": "inner", "left": "leftOuter"}[how]).drop("__k")

    def join_as_of(self, versions: Stream, how: str = "inner") -> DataFrame:
        """Each record with its key's version as of its time (the latest not after it; bounded frames).

        Both sides go through one window by key, so each is shuffled once and no range of pairs is made.
        """
        own = [c for c in versions.df.columns if c not in (versions.key, versions.time)]
        a = self.df.select(F.col(self.key).alias("__k"), F.col(self.time).alias("__t"), F.lit(1).alias("__side"), F.struct(*self.df.columns).alias("__row"), F.lit(None).cast(versions.df.select(F.struct(versions.time, *own).alias("v")).schema["v"].dataType).alias("__v"))
        b = versions.df.select(F.col(versions.key).alias("__k"), F.col(versions.time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(versions.time, *own).alias("__v"))
        w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
        out = a.union(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
        if how == "inner":
            out = out.filter("__v is not null")
        return out.select("__row.*", F.col(f"__v.{versions.time}").alias("version_" + versions.time), *[F.col(f"__v.{c}").alias("version_" + c) for c in own])


@dataclass(frozen=True)
class Grouped:
    """Records by key, all of time."""

    stream: Stream

    def count(self, name: str = "count") -> Table:
        return self.aggregate(F.count(F.lit(1)).alias(name))

    def aggregate(self, *measures: Column) -> Table:
        s = self.stream
        return Table(s.df.groupBy(s.key).agg(*measures), s.key, s.time)

    def reduce(self, value: Column, function: Callable[[Column, Column], Column], name: str = "value") -> Table:
        """``function`` folded over each key's values in time order (bounded; a key's values meet in one task)."""
        s = self.stream
        pairs = F.sort_array(F.collect_list(F.struct(F.col(s.time).alias("t"), value.alias("v"))))
        folded = s.df.groupBy(s.key).agg(pairs.alias("__p"))
        values = F.transform("__p", lambda p: p["v"])
        return Table(folded.select(s.key, F.aggregate(F.slice(values, F.lit(2), F.size(values) - 1), values[0], function).alias(name)), s.key, s.time)

    def cogroup(self, measures: list[Column], other: Grouped, other_measures: list[Column]) -> Table:
        """One row a key from the aggregates of both groupings (null where a side has none)."""
        a, b = self.aggregate(*measures), other.aggregate(*other_measures)
        return a.join(b, "full")

    def windowed_by(self, size: int, advance: int | None = None) -> Windowed:
        """Tumbling windows, or hopping ones every ``advance`` ms."""
        return Windowed(self.stream, size, size if advance is None else advance)

    def session(self, gap: int, *measures: Column) -> DataFrame:
        """Sessions: records of a key at most ``gap`` ms apart. Columns: key, window_start, window_end (of the last record), measures."""
        s = self.stream
        at = F.col("event_time") if s.df.isStreaming else F.timestamp_millis(F.col(s.time))
        grouped = s.df.groupBy(s.key, F.session_window(at, _span(gap)).alias("__w"))
        out = grouped.agg(*(measures or (F.count(F.lit(1)).alias("count"),)))
        return out.select(s.key, F.unix_millis("__w.start").alias(START), (F.unix_millis("__w.end") - gap).alias(END), *[c for c in out.columns if c not in (s.key, "__w")])

    def sliding(self, difference: int, measure: Callable[[Window], Column], name: str = "value") -> DataFrame:
        """Windows aligned to records: those that end at one, and those that begin right after one and aren't empty.

        Both ends belong to a window, ``difference`` ms apart. ``measure`` gets the window specification
        and applies its aggregate over it. Bounded frames.
        """
        s = self.stream
        by = Window.partitionBy(s.key).orderBy(s.time)
        later = by.rangeBetween(1, difference + 1)
        # Both windows of a record come out of one shuffle and one sort.
        both = s.df.select(s.key, F.col(s.time).alias("__t"), measure(by.rangeBetween(-difference, 0)).alias("__a"), measure(later).alias("__b"), F.count(F.lit(1)).over(later).alias("__n"))
        ends = F.struct((F.col("__t") - difference).alias(START), F.col("__a").alias(name))
        begins = F.struct((F.col("__t") + 1).alias(START), F.col("__b").alias(name))
        rows = both.select(s.key, F.explode(F.when(F.col("__n") > 0, F.array(ends, begins)).otherwise(F.array(ends))).alias("__w"))
        return rows.select(s.key, "__w.*").dropDuplicates([s.key, START]).select(s.key, START, (F.col(START) + difference).alias(END), name)


@dataclass(frozen=True)
class Windowed:
    """Records by key and window."""

    stream: Stream
    size: int
    advance: int

    def count(self, name: str = "count") -> DataFrame:
        return self.aggregate(F.count(F.lit(1)).alias(name))

    def aggregate(self, *measures: Column) -> DataFrame:
        """Columns: key, window_start, window_end, measures."""
        s = self.stream
        if s.df.isStreaming:
            out = s.df.groupBy(s.key, F.window("event_time", _span(self.size), _span(self.advance)).alias("__w")).agg(*measures)
            return out.select(s.key, F.unix_millis("__w.start").alias(START), F.unix_millis("__w.end").alias(END), *[c for c in out.columns if c not in (s.key, "__w")])
        t = F.col(s.time)
        last = t - F.pmod(t, F.lit(self.advance))
        if self.advance == self.size:
            rows = s.df.withColumn(START, last)
        else:
            steps = (self.size - 1) // self.advance
            starts = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: last - i * self.advance)
            rows = s.df.withColumn(START, F.explode(F.filter(starts, lambda x: (x > t - self.size) & (x >= 0))))
        return rows.groupBy(s.key, START).agg(*measures).select(s.key, START, (F.col(START) + self.size).alias(END), *_names(rows, measures))

    def suppressed(self, *measures: Column, grace: int = 0) -> DataFrame:
        """Only windows that are closed: whose end plus ``grace`` the latest time has reached (bounded frames;
        on streaming ones, append mode does the same by the watermark)."""
        s = self.stream
        out = self.aggregate(*(measures or (F.count(F.lit(1)).alias("count"),)))
        if s.df.isStreaming:
            return out
        latest = s.df.agg(F.max(s.time).alias("__st"))
        return out.join(F.broadcast(latest), F.col(END) + grace <= F.col("__st")).drop("__st")  # one row


def _names(rows: DataFrame, measures: tuple[Column, ...]) -> list[str]:
    return rows.groupBy().agg(*measures).columns


@dataclass(frozen=True)
class Table:
    """One row a key."""

    df: DataFrame
    key: str = "key"
    time: str = "ts"

    @staticmethod
    def latest(stream: Stream, *order: str) -> Table:
        """From a changelog: each key's latest record by time, then ``order``. A record whose payload is all null deletes its key."""
        s = stream
        rest = [c for c in s.df.columns if c != s.key]
        values = [c for c in rest if c not in (s.time, *order)]
        best = s.df.groupBy(s.key).agg(F.max_by(F.struct(*rest), F.struct(s.time, *order)).alias("__r"))
        out = best.select(s.key, "__r.*")
        if values:
            gone = F.lit(True)
            for v in values:
                gone &= F.col(v).isNull()
            out = out.filter(~gone)
        return Table(out, s.key, s.time)

    @staticmethod
    def as_of(stream: Stream, time: int, *order: str) -> Table:
        """The table as it was at ``time``."""
        return Table.latest(stream._with(stream.df.filter(F.col(stream.time) <= time)), *order)

    def filter(self, predicate: Column) -> Table:
        return replace(self, df=self.df.filter(predicate))

    def map_values(self, **values: Column) -> Table:
        return replace(self, df=self.df.select(self.key, *[c.alias(n) for n, c in values.items()]))

    def to_stream(self) -> Stream:
        return Stream(self.df, self.key, self.time)

    def get(self, key) -> list:
        """The row of one key (interactive query)."""
        return self.df.filter(F.col(self.key) == F.lit(key)).collect()

    def range(self, low=None, high=None) -> DataFrame:
        """The rows of keys from ``low`` to ``high``, both included, either open."""
        df = self.df
        if low is not None:
            df = df.filter(F.col(self.key) >= F.lit(low))
        return df if high is None else df.filter(F.col(self.key) <= F.lit(high))

    def join(self, other: Table, how: str = "inner") -> Table:
        """By equal keys: inner, left or full. The other side's columns that clash get the prefix right_."""
        right = other.df.select(F.col(other.key).alias("__k"), *[F.col(c).alias("right_" + c if c in self.df.columns else c) for c in other.df.columns if c != other.key])
        out = self.df.join(right, F.col(self.key) == F.col("__k"), {"inner": "inner", "left": "leftOuter", "full": "fullOuter"}[how])
        return replace(self, df=out.withColumn(self.key, F.coalesce(self.key, "__k")).drop("__k"))

    def join_foreign(self, other: Table, foreign_key: Column, how: str = "inner") -> Table:
        """Each row with the other table's row that its ``foreign_key`` names."""
        right = other.df.select(F.col(other.key).alias("__k"), *[F.col(c).alias("right_" + c if c in self.df.columns else c) for c in other.df.columns if c != other.key])
        return replace(self, df=self.df.join(right, foreign_key == F.col("__k"), {"inner": "inner", "left": "leftOuter"}[how]).drop("__k"))
