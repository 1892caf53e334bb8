"""Metrics of streaming queries without actions of their own: what Spark observes while a batch runs.

:func:`measured` counts a frame's rows (and whatever else is asked) where it is used; :class:`QueryMetrics` listens and adds up.

    metrics = QueryMetrics().attach(spark)
    query = measured(operator(measured(source, "in")), "out").writeStream...
    metrics.of(query)    # Totals(batches=..., input=..., output=..., failures=..., nanos=...)
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

ROWS = "rows"


@dataclass
class Totals:
    """What a query did so far. ``input``: rows that its sources gave; ``observed``: by name and measure, sums over batches."""

    batches: int = 0
    input: int = 0
    output: int = 0
    failures: int = 0
    nanos: int = 0
    state_rows: int = 0
    dropped_late: int = 0
    observed: dict[str, dict[str, int]] = field(default_factory=dict)


def measured(df: DataFrame, name: str, **measures: Column) -> DataFrame:
    """``df``, its rows counted under ``name`` as it runs; ``measures`` are further aggregates (sums add up over batches)."""
    return df.observe(name, F.count(F.lit(1)).alias(ROWS), *[c.alias(n) for n, c in measures.items()])


class QueryMetrics(StreamingQueryListener):
    """Totals of each query of a session. ``output`` is what was observed under the name ``out``, else what the sink reports (not all do)."""

    def __init__(self, out: str = "out"):
        self.out, self._totals, self._ended, self._lock = out, {}, set(), threading.Condition()

    def attach(self, spark: SparkSession) -> QueryMetrics:
        spark.streams.addListener(self)
        return self

    def of(self, query: StreamingQuery | str, ended: float | None = None) -> Totals:
        """The totals of a query (or of its id), over all its runs; ``ended``: wait so many seconds at most until its end was told."""
        key = query if isinstance(query, str) else str(query.id)
        with self._lock:
            if ended is not None:
                self._lock.wait_for(lambda: key in self._ended, ended)
            return self._totals.get(key, Totals())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self._totals.setdefault(str(event.id), Totals())
            self._ended.discard(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            t = self._totals.setdefault(str(p.id), Totals())
            if not p.numInputRows and not p.observedMetrics:
                return
            t.batches += 1
            t.input += p.numInputRows
            t.nanos += int(p.durationMs.get("triggerExecution", 0)) * 1_000_000
            t.state_rows = sum(s.numRowsTotal for s in p.stateOperators)
            t.dropped_late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            for name, row in p.observedMetrics.items():
                sums = t.observed.setdefault(name, {})
                for measure, value in row.asDict().items():
                    if value is not None:
                        sums[measure] = sums.get(measure, 0) + value
            reported = p.observedMetrics[self.out][ROWS] if self.out in p.observedMetrics else p.sink.numOutputRows
            t.output += max(reported or 0, 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return None

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            t = self._totals.setdefault(str(event.id), Totals())
            t.failures += event.exception is not None
            self._ended.add(str(event.id))
            self._lock.notify_all()
