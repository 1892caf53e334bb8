"""Graphs of sources, operators, merges, joins and sinks: declared, validated, compiled to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LakeError
from ..functions.aggregates import Aggregation
from ..operators import relational as R
from ..operators import stateful as S
from ..records import PARTITION
from ..sources.codecs import Codec
from .storage import written


@dataclass(frozen=True)
class Node:
    """A named element of one topology."""

    name: str
    kind: str
    owner: int = field(repr=False)
    parents: tuple[Node, ...] = ()
    topics: tuple[str, ...] = ()
    codec: Codec | None = field(default=None, repr=False)
    operator: Callable[[], S.Operator] | None = field(default=None, repr=False)


class Topology:
    """A builder. Parents are declared before their children, so there are no cycles."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []

    def _add(self, name: str, kind: str, parents: Sequence[Node] = (), **rest) -> Node:
        if not name:
            raise LakeError("a node needs a name")
        if any(n.name == name for n in self.nodes):
            raise LakeError(f"duplicate node name: {name}")
        for p in parents:
            if p.owner != id(self):
                raise ValueError(f"node {p.name} belongs to another topology")
            if p.kind == "sink":
                raise LakeError(f"a sink can't be a parent: {p.name}")
        node = Node(name, kind, id(self), tuple(parents), **rest)
        self.nodes.append(node)
        return node

    def add_source(self, name: str, topics: Sequence[str] | str, codec: Codec) -> Node:
        topics = (topics,) if isinstance(topics, str) else tuple(topics)
        if not topics:
            raise LakeError(f"source {name} needs at least one topic")
        return self._add(name, "source", topics=topics, codec=codec)

    def add_operator(self, name: str, operator: Callable[[], S.Operator] | Callable[[DataFrame], DataFrame] | S.Operator, parent: Node) -> Node:
        """``operator``: an operator, a class or function without arguments that makes one, or a function of a DataFrame."""
        return self._add(name, "operator", [parent], operator=_maker(operator))

    def add_filter(self, name: str, predicate: Column | str, parent: Node) -> Node:
        return self.add_operator(name, S.Stateless(lambda df: R.filter_rows(df, predicate)), parent)

    def add_select(self, name: str, columns: Sequence[str], parent: Node) -> Node:
        return self.add_operator(name, S.Stateless(lambda df: R.select(df, *columns)), parent)

    def add_with_columns(self, name: str, derived: Sequence[R.Derived], parent: Node) -> Node:
        return self.add_operator(name, S.Stateless(lambda df: R.with_columns(df, *derived)), parent)

    def add_group_by(self, name: str, keys: Sequence[str], aggregations: Sequence[Aggregation], parent: Node, size: int | None = None, retention: int | None = None) -> Node:
        S.GroupBy(keys, aggregations, size, retention)  # validates
        return self._add(name, "operator", [parent], operator=lambda: S.GroupBy(keys, aggregations, size, retention))

    def add_merge(self, name: str, parents: Sequence[Node]) -> Node:
        if len(parents) < 2:
            raise LakeError(f"merge {name} needs at least two parents")
        return self._add(name, "merge", parents)

    def add_join(self, name: str, join: S.IntervalJoin, left: Node, right: Node) -> Node:
        return self._add(name, "join", [left, right], operator=lambda: S.IntervalJoin(join.left_key, join.right_key, join.window, join.left_prefix, join.right_prefix))

    def add_sink(self, name: str, topic: str, codec: Codec, parent: Node) -> Node:
        return self._add(name, "sink", [parent], topics=(topic,), codec=codec)

    def add_pass_through_sink(self, name: str, topic: str, source: Node) -> Node:
        """A sink of a source's raw records: values aren't decoded, so malformed ones pass."""
        if source.kind != "source":
            raise LakeError(f"pass-through sink {name} needs a source as parent")
        return self._add(name, "sink", [source], topics=(topic,))

    def source_topics(self) -> list[str]:
        return list(dict.fromkeys(t for n in self.nodes if n.kind == "source" for t in n.topics))

    def validate(self) -> None:
        if not any(n.kind == "source" for n in self.nodes):
            raise LakeError("a topology needs a source")
        if not any(n.kind == "sink" for n in self.nodes):
            raise LakeError("a topology needs a sink")

    def build(self) -> BuiltTopology:
        """A runtime of its own, with fresh state."""
        self.validate()
        return BuiltTopology(list(self.nodes))


def _maker(operator) -> Callable[[], S.Operator]:
    if isinstance(operator, S.Operator):
        if operator.stateful:
            from copy import copy

            return lambda: copy(operator)
        return lambda: operator
    if isinstance(operator, type) and issubclass(operator, S.Operator):
        return operator
    try:
        import inspect

        arguments = len([p for p in inspect.signature(operator).parameters.values() if p.default is p.empty])
    except (TypeError, ValueError):
        arguments = 1
    return operator if arguments == 0 else (lambda: S.Stateless(operator))


class BuiltTopology:
    """Runs batches. State stays between runs, each logical partition's apart from the others'."""

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes
        self.operators = {n.name: n.operator() for n in nodes if n.operator}
        self.state: dict[str, S.State] = {}

    def run_batch(self, topic: str, raw: DataFrame) -> dict[str, DataFrame]:
        """One topic's raw records (schema ``RAW``) through the graph: raw records by sink topic."""
        return self.run_batches({topic: raw})

    def run_batches(self, raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """One batch of each topic. A topic that no source declares is ignored.

        The topics of one source flow one after the other; a join sees one batch from each side. The
        result is lazy except for state, which is written to the shared folder.
        """
        outputs: dict[str, list[DataFrame]] = {}
        given = {node.name: [(t, raw[t]) for t in node.topics if t in raw] for node in self.nodes if node.kind == "source"}
        frames: dict[str, list[DataFrame]] = {}
        for node in self.nodes:
            if node.kind == "source":
                # Decoding is part of the lazy plan: a source that feeds pass-through sinks alone is never decoded.
                frames[node.name] = [node.codec.for_topic(t).decode(r) for t, r in given[node.name]] if self._decodes(node) else []
            elif node.kind == "operator":
                frames[node.name] = [self._run(node, [b]) for b in frames[node.parents[0].name]]
            elif node.kind == "join":
                left, right = (frames[p.name] for p in node.parents)
                frames[node.name] = self._join(node, left, right)
            elif node.kind == "merge":
                batches = [b for p in node.parents for b in frames[p.name]]
                frames[node.name] = [R.merge(*batches)] if len(batches) > 1 else batches
            elif node.codec is None:
                outputs.setdefault(node.topics[0], []).extend(r.select("key", "value", F.col("timestamp"), "partition", "offset", "headers") for _, r in given[node.parents[0].name])
            else:
                outputs.setdefault(node.topics[0], []).extend(node.codec.for_topic(node.topics[0]).encode(b) for b in frames[node.parents[0].name])
        return {t: _union(fs) for t, fs in outputs.items() if fs}

    def frames_of(self, name: str, raw: Mapping[str, DataFrame]) -> DataFrame:
        """The columns that flow out of an operator for one batch, not encoded (for queries and tests)."""
        at = [n.name for n in self.nodes].index(name)
        node = self.nodes[at]
        head = BuiltTopology.__new__(BuiltTopology)
        head.nodes = [*self.nodes[: at + 1], Node("__tap", "sink", 0, (node,), ("__tap",), _Tap())]
        head.operators, head.state = self.operators, self.state
        return head.run_batches(raw)["__tap"]

    def _decodes(self, node: Node) -> bool:
        return any(node in n.parents and not (n.kind == "sink" and n.codec is None) for n in self.nodes)

    def _run(self, node: Node, batches: list[DataFrame]) -> DataFrame:
        operator = self.operators[node.name]
        out, state = operator.process(batches, self.state.get(node.name, {}))
        if operator.stateful:
            self.state[node.name] = {k: written(v) for k, v in state.items()}
        return out

    def _join(self, node: Node, left: list[DataFrame], right: list[DataFrame]) -> list[DataFrame]:
        if not left and not right:
            return []
        old = self.state.get(node.name, {})  # a silent side is an empty batch of the schema it had before
        left = left or ([old["left"].drop("__batch_max").limit(0)] if "left" in old else [])
        right = right or ([old["right"].drop("__batch_max").limit(0)] if "right" in old else [])
        if not left or not right:
            raise LakeError(f"join {node.name}: the first run needs a batch, perhaps an empty one, on both sides")
        left, right = _union(left), _union(right)
        return [self._run(node, [left, right])]

    def snapshot(self, path: str) -> None:
        """All state, written below ``path`` (a shared folder) as Parquet, a folder for each node and part."""
        for name, state in self.state.items():
            for part, df in state.items():
                df.write.mode("overwrite").parquet(f"{path}/{name}/{part}")

    def restore(self, spark, path: str, parts: Mapping[str, Sequence[str]], partition: int | None = None) -> None:
        """State read again from ``path`` and kept apart from it: the parts of each node; names of nodes that aren't here are ignored.

        With ``partition`` only that partition's state is taken from there, in place of what is here; other partitions keep theirs.
        """
        for name, state in parts.items():
            if name not in self.operators:
                continue
            read = {p: spark.read.parquet(f"{path}/{name}/{p}") for p in state}
            if partition is None:
                self.state[name] = {p: written(df) for p, df in read.items()}
                continue
            here = self.state.setdefault(name, {})
            for part, df in read.items():
                column = _partition_of(df)
                taken = df.filter(F.col(column).eqNullSafe(F.lit(partition))) if column else df
                if column and part in here:
                    taken = here[part].filter(~F.col(column).eqNullSafe(F.lit(partition))).unionByName(taken)
                here[part] = written(taken)

    def parts(self) -> dict[str, list[str]]:
        """What :meth:`restore` needs to know of a snapshot."""
        return {name: list(state) for name, state in self.state.items()}

    def release(self, partition: int) -> None:
        """Forgets the state of one partition."""
        for name, state in self.state.items():
            for part, df in state.items():
                column = _partition_of(df)
                if column:
                    self.state[name][part] = written(df.filter(~F.col(column).eqNullSafe(F.lit(partition))))

    def close(self) -> None:
        self.state.clear()


def _partition_of(df: DataFrame) -> str | None:
    """The column of a part of the state that holds the logical partition."""
    return PARTITION if PARTITION in df.columns else "__p" if "__p" in df.columns else None


class _Tap(Codec):
    def encode(self, df: DataFrame) -> DataFrame:
        return df


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out
