"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``4`` bits agree in at least 4 of their 8 bytes: so many
shared positional bytes a pair is guaranteed to have. A posting list holds the fingerprints that share the
bytes at three positions, for 20 sets of three such that any four of the eight positions hold one of
them. Every pair that meets in a list has its shared positional bytes counted, is kept if they reach the
guaranteed minimum, and is then verified bit by bit. (Lists of single bytes would be 2**16 times as
long: each pair of fingerprints meets in them with a chance of 8 in 256.)

Only different fingerprints are indexed, so copies cost nothing. Links are never written out as pairs: a
fingerprint keeps one partner, classes are merged, and what had a link is searched again for links to
other classes until there are none, so nothing is lost. Long lists are split by a further byte, those
whose fingerprints are all of one class fall away, and else only what is not of a list's main class is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import as_bytes, fresh, map_texts, scratch, slices, without, written
from .components import components

SEED = 42


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 if it has no word.

    A-Z are lowered; words are what lies between ASCII white space. Each shingle of ``width``
    words, joined by a space, counts with its repeats; fewer words make one shingle. A bit is 1 if
    it is set in over half the shingles' XXH64 (seed 42).
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip((ends - lengths)[: 1 - width].tolist(), ends[width - 1 :].tolist())], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", width: int = 4) -> DataFrame:
    """``docs``, all columns kept, with the fingerprint as a signed 64-bit number in ``out``, in place of a column so named."""
    docs = without(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                fps = np.array([fingerprint(t, width) for t in as_bytes(part.column(text_col))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps)], [*part.schema.names, out])

    return map_texts(docs, task, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _triples() -> list[tuple[int, ...]]:
    """20 sets of three of the eight positions: any four positions hold one of them.

    The positions lie in three groups on a circle. A set is a whole group, or two of a group and one of the
    next: of four positions some group holds three, or two groups hold two each, or one two and both others one.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [g for g in groups if len(g) == 3]
    for i, g in enumerate(groups):
        out += [(*two, p) for two in combinations(g, 2) for p in groups[(i + 1) % 3]]
    return out


#: Lists of more entries than this are split.
LONG = 256
#: Rounds of pivots before long lists are searched; they spare comparisons, and what they leave is found all the same.
PIVOT_ROUNDS = 3


def _finer(mask: int) -> list[int]:
    """The masks by which a long list of ``mask`` (its shared bits) is split; any pair of at most 4 different bits meets in one of the parts.

    Three bytes: with each of the other five, as a fourth byte is shared. Four bytes: of the eight half bytes in the rest at least four are
    shared, hence three of one of the 20 sets. Lists of seven shared bytes and half bytes are not split.
    """
    free = [p for p in range(8) if not mask >> 8 * p & 255]
    if len(free) == 5:
        return [mask | 255 << 8 * p for p in free]
    if len(free) == 4 and not any(mask >> 4 * h & 15 for p in free for h in (2 * p, 2 * p + 1)):
        halves = [h for p in free for h in (2 * p, 2 * p + 1)]
        return [mask | sum(15 << 4 * halves[i] for i in three) for three in _triples()]
    return []


#: Lists by level: the shared bits of each kind of list, and of those that split it.
_LEVELS = [[sum(255 << 8 * p for p in at) for at in _triples()]]
for _ in range(2):
    _LEVELS.append(sorted({m for mask in _LEVELS[-1] for m in _finer(mask)}))


def _linked(a: Column, b: Column, bits: int) -> Column:
    """The count filter and the verification of a pair: shared positional bytes, then different bits."""
    x = a.bitwiseXOR(b)
    spread = x
    for shift in (4, 2, 1):
        spread = spread.bitwiseOR(F.shiftrightunsigned(spread, shift))
    different = F.bit_count(spread.bitwiseAND(F.lit(0x0101010101010101)))  # a bit for each byte that differs
    return (different <= bits) & (F.bit_count(x) <= bits)


def _entries(nodes: DataFrame) -> DataFrame:
    """Entries (node, root, mask, bytes) of the first level's lists."""
    lists = F.explode(F.array(*[F.lit(_signed(m)) for m in _LEVELS[0]])).alias("mask")
    kept = [c for c in ("node", "root") if c in nodes.columns]
    return nodes.select(*kept, lists).withColumn("bytes", F.col("node").bitwiseAND(F.col("mask")))


def _split(entries: DataFrame) -> DataFrame:
    """Each entry of a long list, once for each finer list."""
    pairs = [(_signed(m), _signed(f)) for level in _LEVELS[:2] for m in level for f in _finer(m)]
    finer = entries.sparkSession.createDataFrame(pairs, "was long, mask long")  # 1,500 rows
    out = entries.withColumnRenamed("mask", "was").drop("bytes").join(F.broadcast(finer), "was").drop("was")
    return out.withColumn("bytes", F.col("node").bitwiseAND(F.col("mask")))


#: A level's lists that are split: (mask, bytes) of the long ones, and their entries (node, mask, bytes).
Long = tuple[DataFrame, DataFrame]


def _long_lists(nodes: DataFrame, long: int, put: Callable[[DataFrame], DataFrame]) -> list[Long]:
    """The lists with over ``long`` entries, of each level that has some and can be split further. Their entries are made once and kept."""
    out, entries = [], _entries(nodes)
    for level in _LEVELS[:2]:
        found = put(entries.groupBy("mask", "bytes").agg(F.count("*").alias("n")).filter(F.col("n") > long).select("mask", "bytes", F.lit(True).alias("long")))
        if found.isEmpty():
            break
        inside = put(entries.join(found, ["mask", "bytes"], "left_semi").select("node", "mask", "bytes"))
        out.append((found, inside))
        entries = _split(inside)
    return out


def _dealt(nodes: DataFrame, lists: list[Long]) -> list[DataFrame]:
    """The entries of the short lists, and of those of each further level: lists that are short, or can't be split."""
    out, entries = [], _entries(nodes)
    for found, inside in lists:
        out.append(entries.join(found, ["mask", "bytes"], "left_anti"))
        entries = _split(inside).join(nodes.select("node", "root"), "node")
    return [*out, entries]


def _with_main(entries: DataFrame) -> DataFrame:
    """Entries of lists that have several classes, with the largest class of each as ``main``."""
    of_class = entries.groupBy("mask", "bytes", "root").agg(F.count("*").alias("n"))
    main = of_class.groupBy("mask", "bytes").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("classes")).filter("classes > 1").drop("classes")
    return entries.join(main, ["mask", "bytes"])


def _partners(nodes: DataFrame, bits: int, lists: list[Long]) -> DataFrame:
    """(node, root, other) for every node with a link to a node of another class: other is one such class."""
    found = []
    for level, entries in enumerate(_dealt(nodes, lists)):
        entries = _with_main(entries) if level else entries
        left, right = (entries.filter("root != main") if level else entries).alias("l"), entries.alias("r")
        once = F.col("l.node") < F.col("r.node")
        once = once | (F.col("r.root") == F.col("r.main")) if level else once
        same = (F.col("l.mask") == F.col("r.mask")) & (F.col("l.bytes") == F.col("r.bytes"))
        pairs = left.join(right, same & once & (F.col("l.root") != F.col("r.root")) & _linked(F.col("l.node"), F.col("r.node"), bits))
        ends = [F.struct(F.col(f"{a}.node").alias("node"), F.col(f"{a}.root").alias("root"), F.col(f"{b}.root").alias("other")) for a, b in ("lr", "rl")]
        found.append(pairs.select(F.inline(F.array(*ends))))
    return reduce(DataFrame.union, found).groupBy("node", "root").agg(F.min("other").alias("other"))


def _pivots(nodes: DataFrame, bits: int, long: Long) -> DataFrame:
    """Edges (a, b) between classes in long lists: each list's entries outside its main class with the one of them that is nearest to their most frequent bytes."""
    entries = _with_main(long[1].join(nodes.select("node", "root"), "node")).filter("root != main")
    each = entries.select("mask", "bytes", F.posexplode(F.array(*[F.shiftrightunsigned("node", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)])).alias("at", "byte"))
    counted = each.groupBy("mask", "bytes", "at", "byte").agg(F.count("*").alias("n"))
    best = counted.groupBy("mask", "bytes", "at").agg(F.max(F.struct("n", "byte"))["byte"].alias("byte"))
    centre = best.groupBy("mask", "bytes").agg(F.bit_or(F.expr("shiftleft(byte, 8 * at)")).alias("centre"))
    distance = F.bit_count(F.col("node").bitwiseXOR(F.col("centre")))
    pivot = entries.join(centre, ["mask", "bytes"]).groupBy("mask", "bytes").agg(F.min(F.struct(distance.alias("d"), "node", "root")).alias("p"))
    linked = entries.join(pivot, ["mask", "bytes"]).filter((F.col("root") != F.col("p.root")) & _linked(F.col("node"), F.col("p.node"), bits))
    return linked.select(F.col("root").alias("a"), F.col("p.root").alias("b")).distinct()


def _merged(state: DataFrame, edges: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``state`` with the classes that edges(a, b) of roots connect merged."""
    moved = components(edges).select(F.col("node").alias("was"), F.col("root").alias("now"))
    joined = state.join(moved, F.col("root") == F.col("was"), "left")
    return put(joined.select("node", F.coalesce("now", "root").alias("root"), (F.col("linked") | F.col("now").isNotNull()).alias("linked")))


def linked_classes(fps: DataFrame, bits: int = 4, long: int = LONG) -> DataFrame:
    """node, root, linked for the different numbers in ``fps.fp``: roots are equal if and only if links of at most ``bits`` <= 4 bits connect them.

    ``linked``: whether it has a link. If there are long lists, links within groups of ``bits`` neighbouring bits, of which a
    fingerprint has at most 15 a group, and links to the lists' pivots come first: they merge dense classes before the lists are searched.
    """
    if not 0 <= bits <= 4:
        raise ValueError("four shared bytes are guaranteed for at most 4 bits")
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark) as put:
        state = put(fps.select(F.col("fp").alias("node"), F.col("fp").alias("root"), F.lit(False).alias("linked")).repartition(n, "node"))
        lists = _long_lists(state, long, put) if bits else []
        if lists:
            masks = [_signed(~(((1 << bits) - 1) << at) & (1 << 64) - 1) for at in range(0, 64, bits)]
            near_ones = state.select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("node").bitwiseAND(F.lit(m)).alias("rest")) for i, m in enumerate(masks)])).alias("g"))
            groups = near_ones.groupBy("g").agg(F.collect_list("node").alias("all")).filter(F.size("all") > 1)
            state = _merged(state, groups.select(F.array_min("all").alias("a"), F.explode("all").alias("b")), put)
            for _ in range(PIVOT_ROUNDS):
                edges = put(_pivots(state, bits, lists[0]))
                if edges.isEmpty():
                    break
                state = _merged(state, edges, put)
        active = state
        while bits:
            found = put(_partners(active, bits, lists))
            if found.isEmpty():
                break
            state = _merged(state, found.select(F.col("root").alias("a"), F.col("other").alias("b")), put)
            active = put(state.join(found.select(F.col("node").alias("again")), F.col("node") == F.col("again"), "left_semi"))
        return written(state)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """``id_col, fp, component_id`` for every row: the smallest id reachable by links.

    Equal fingerprints link. Null, empty and blank texts have the fingerprint 0, linked like any
    other. Repeated rows come out repeatedly. A null id counts as larger than all others, so a
    component id is null only if all its ids are. An empty table gives no rows.
    """
    rows = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "fp"))
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    # Most fingerprints have no link: only those that have one meet by their root.
    linked = linked_classes(distinct.select("fp"), bits).filter("linked").select("node", "root")
    rooted = written(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", "root"))
    smallest = rooted.filter("root is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    with_link = rooted.filter("root is not null").join(smallest, "root").select(F.col("fp").alias("k"), F.col("smallest").alias("component_id"))
    named = with_link.union(rooted.filter("root is null").select("fp", "least"))
    return rows.join(named, F.col("fp") == F.col("k")).select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, jaccard: float | None = None, width: int = 5) -> DataFrame:
    """One row of each class of near-duplicates, all columns kept: the one with the smallest id.

    Texts are near-duplicates if their fingerprints differ in at most ``bits`` bits, and, with ``jaccard``, also if the
    sets of their shingles of ``width`` words are that similar (see :mod:`.shingles`). Of its rows with that id, one stays, whatever classes
    other rows with the id are in; of rows that agree in id and text the one whose columns' hash is smallest. Rows without
    an id: one stays of each class that has no other.
    """
    # Rows with the same id and text are of the same class, so the two tell which class's row it is.
    key, own, chosen_hash, text_hash, row_hash, place = fresh(docs, "chosen_id", "own_id", "chosen_hash", "text_hash", "row_hash", "place")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = written(fingerprints(rows, "text").select("id", "h", "fp"))
    first = written(rows.groupBy("fp", "h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")))
    roots = linked_classes(first.select("fp").distinct(), bits).filter("linked")
    first = first.join(roots, F.col("fp") == F.col("node"), "left").select("h", "first", F.coalesce("root", "fp").alias("root"))
    if jaccard is not None:
        first = written(first)
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
        state = shingles.classes(texts, first.select("h", "first.id", "root"), width, jaccard)
        first = first.drop("root").join(state, "h")
    first = first.groupBy("root").agg(F.min(F.struct("first.none", "first.id", "h")).alias("first"))
    # An id in a struct equals itself also if null, so the texts are dealt out once, by the same two columns for the join and the window.
    chosen = first.select(F.struct(F.col("first.id").alias("id")).alias(key), F.col("first.h").alias(chosen_hash))
    same = (F.col(own) == F.col(key)) & (F.col(text_hash) == F.col(chosen_hash))
    kept = docs.withColumns({own: F.struct(F.col(id_col).alias("id")), text_hash: F.xxhash64(text_col)}).join(chosen, same, "left_semi")
    # Few ids are there twice, so their rows are numbered without the texts' being sorted by anything else.
    order = Window.partitionBy(own, text_hash).orderBy(row_hash)
    return kept.withColumn(row_hash, F.xxhash64(*docs.columns)).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*docs.columns)
