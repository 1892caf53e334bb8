"""Removal of word sequences that were seen before: exact, over the whole corpus.

A window is ``WINDOW`` consecutive words of one text. It is a repeat if the same words also start
at an earlier place (a smaller id, or earlier in the same text). All words under repeats go.

1. Each window has an anchor: its least hash of ``GRAM`` consecutive words, the leftmost if tied. Equal
   windows have equal anchors at equal places, so only windows with a common anchor need comparing.
   Neighbouring windows with one anchor make a segment. Anchors are counted, combined before the
   shuffle; the segments of an anchor that occurs once fall away.
2. Segments of one anchor with the same content (anchor and content are 64-bit hashes each, together as
   good as 128 bits) are copies of the one at the earliest place, whose words stand for all of them:
   every window of the others starts elsewhere earlier.
3. Where an anchor has different segments, copies begin, end or differ. These segments are read again with their
   words and dealt to shards by anchor. Each shard has a compressed FM-index of them over its own numbers
   of words, and they are streamed against it: backward search gives the matching statistics, and where
   they reach ``WINDOW``, the index locates the earliest of the equal word sequences. A window that
   starts anywhere else is a repeat. This is decided by the words alone.
4. An anchor with very many different segments would fill a shard: its windows are segments of their own,
   with a hash of all their words as anchor, and those whose hash occurs once fall away first. A shard with
   very many windows to be searched has several tasks with the same index.
5. The repeats' ranges meet their texts, and the words under them are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, checkpointed, fresh, map_texts, near, slices, written
from .fmindex import FMIndex

WINDOW, GRAM = 20, 6
#: Different segments of one anchor beyond which its windows are dealt out singly.
HOT = 512
#: Bytes of words in an index, and of words searched in one task.
SHARD, STREAM = 500_000, 4_000_000
#: Anchors (8 bytes each) that may be broadcast.
ANCHORS = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes:
    """64-bit hashes of words; the first ``most`` different ones are remembered."""

    def __init__(self, most: int = 150_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.known.get, words))
        if None in got:
            digest, known = xxhash.xxh3_64_intdigest, self.known
            for i, x in enumerate(got):
                if x is None:
                    got[i] = x = digest(words[i]) - (1 << 63)
                    if len(known) < self.most:
                        known[words[i]] = x
        return np.array(got, np.int64).view(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M
    return x ^ x >> np.uint64(31)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def range_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of the words in each range of ``h``, the same wherever the range lies."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_P, len(h)), dtype=np.uint64)])
    inverse = _powers(_INV, len(h) + 1)
    return _mixed((sums[start + length] - sums[start]) * inverse[start] + length.astype(np.uint64) * _M)


def segments(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts whose word hashes are ``h`` and word counts ``n``: text, start (in its text), windows, anchor, content."""
    width = WINDOW - GRAM + 1
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    windows = np.maximum(n - WINDOW + 1, 0)
    if not windows.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    text = np.repeat(np.arange(len(n)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + first[text]
    grams = np.zeros(len(h) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams = grams * _P + h[j : len(grams) + j]
    grams = _mixed(grams)
    value, place = grams, np.arange(len(grams), dtype=np.int32)

    def least(a: int, size: int) -> None:
        nonlocal value, place
        left, right = value[: len(value) - a], value[a:]
        place = np.where(left <= right, place[: len(place) - a], place[a:])
        value = np.minimum(left, right)

    size = 1
    while 2 * size <= width:
        least(size, size)
        size *= 2
    if size < width:
        least(width - size, size)
    anchor = place[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start = at[begin]
    content = range_hashes(h, start, count + WINDOW - 1)
    return text[begin], start - first[text[begin]], count, grams[anchor[begin]], content


def _segments_of(docs: DataFrame, places: bool) -> DataFrame:
    """Segments of docs(nn, id, v, text): anchor and how often it occurs in a part of the texts or, with ``places``, each by itself."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                split = [t.split() for t in as_bytes(part.column("text"))]
                n = np.array([len(x) for x in split], np.int64)
                with np.errstate(over="ignore"):
                    h = hashes([w for x in split for w in x])
                    text, start, count, anchor, content = segments(h, n)
                if not places:
                    anchor, times = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(times)], ["anchor", "times"])
                    continue
                own = [part.column(c).take(pa.array(text)) for c in ("nn", "id", "v")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], ["nn", "id", "v", "start", "n", "anchor", "content"])

    return map_texts(docs, task, "nn boolean, id long, v long, start int, n int, anchor long, content long" if places else "anchor long, times long")


def _with_words(todo: DataFrame, docs: DataFrame) -> DataFrame:
    """The segments with their words, joined by spaces: nn, id, v, key (the anchor), starts, single, words.

    A text's equal segments are one row. Those of hot anchors become single windows; key is then a hash of all words.
    """
    lists = todo.groupBy("nn", "id", "v").agg(F.collect_set(F.struct("start", "n", "anchor", "hot")).alias("s"))
    joined = docs.join(lists.hint("shuffle_hash"), ["nn", "id", "v"]).select("nn", "id", "v", "text", "s")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch, "text"):
                row, keys, starts, single, said = [], [], [], [], []
                for i, (text, wanted) in enumerate(zip(as_bytes(part.column("text")), part.column("s").to_pylist())):
                    words = text.split()
                    joined_ = b" ".join(words)
                    end = np.cumsum([len(w) + 1 for w in words]).tolist()
                    begin = [0, *end]
                    own: dict[tuple[int, bytes], list[int]] = {}
                    for s in wanted:
                        at, n = s["start"], s["n"]
                        if s["hot"]:
                            for a in range(at, at + n):
                                w = joined_[begin[a] : end[a + WINDOW - 1] - 1]
                                own.setdefault((digest(w) - (1 << 63), w), [True]).append(a)
                        else:
                            own.setdefault((s["anchor"], joined_[begin[at] : end[at + n + WINDOW - 2] - 1]), [False]).append(at)
                    for (key, w), (alone, *places) in own.items():
                        row.append(i)
                        keys.append(key)
                        starts.append(sorted(places))
                        single.append(alone)
                        said.append(w)
                    # Hot anchors may give many windows: batches stay small.
                    if sum(map(len, said)) > 4_000_000:
                        yield made(part, row, keys, starts, single, said)
                        row, keys, starts, single, said = [], [], [], [], []
                yield made(part, row, keys, starts, single, said)

    def made(part: pa.RecordBatch, row: list, keys: list, starts: list, single: list, said: list) -> pa.RecordBatch:
        own = [part.column(c).take(pa.array(row, pa.int64())) for c in ("nn", "id", "v")]
        return pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(single, pa.bool_()), pa.array(said, pa.binary())], ["nn", "id", "v", "key", "starts", "single", "words"])

    return map_texts(joined, task, "nn boolean, id long, v long, key long, starts array<int>, single boolean, words binary")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def search_shard(rows: pa.Table) -> pa.Table:
    """Runs of windows of the rows (nn, id, v, starts, words, lead, own) that start elsewhere earlier: nn, id, v, start, n.

    The index holds the words of the rows with ``lead`` (of equal words, those at the earliest place have it),
    those with ``own`` are searched.
    """
    rows = rows.append_column("start", pc.list_element(rows.column("starts"), 0))
    index = rows.filter(rows.column("lead")).sort_by([("nn", "ascending"), ("id", "ascending"), ("start", "ascending")])
    stream = rows.filter(rows.column("own"))
    nn, ids, begins = (_column(index, c) for c in ("nn", "id", "start"))

    def split(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        return b" ".join(words).split(b" ") if words else [], np.array([w.count(b" ") + 1 for w in words], np.int64)

    flat, lengths = split(index.column("words").to_pylist())
    number: dict[bytes, int] = {}
    texts = np.array([number.setdefault(w, len(number)) for w in flat], np.int64)
    fm = FMIndex(texts, lengths, len(number))
    # Equal segments are searched once.
    said: dict[bytes, int] = {}
    content = np.array([said.setdefault(w, len(said)) for w in stream.column("words").to_pylist()], np.int64)
    flat, lengths = split(list(said))
    words = np.array([number.get(w, -1) for w in flat], np.int64)
    windows = lengths - WINDOW + 1
    first = np.cumsum(windows) - windows
    offset = np.arange(windows.sum()) - np.repeat(first, windows)
    ends = np.repeat(np.cumsum(lengths) - lengths, windows) + offset + WINDOW
    reached, low, high = fm.matches(words, ends, WINDOW)
    found = np.flatnonzero(reached == WINDOW)
    lead = np.full((3, len(ends)), -1, np.int64)
    at = fm.earliest(low[found], high[found])
    text = np.searchsorted(fm.begins, at, side="right") - 1
    lead[:, found] = nn[text], ids[text], begins[text] + at - fm.begins[text]
    # Each start of each row, and each window there.
    starts = stream.column("starts").combine_chunks()
    row = np.repeat(np.arange(len(stream)), starts.value_lengths().to_numpy())
    start = starts.flatten().to_numpy().astype(np.int64)
    many = windows[content[row]]
    place = np.repeat(np.arange(len(row)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    window = first[content[row]][place] + step
    own_nn, own_id = _column(stream, "nn")[row][place], _column(stream, "id")[row][place]
    again = (reached[window] == WINDOW) & ((lead[0, window] != own_nn) | (lead[1, window] != own_id) | (lead[2, window] != start[place] + step))
    edge = np.diff(place, prepend=-1, append=-1) != 0
    head = np.flatnonzero(again & (edge[:-1] | ~np.concatenate([[False], again[:-1]])[: len(again)]))
    tail = np.flatnonzero(again & (edge[1:] | ~np.append(again[1:], False)[: len(again)]))
    of = pa.array(row[place[head]], pa.int64())
    columns = [stream.column(c).combine_chunks().take(of) for c in ("nn", "id", "v")]
    return pa.table([*columns, pa.array((start[place[head]] + step[head]).astype(np.int32)), pa.array((tail - head + 1).astype(np.int32))], names=["nn", "id", "v", "start", "n"])


RANGES = "nn boolean, id long, v long, start int, n int"


def repeat_ranges(docs: DataFrame) -> DataFrame:
    """Runs of repeated windows of docs(nn, id, v, text), no nulls: nn, id, v, start, n."""
    times = _segments_of(docs, False).groupBy("anchor").agg(F.sum("times").alias("times"))
    again = near(checkpointed(times.filter("times > 1").select("anchor")), ANCHORS)
    todo = written(_segments_of(docs, True).join(again, "anchor"))
    place = F.struct("nn", "id", "start", "v", "n")
    kinds = written(todo.groupBy("anchor", "content").agg(F.min(place).alias("at"), F.count("*").alias("times")))
    # Copies of a segment: the join may split the rows of one content.
    several = kinds.filter("times > 1").select("anchor", "content", F.col("at.nn").alias("l_nn"), F.col("at.id").alias("l_id"), F.col("at.start").alias("l_start"))
    elsewhere = (F.col("nn") != F.col("l_nn")) | (F.col("id") != F.col("l_id")) | (F.col("start") != F.col("l_start"))
    copies = written(todo.join(several, ["anchor", "content"]).filter(elsewhere).select("nn", "id", "v", "start", "n"))
    # Different segments of an anchor, each at its earliest place.
    hot = F.col("kinds") > HOT
    differ = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor", hot.alias("hot"))
    worded = written(_with_words(kinds.join(differ, "anchor").select("anchor", "at.*", "hot"), docs))
    single = worded.filter("single")
    start = F.get("starts", F.lit(0)).alias("start")
    first = single.groupBy("key").agg(F.sum(F.size("starts")).alias("times"), F.min(F.struct("nn", "id", start)).alias("at")).filter("times > 1").select("key", "at")
    repeated = single.join(near(checkpointed(first)), "key").withColumn("lead", F.struct("nn", "id", start) == F.col("at")).select(*worded.columns, "lead")
    every = worded.filter("not single").withColumn("lead", F.lit(True)).union(repeated)
    size = F.sum(F.octet_length("words") + 4 * F.size("starts"))
    shards = 1 + (every.filter("lead").agg(size).first()[0] or 0) // SHARD
    every = every.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    tasks = near(checkpointed(every.groupBy("shard").agg(F.ceil(size / STREAM).cast("int").alias("tasks"))))
    every = every.join(tasks, "shard").withColumn("mine", F.pmod(F.xxhash64("nn", "id", "v", "starts"), F.col("tasks")).cast("int"))
    every = every.withColumn("task", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array("mine"))))
    dealt = every.select("shard", "task", "nn", "id", "v", "starts", "words", "lead", (F.col("task") == F.col("mine")).alias("own"))
    return copies.union(dealt.groupBy("shard", "task").applyInArrow(lambda rows: search_shard(rows.drop_columns(["shard", "task"])), RANGES))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nn, id, v, text) without nulls: nn marks null ids, which are last; v is a hash that tells texts under one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).isNull().alias("nn"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("v"), text.alias("text"))


def _covered(n: int, ranges: list[dict]) -> np.ndarray:
    """Marks of the words, of ``n``, under windows that start in the ranges."""
    edge = np.zeros(n + 1, np.int64)
    for r in ranges:
        edge[r["start"]] += 1
        edge[min(r["start"] + r["n"] + WINDOW - 1, n)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _lists(ranges: DataFrame, names: list[str]) -> DataFrame:
    """The set of each text's ranges: nn, id, v, r by ``names``. It is smaller than the texts it meets, so it is hashed."""
    return ranges.groupBy("nn", "id", "v").agg(F.collect_set(F.struct("start", "n")).alias("r")).toDF(*names).hint("shuffle_hash")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`remove` takes from each text: id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space).

    A null text has no words. Rows with one id are at one place: neither is earlier than the other,
    so repeated rows are both kept. Null ids are one id that comes after all others. Ids are
    integers. An empty table gives no rows.
    """
    plain = _keyed(docs, id_col, text_col)
    ranges = _lists(written(repeat_ranges(plain)), ["r_nn", "r_id", "r_v", "r"])
    same = (F.col("nn") == F.col("r_nn")) & (F.col("id") == F.col("r_id")) & (F.col("v") == F.col("r_v"))
    joined = plain.join(ranges, same, "left").select("text", "r", F.when(~F.col("nn"), F.col("id")).alias("id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words_, removed, digests = [], [], []
                for text, r in zip(as_bytes(part.column("text")), part.column("r").to_pylist()):
                    words = text.split()
                    gone = 0
                    n = len(words)
                    if r:
                        out = _covered(n, r)
                        gone = int(out.sum())
                        words = [w for w, x in zip(words, out.tolist()) if not x]
                    words_.append(n)
                    removed.append(gone)
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words_, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    out = map_texts(joined, task, "id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with the words under repeats taken out of the texts.

    A text without repeats stays as it is; any other becomes its kept words, joined by a space
    (perhaps none). Null texts stay null. Otherwise as :func:`report`.
    """
    own = _keyed(docs, id_col, text_col)
    names = fresh(docs, "sub_nn", "sub_id", "sub_v", "sub_r")
    lists = _lists(written(repeat_ranges(own)), names)
    nn, i, v, r = names
    same = (F.col(id_col).isNull() == F.col(nn)) & (F.coalesce(F.col(id_col).cast("long"), F.lit(0)) == F.col(i)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(v))
    joined = docs.join(lists, same, "left").drop(nn, i, v)
    schema = T.StructType(list(docs.schema.fields))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = as_bytes(batch.column(at))
            for k, ranges_ in enumerate(batch.column(r).to_pylist()):
                if ranges_ and texts[k]:
                    words = texts[k].split()
                    texts[k] = b" ".join([w for w, x in zip(words, _covered(len(words), ranges_).tolist()) if not x])
            columns = [pa.array(texts, pa.binary()).cast(batch.schema.field(at).type) if name == text_col else batch.column(name) for name in docs_columns]
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return map_texts(joined, task, schema)
