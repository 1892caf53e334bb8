"""Language-model scoring by cross-entropy difference.

Two word bigram models, one of a target corpus and one of all documents (the background), are matched:
same order, same smoothing, one vocabulary. A document's score is the mean over its words of log p(target) -
log p(background): above 0 it is more like the target. Both models leave out the document that is scored, so
a target document isn't judged by itself, and a text that occurs nowhere else isn't known to the background.

Words, contexts and pairs are counted over all documents by 56-bit hash (of 10**9 different ones about 7 pairs collide). The texts are written in blocks of
bounded size; a block sends its different hashes with their counts to buckets of hash ranges, whose
number follows the amount of text, and each bucket answers every block with the totals. Nothing is
gathered in one place. Hashes and counts travel packed, many in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, checkpointed, fresh, map_texts, near, slices, without, written

#: Weight of the pair model where the word before is known.
PAIR = 0.6
#: Bytes of text in a block of documents, and for each bucket of the counts; rows of a block.
BLOCK, BUCKET, ROWS = 4_000_000, 8_000_000, 100_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(42).integers(1 << 64, size=256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: What a hash counts, in its lowest byte; 56 bits are hash, a byte less to send.
WORD_, PAIR_, START_ = (np.uint64(i) for i in range(3))
_KIND = np.uint64(255)
_START = np.uint64(0x27D4EB2F16566700) | START_


def _mix(x: np.ndarray, kind: np.uint64) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)) & ~_KIND | kind


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the word before it (or the start of a text), of their pair; words of each text.

    Words are what ``bytes.split()`` finds. A word's hash is the sum of its bytes' random numbers times
    powers of a base, taken from running sums, then mixed.
    """
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    raw = np.frombuffer(b" ".join([b"", *[t or b"" for t in texts], b""]), np.uint8)
    edge = np.diff(_SPACE[raw].view(np.int8))
    first, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    sums = np.full(len(raw), _BASE, np.uint64)
    sums[0] = 1
    np.cumprod(sums, out=sums)
    sums *= _BYTE[raw]
    np.cumsum(sums, out=sums)
    word = sums[end - 1] - sums[first - 1]
    sums = np.full(len(raw), _INVERSE, np.uint64)
    sums[0] = 1
    word = _mix(word * np.cumprod(sums)[first], WORD_)
    starts = np.cumsum(lengths + 1) - lengths
    text = np.searchsorted(starts, first, side="right") - 1
    n = np.bincount(text, minlength=len(texts)).astype(np.int64)
    before = np.concatenate([[_START], word[:-1]])[: len(word)]
    before[np.diff(text, prepend=-1) != 0] = _START
    return word, before, _mix(_mix(before + np.uint64(1), WORD_) + word, PAIR_), n


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash: ranges of equal width, so sorted hashes lie in the order of their buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Length, and the bytes by place, compressed, of small numbers or of the steps between ``rising`` ones."""
    x = x.astype(np.uint64)
    planes = np.ascontiguousarray((np.diff(x, prepend=np.uint64(0)) if rising else x).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpack(data: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(x) if rising else x


def _totals(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The different hashes, ascending, and the sums of their counts."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return [keys[at], *[np.add.reduceat(c[by], at) if len(at) else c for c in counts]]


#: Counts of a hash: occurrences in the target and in all rows, those of them at the end of a text.
COUNTS = ("t", "b", "ends_t", "ends_b")
ADDED = [("n_words", T.LongType()), ("target_loss", T.DoubleType()), ("background_loss", T.DoubleType()), ("lm_score", T.DoubleType())]


def _own(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each token's key (a small number) occurs in its text."""
    _, at, times = np.unique(text * (int(key.max(initial=0)) + 1) + key, return_inverse=True, return_counts=True)
    return times[at]


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns kept, with n_words, target_loss, background_loss (nats a word) and lm_score, their difference.

    The background model counts all rows, the target model those whose id is in ``targets`` (column ``id_col``, nulls
    and repeats don't matter); for each row both leave out its own text, once. The loss of a word w after v is -log of
    PAIR * c(v, w) / c(v) + (1 - PAIR) * (c(w) + 1) / (N + V + 1), without the first term and its weight where
    c(v) = 0. N: words of the model; V: different words of all rows, for both models. v is the start of the text for its first
    word, and c(v) how often it is followed by a word.
    A text without words (null, empty, blank) has no losses (null) and the score 0. Repeated rows count each, and score
    alike. Columns of ``docs`` with these names are replaced. An empty table gives no rows.
    """
    docs = without(docs, *[n for n, _ in ADDED])
    place = docs.columns.index(text_col)
    (mark,) = fresh(docs, "lm_target")
    ids = near(checkpointed(targets.select(F.col(id_col).alias("lm_tid")).dropna().distinct()))
    marked = docs.join(ids, F.col(id_col) == F.col("lm_tid"), "left").select(*[docs[c] for c in docs.columns], F.col("lm_tid").isNotNull().alias(mark))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rows = 0
        number = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            sink, words = pa.BufferOutputStream(), np.zeros(2, np.int64)
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in held:
                    out.write_batch(x)
                    n = np.array([len(t.split()) if t else 0 for t in as_bytes(x.column(place))], np.int64)
                    words += n[x.column(mark).to_numpy(zero_copy_only=False)].sum(), n.sum()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), *[pa.array([int(w)]) for w in (*words, size)]], ["block", "data", "words_t", "words_b", "bytes"])

        for batch in batches:
            for part in slices(batch, text_col):
                held.append(part)
                size, rows = size + part.column(place).nbytes, rows + len(part)
                if size >= BLOCK or rows >= ROWS:
                    yield flush()
                    held, size, rows, number = [], 0, 0, number + 1
        if held:
            yield flush()

    # Written, so that what the blocks ask and what is finished with the answers are the same rows.
    blocks = written(map_texts(marked, block, "block long, data binary, words_t long, words_b long, bytes long"))
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words_t", "words_b", "bytes")]).first()
    total, buckets = (sums[0], sums[1]), 1 + sums[2] // BUCKET

    def hashes(data: bytes) -> tuple[pa.Table, list[np.ndarray]]:
        """A block's rows, and :func:`ngrams` of its texts."""
        table = pa.ipc.open_stream(data).read_all()
        parts = [ngrams(as_bytes(x.column(place))) for batch in table.to_batches() for x in slices(batch, text_col)]
        return table, [np.concatenate(x) for x in zip(*parts)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                table, (word, _, pair, n) = hashes(data)
                target = table.column(mark).to_numpy().astype(np.int64)
                chosen, full = np.repeat(target, n), target[n > 0]
                last = np.zeros(len(word), np.int64)
                last[np.cumsum(n)[n > 0] - 1] = 1
                # The start of a text is counted like a word.
                keys = np.concatenate([word, pair, np.full(len(full), _START)])
                t, b = np.concatenate([chosen, chosen, full]), np.ones(len(keys), np.int64)
                ends_t, ends_b = (np.concatenate([x, np.zeros(len(keys) - len(x), np.int64)]) for x in (last * chosen, last))
                keys, *counts = _totals(keys, t, b, ends_t, ends_b)
                ends = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                parts = [(k, slice(*ends[k : k + 2])) for k in range(buckets) if ends[k] < ends[k + 1]]
                packed = [pa.array([_pack(x[s], x is keys) for _, s in parts], pa.binary()) for x in (keys, *counts)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()), *packed], ["bucket", "block", "keys", *COUNTS])

    def answer(parts: pa.Table) -> pa.Table:
        asked = [_unpack(x, True) for x in parts.column("keys").to_pylist()]
        known, *counts = _totals(np.concatenate(asked), *[np.concatenate([_unpack(x) for x in parts.column(c).to_pylist()]) for c in COUNTS])
        at = [np.searchsorted(known, keys) for keys in asked]
        different = int((known & _KIND == WORD_).sum())
        kinds = pa.array([different, *[0] * (len(asked) - 1)], pa.int64())
        return pa.Table.from_arrays([parts.column("block"), parts.column("bucket"), kinds, *[pa.array([_pack(c[i]) for i in at], pa.binary()) for c in counts]], names=["block", "bucket", "kinds", *COUNTS])

    binaries = ", ".join(f"{c} binary" for c in COUNTS)
    answers = written(blocks.select("block", "data").mapInArrow(count, f"bucket long, block long, keys binary, {binaries}").groupBy("bucket").applyInArrow(answer, f"block long, bucket long, kinds long, {binaries}"))
    vocabulary = answers.agg(F.sum("kinds")).first()[0] or 0

    def finish(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        table, (word, before, pair, n) = hashes(blocks.column("data")[0].as_py())
        mine = table.column(mark).to_numpy().astype(np.int64)
        text, none = np.repeat(np.arange(len(n)), n), n == 0
        at = np.unique(np.concatenate([word, before, pair]), return_inverse=True)[1].reshape(3, -1)
        own_word, own_before, own_pair = (_own(text, x) for x in at)
        answers, loss = answers.sort_by("bucket"), []
        counts = {c: np.concatenate([np.zeros(0, np.uint64), *[_unpack(x) for x in answers.column(c).to_pylist()]]).astype(np.float64) for c in COUNTS}
        for side, c in enumerate(("t", "b")):
            less = np.ones(len(n)) if side else mine.astype(np.float64)  # a row's own text is left out
            own = less[text]
            words, begun, pairs = counts[c][at]
            context = begun - counts[f"ends_{c}"][at[1]] - own * own_before
            words, pairs = words - own * own_word, pairs - own * own_pair
            single = (words + 1) / (total[side] - own * n[text] + vocabulary + 1)
            logs = np.log(np.where(context > 0, PAIR * pairs / np.maximum(context, 1) + (1 - PAIR) * single, single))
            loss.append(-np.bincount(text, logs, len(n)) / np.maximum(n, 1))
        columns = [pa.array(n), pa.array(loss[0], mask=none), pa.array(loss[1], mask=none), pa.array(np.where(none, 0.0, loss[1] - loss[0]))]
        table = table.drop_columns([mark])
        return pa.Table.from_arrays([*table.columns, *columns], names=[*table.column_names, *[a for a, _ in ADDED]])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(a, t) for a, t in ADDED]])
    return blocks.select("block", "data").groupBy("block").cogroup(answers.select("block", "bucket", *COUNTS).groupBy("block")).applyInArrow(finish, schema)
