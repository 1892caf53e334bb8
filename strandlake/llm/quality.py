"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal.

Features of a text, all hashed into one table: its words, pairs of words, and n-grams (n = 1, 2, 3)
of word shapes, where a word's shape keeps the classes of its characters and a word equal to the
one before it has the shape "again". A feature's value is its count over the number of words, so
a score is a bias plus sparse dot products, the same for short and long texts.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, fresh, map_texts, slices, without

BITS = 18
TEMPLATES = 5
_M = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner, and how many labelled rows it takes at most."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.01
    epochs: int = 3
    rows: int = 4_000
    shard_rows: int = 1_000


def shape(word: bytes) -> bytes:
    """Classes of a word's characters, runs of one class as one: A upper, a lower, 0 digit, u beyond ASCII."""
    s = re.sub(rb"[A-Z]+", b"A", word)
    s = re.sub(rb"[a-z]+", b"a", s)
    s = re.sub(rb"[0-9]+", b"0", s)
    s = re.sub(rb"[\x80-\xff]+", b"a", s)
    return re.sub(rb"(.)\1+", rb"\1", s)[:12]


class Words:
    """Numbers of words, with the hash and the shape hash of each. The first ``most`` are remembered; 0 is no word."""

    def __init__(self, most: int = 150_000):
        self.most, self.known = most, {}
        self.word, self.shape = np.zeros(1, np.uint32), np.zeros(1, np.uint32)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words, two zeros after each text; hashes by number, shape hashes by number; words in each text."""
        split = [t.split() if t else [] for t in texts]
        numbers: list[int | None] = []
        for words in split:
            numbers += map(self.known.get, words)
            numbers += (0, 0)
        word, shp = self.word, self.shape
        if None in numbers:
            new: dict[bytes, int] = {}
            at = len(word)
            flat = iter([w for words in split for w in (*words, b"", b"")])
            numbers = [new.setdefault(w, at + len(new)) if x is None else x for x, w in zip(numbers, flat)]
            word = np.concatenate([word, np.array([xxhash.xxh32_intdigest(w) for w in new], np.uint32)])
            shp = np.concatenate([shp, np.array([xxhash.xxh32_intdigest(shape(w)) for w in new], np.uint32)])
            if len(self.known) < self.most:
                self.known.update(new)
                self.word, self.shape = word, shp
        return np.array(numbers, np.int64), word, shp, np.array([len(x) for x in split], np.int64)


def features(words: Words, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, ``TEMPLATES`` rows of one column a word; each text's first column and length.

    Two columns after each text belong to no word.
    """
    numbers, word, shp, n = words(texts)
    u, s = word[numbers], shp[numbers]
    s[1:][(numbers[1:] == numbers[:-1]) & (numbers[1:] > 0)] = 1  # the word before, again
    out = np.empty((TEMPLATES, len(u)), np.int32)

    def put(row: int, x: np.ndarray) -> None:
        x = (x ^ x >> np.uint32(15)) * _M
        out[row] = x >> np.uint32(32 - BITS)

    with np.errstate(over="ignore"):
        put(0, u)
        pair = u * np.uint32(0x85EBCA6B) + np.uint32(1)
        pair[1:] ^= u[:-1] * _M
        put(1, pair)
        put(2, s ^ np.uint32(0x5BD1E995))
        pair = s * np.uint32(0xC2B2AE35) + np.uint32(3)
        pair[1:] ^= s[:-1] * _M
        put(3, pair)
        pair[2:] ^= s[:-2] * np.uint32(0x27D4EB2F)
        put(4, pair + np.uint32(7))
    return out, np.concatenate([[0], np.cumsum(n + 2)])[:-1], n


def train(texts: list[bytes | None], labels: np.ndarray, settings: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over the rows in the order given."""
    idx, first, n = features(Words(), texts)
    rows = []
    for a, k in zip(first, n):
        if k:
            u, c = np.unique(idx[:, a : a + k], return_counts=True)
            rows.append((u, c / k))
        else:
            rows.append((np.zeros(0, np.int64), np.zeros(0)))
    size = 1 << BITS
    z, q, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(settings.epochs):
        for (u, x), y in zip(rows, labels):
            u, x = np.append(u, size), np.append(x, 1.0)
            zu, qu = z[u], q[u]
            wu = np.where(np.abs(zu) <= settings.l1, 0.0, (np.sign(zu) * settings.l1 - zu) / ((settings.beta + np.sqrt(qu)) / settings.alpha + settings.l2))
            p = 1 / (1 + np.exp(-np.clip(wu @ x, -35, 35)))
            g = (p - y) * x
            z[u] += g - (np.sqrt(qu + g * g) - np.sqrt(qu)) / settings.alpha * wu
            q[u] += g * g
    w = np.where(np.abs(z) <= settings.l1, 0.0, (np.sign(z) * settings.l1 - z) / ((settings.beta + np.sqrt(q)) / settings.alpha + settings.l2))
    return w[:size].astype(np.float32), float(w[size])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None, settings: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """A model from the labelled rows: (weights, bias).

    At most about ``settings.rows`` labelled rows are taken, chosen by a hash of their id; they are
    dealt to shards of about ``settings.shard_rows``, each learns by itself, and the models are averaged. Ids
    with several labels count by their largest, null labels and texts don't count. With no rows
    at all the model is all zero. The model's size is fixed by ``BITS``.
    """
    known = labels if where is None else labels.filter(where)
    known = known.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("y")).dropna()
    known = known.groupBy("lid").agg(F.max("y").alias("y"))
    total = known.count()
    shards = max(1, round(min(total, settings.rows) / settings.shard_rows))
    h = F.shiftrightunsigned(F.xxhash64(F.col("lid").cast("string"), F.lit("fit")), 34)
    share = min(1.0, settings.rows / max(total, 1))
    sample = known.filter(h < F.lit(round(share * 2**30))).withColumn("h", h)
    text = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).dropna()
    rows = text.join(F.broadcast(sample), "lid").withColumn("shard", (F.col("h") % shards).cast("int")).select("shard", "h", "text", "y")

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("text", "ascending")])
        w, b = train(as_bytes(table.column("text")), table.column("y").to_numpy(), settings)
        return pa.table({"n": [len(table)], "w": [pickle.dumps((np.flatnonzero(w).astype(np.int32), w[w != 0]))], "b": [b]})

    got = sorted(rows.groupBy("shard").applyInArrow(task, "n long, w binary, b double").collect(), key=lambda r: (r["n"], r["b"]))
    weights, bias, n = np.zeros(1 << BITS), 0.0, sum(r["n"] for r in got)
    for r in got:
        at, w = pickle.loads(r["w"])
        weights[at] += w * (r["n"] / n)
        bias += r["b"] * r["n"] / n
    return weights.astype(np.float32), bias


def dots(weights: np.ndarray, idx: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Dot product of each text's features (counts over its number of words) with the weights."""
    per_word = weights[idx[0]]
    for row in idx[1:]:
        per_word += weights[row]
    sums = np.concatenate([[0.0], np.cumsum(per_word, dtype=np.float64)])
    return (sums[first + n] - sums[first]) / np.maximum(n, 1)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs``, all columns kept, with the probability of label 1 in ``score_col``, in place of a column so named.

    A null text scores as an empty one: by the bias alone. Texts are scored whole, on their own,
    wherever they lie, so repeated rows score alike and nothing is shuffled.
    """
    if score_col.lower() == text_col.lower():
        raise ValueError("the score can't take the place of the text")
    docs = without(docs, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), words = shared.value, Words()
        for batch in batches:
            for part in slices(batch, text_col):
                idx, first, n = features(words, as_bytes(part.column(text_col)))
                z = bias + dots(weights, idx, first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-z)))], [*part.schema.names, score_col])

    return map_texts(docs, task, schema)


def keep(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score is at least ``threshold``, with the columns of ``docs``."""
    (name,) = fresh(docs, "quality_score")
    return score(docs, model, text_col, name).filter(F.col(name) >= threshold).drop(name)
