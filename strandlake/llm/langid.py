"""Language ID with an interpolated Kneser-Ney character model for each language.

A text is modelled word by word: each word, lowered, between marks of its start and end. The models
of all languages lie together in sorted arrays of n-gram hashes, one for each order, with a row of
log probabilities (one a language) for each n-gram and a row of back-off weights for each context.
The language with the lowest cross-entropy a character wins. A text whose cross-entropy lies above
what texts of that language reach is marked as rejected; the bound is calibrated on documents that
the counts don't hold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, map_texts, slices, without, written

ORDER = 4
START, END = "\x02", "\x03"
UNKNOWN = "und"
#: Code points that an unseen character is spread over.
ALPHABET = 0x110000
_P = np.uint64(0x9E3779B97F4A7C15)


def grams(word: str, order: int = ORDER) -> list[str]:
    """The n-grams of the highest order of a word, one for each of its characters and one for its end."""
    s = START * (order - 1) + word.lower() + END
    return [s[i : i + order] for i in range(len(s) - order + 1)]


def hashed(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each position (the first order - 1 are of no use)."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), order, np.uint64)
        for back in range(order - 1, -1, -1):
            x = np.zeros(len(codes), np.uint64)
            x[back:] = codes[: len(codes) - back]
            h = h * _P + x + np.uint64(1)
            h ^= h >> np.uint64(31)
        return h


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@dataclass
class Model:
    """Languages, and for each order the sorted hashes with their rows."""

    languages: list[str]
    order: int = ORDER
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    floor: np.ndarray | None = None  # log probability of a character that was never seen, after all back-offs
    temperature: float = 1.0
    bounds: np.ndarray | None = None  # largest accepted cross-entropy by language

    def log_probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities of each word in each language, and the characters they are sums over."""
        k = self.order
        padded = [START * (k - 1) + w.lower() + END for w in words]
        lengths = np.array([len(s) for s in padded], np.int64)
        codes = _codes("".join(padded))
        ends = np.cumsum(lengths)
        scored = np.ones(len(codes), bool)
        for j in range(k - 1):
            scored[ends - lengths + j] = False
        at = np.flatnonzero(scored)
        total = np.zeros((len(at), len(self.languages)))
        open_ = np.ones_like(total, bool)
        rows = np.arange(len(at))
        for order in range(k, 0, -1):
            hashes, values = self.grams[order]
            h = hashed(codes, order)[at[rows]]
            found, hit = _find(hashes, h)
            value = values[found]
            seen = hit[:, None] & ~np.isnan(value) & open_[rows]
            total[rows] += np.where(seen, value, 0.0)
            open_[rows] &= ~seen
            rows = rows[open_[rows].any(axis=1)]
            if not len(rows):
                break
            if order > 1:
                hashes, values = self.contexts[order]
                found, hit = _find(hashes, hashed(codes, order - 1)[at[rows] - 1])
                total[rows] += np.where(hit[:, None] & open_[rows], values[found], 0.0)
        total[rows] += np.where(open_[rows], self.floor, 0.0)
        firsts = np.concatenate([[0], np.cumsum(lengths - (k - 1))])
        sums = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(total, axis=0)])
        return sums[firsts[1:]] - sums[firsts[:-1]], np.diff(firsts)


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def estimate(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Models from the counts of n-grams of the highest order, by language."""
    languages = sorted(counts)
    model = Model(languages, order)
    tables: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
    backs: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
    model.floor = np.zeros(len(languages))
    for li, lang in enumerate(languages):
        level = {order: counts[lang]}
        for n in range(order - 1, 0, -1):  # below, an n-gram counts by how many characters precede it
            level[n] = Counter(g[1:] for g in level[n + 1])
        probability: dict[str, float] = {}
        for n in range(1, order + 1):
            c = level[n]
            of_counts = Counter(c.values())
            n1, n2 = of_counts.get(1, 0), of_counts.get(2, 0)
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = min(max(d, 0.1), 0.9)
            sums, kinds = Counter(), Counter()
            for g, v in c.items():
                sums[g[:-1]] += v
                kinds[g[:-1]] += 1
            new = {}
            for g, v in c.items():
                context = g[:-1]
                lower = probability.get(g[1:], 0.0) if n > 1 else 1 / ALPHABET
                new[g] = max(v - d, 0) / sums[context] + d * kinds[context] / sums[context] * lower
            for g, p in new.items():
                tables[n].setdefault(g, np.full(len(languages), np.nan))[li] = np.log(p)
            for context, total in sums.items():
                weight = np.log(d * kinds[context] / total)
                if n > 1:
                    backs[n].setdefault(context, np.zeros(len(languages)))[li] = weight
                else:
                    model.floor[li] = weight - np.log(ALPHABET)
            probability = new
    for n in range(1, order + 1):
        for source, target, width in ((tables, model.grams, n), (backs, model.contexts, n - 1)):
            if width and source[n]:
                keys = list(source[n])
                h = hashed(_codes("".join(keys)), width)[width - 1 :: width]
                by = np.argsort(h)
                target[n] = (h[by], np.stack([source[n][k] for k in keys])[by])
    return model


class Scorer:
    """Scores of whole texts. The first ``most`` different words are remembered."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most, self.known = model, most, {}
        self.table = np.zeros((0, len(model.languages) + 2), np.float32)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy (nats a character) in each language; characters; whether there is a letter."""
        split = [t.split() if t else [] for t in texts]
        flat = [w for words in split for w in words]
        numbers = list(map(self.known.get, flat))
        table = self.table
        if None in numbers:
            new: dict[bytes, int] = {}
            numbers = [new.setdefault(w, len(table) + len(new)) if x is None else x for x, w in zip(numbers, flat)]
            words = [w.decode("utf-8", "replace") for w in new]
            sums, lengths = self.model.log_probabilities(words)
            letters = [any(map(str.isalpha, w)) for w in words]
            table = np.concatenate([table, np.column_stack([sums, lengths, letters]).astype(np.float32)])
            if len(self.known) < self.most:
                self.known.update(new)
                self.table = table
        n = np.array([len(x) for x in split], np.int64)
        rows = table[np.array(numbers, np.int64)] if numbers else np.zeros((0, table.shape[1]), np.float32)
        sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
        ends = np.cumsum(n)
        total = sums[ends] - sums[ends - n]
        return -total[:, :-2] / np.maximum(total[:, -2:-1], 1), total[:, -2], total[:, -1] > 0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Documents that a language gives at least, if it has them.
FEW = 20


def fit(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 1_000, bound: float = 0.999, most: int = 200_000) -> Model | None:
    """Models of the languages of the rows that ``where`` admits; None if there are none.

    About ``rows`` documents of each language are taken, by a hash of their id (a language with fewer: all). If
    there are so many languages that these were over ``most`` documents, each gives an equal part of ``most``, but 20 documents
    at least, so every language is learnt. Four fifths are counted; the rest calibrate the temperature of the scores and the bound of
    rejection, the ``bound`` quantile of their cross-entropies. A language that gives under 20 documents is counted whole, and never rejected.
    Rows with a null text or language teach nothing.
    """
    known = docs.filter(F.coalesce(where, F.lit(False))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("n")))
    languages = sizes.count()
    if not languages:
        return None
    each = min(rows, max(FEW, most // languages))
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text")), F.lit("lang")), 34)
    sample = known.withColumn("h", h).join(sizes.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l")).drop("l")
    sample = sample.filter(F.col("h") < F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")) * F.lit(float(1 << 30)))
    counts_too = F.least("n", F.lit(each)) < FEW

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
                words[lang].update(text.split())
        out: dict[tuple[str, str], int] = Counter()
        for lang, c in words.items():
            for w, n in c.items():
                for g in grams(w.decode("utf-8", "replace")):
                    out[lang, g] += n
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in out], pa.string()), "gram": pa.array([k[1] for k in out], pa.string()), "n": pa.array(list(out.values()), pa.int64())})

    counted = map_texts(sample.filter((F.col("h") % 5 > 0) | counts_too).select("text", "lang"), count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in zip(counted["lang"], counted["gram"], counted["n"]):
        counts[lang][gram] = n
    if not counts:
        return None
    model = estimate(counts)
    _calibrate(model, sample.filter((F.col("h") % 5 == 0) & ~counts_too).select("text", "lang"), bound)
    return model


def _calibrate(model: Model, held: DataFrame, bound: float) -> None:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                ce, _, _ = scorer(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(list(ce), pa.list_(pa.float64()))], ["lang", "ce"])

    got = [r for r in map_texts(held, task, "lang string, ce array<double>").collect() if r["lang"] in model.languages]
    model.bounds = np.full(len(model.languages), np.inf)
    if not got:
        return
    ce = np.array([r["ce"] for r in got])
    y = np.array([model.languages.index(r["lang"]) for r in got])
    likely = {t: np.log(np.maximum(_softmax(-t * ce)[np.arange(len(y)), y], 1e-12)).mean() for t in (1.0, 2.0, 4.0, 8.0, 16.0)}
    model.temperature = max(likely, key=likely.get)
    for i in set(y.tolist()):
        model.bounds[i] = np.quantile(ce[y == i, i], bound)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", reject: bool = True) -> DataFrame:
    """``docs``, all columns kept, with lang_pred, score, cross_entropy and rejected, in place of columns so named.

    ``score``: probability of the winner, 0 to 1. A null text and one without a letter are ``und``
    with score 0 and no cross-entropy, as is every text if there is no model. Texts above the
    winner's calibrated bound are rejected; they become ``und`` only if ``reject``. Ties go to the
    language that comes first by code point. Each row is judged by its whole text alone.
    """
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType())]
    docs = without(docs, *[n for n, _ in added])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m) if m else None
        for batch in batches:
            for part in slices(batch, text_col):
                n = part.num_rows
                if scorer:
                    ce, _, letter = scorer(as_bytes(part.column(text_col)))
                    best = ce.argmin(axis=1)
                    low = ce[np.arange(n), best]
                    p = _softmax(-m.temperature * ce)[np.arange(n), best]
                    out = letter & (low > m.bounds[best])
                    lang = [m.languages[b] if ok and not (reject and bad) else UNKNOWN for b, ok, bad in zip(best, letter, out)]
                    columns = [pa.array(lang, pa.string()), pa.array(np.where(letter, p, 0.0)), pa.array(low, mask=~letter), pa.array(out)]
                else:
                    columns = [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, bool))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *[a for a, _ in added]])

    return map_texts(docs, task, schema)
