import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from strandlake.llm import quality, queries
from strandlake.llm.quality import BITS, Ftrl, Words, dots, features, train
from tests.conftest import DATA


def test_features_do_not_depend_on_company():
    texts = [b"Good words here", b"", None, b"a a a B!! 12", b"Good words here"]
    weights = np.random.default_rng(0).standard_normal(1 << BITS).astype(np.float32)
    together = dots(weights, *features(Words(), texts))
    alone = [dots(weights, *features(Words(most=1), [t]))[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-5) and together[1] == together[2] == 0 and together[0] == together[4]


def test_ftrl_equals_plain_loops():
    texts, labels, s = [b"x y z", b"BUY!! NOW!!", b"x z", b"", b"NOW!! y"], np.array([1.0, 0, 1, 1, 0]), Ftrl(epochs=3)
    idx, first, n = features(Words(), texts)
    z, q = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(j):
        return 0.0 if abs(z[j]) <= s.l1 else (np.sign(z[j]) * s.l1 - z[j]) / ((s.beta + q[j] ** 0.5) / s.alpha + s.l2)

    for _ in range(3):
        for a, k, y in zip(first, n, labels):
            x = {}
            for j in idx[:, a : a + k].ravel():
                x[j] = x.get(j, 0) + 1 / k
            x[1 << BITS] = 1.0
            p = 1 / (1 + np.exp(-sum(weight(j) * v for j, v in x.items())))
            for j, v in [*x.items()]:
                g, w = (p - y) * v, weight(j)
                z[j] += g - ((q[j] + g * g) ** 0.5 - q[j] ** 0.5) / s.alpha * w
                q[j] += g * g
    w, b = train(texts, labels, s)
    assert w == pytest.approx(np.array([weight(j) for j in range(1 << BITS)]), abs=1e-5) and b == pytest.approx(weight(1 << BITS), abs=1e-6)


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.97), ("sf0.1", 0.99)])
def test_held_out_accuracy(spark, sf, least):
    out = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, str(DATA / sf)).collect()}
    docs = spark.read.parquet(str(DATA / sf / "documents.parquet")).select("doc_id").collect()
    assert sorted(out) == sorted(r[0] for r in docs)
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    known = [(out[r["doc_id"]], r["quality"]) for r in spark.read.parquet(str(DATA / sf / "labels.parquet")).collect()]
    held = [(r["predicted"], y) for r, y in known if r["held_out"]]
    assert np.mean([p == y for p, y in held]) >= least
    assert sum(p == 0 and y == 1 for p, y in held) <= 0.01 * len(held)


def test_odd_rows(make, spark):
    docs = make((1, "fine words and more of them"), (2, None), (3, ""), (1, "fine words and more of them"), (None, "x"), (4, "SPAM!! " * 20000))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1), (4, 0), (9, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model, score_col="the_score")
    assert out.columns == [*docs.columns, "the_score"] and out.count() == 6
    by = {r["doc_id"]: r["the_score"] for r in out.collect()}
    assert by[1] > by[4] and by[2] == by[3]
    assert quality.keep(docs, model).columns == docs.columns
    empty = quality.fit(docs, labels.limit(0))
    assert {r["the_score"] for r in quality.score(docs, empty, score_col="the_score").collect()} == {0.5}
    assert quality.score(docs.limit(0), model, score_col="s2").collect() == []
    again = quality.score(out, model, score_col="The_Score")
    assert again.columns == [*docs.columns, "The_Score"] and {r["The_Score"] for r in again.collect()} == set(by.values())
    with pytest.raises(ValueError):
        quality.score(docs, model, score_col="TEXT")


class Plain:
    """The classifier in plain Python: one feature, one row, one number after the other."""

    M, ALL = 0x9E3779B1, 2**32 - 1

    @staticmethod
    def shape(word):
        kinds = ["A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 or c >= 128 else "0" if 48 <= c <= 57 else chr(c) for c in word]
        return "".join(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1])[:12].encode("latin-1")

    def features(self, text):
        """Feature numbers of a text, repeats included, and its number of words."""
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        out, u1, s1, s2, before = [], 0, 0, 0, None
        for w in words:
            u, s = xxhash.xxh32_intdigest(w), 1 if w == before else xxhash.xxh32_intdigest(self.shape(w))
            two = (u * 0x85EBCA6B + 1 & self.ALL) ^ (u1 * self.M & self.ALL)
            shapes = (s * 0xC2B2AE35 + 3 & self.ALL) ^ (s1 * self.M & self.ALL)
            three = (shapes ^ (s2 * 0x27D4EB2F & self.ALL)) + 7 & self.ALL
            out += [((x ^ x >> 15) * self.M & self.ALL) >> 14 for x in (u, two, s ^ 0x5BD1E995, shapes, three)]
            u1, s2, s1, before = u, s1, s, w
        return out, len(words)

    def learn(self, rows, alpha=1.0, beta=1.0, l1=0.0005, l2=0.01):
        z, n = defaultdict(float), defaultdict(float)

        def weight(f):
            return 0.0 if abs(z[f]) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

        made = []
        for text, y in rows:
            fs, k = self.features(text)
            made.append(([(f, c / k) for f, c in sorted(Counter(fs).items())] + [("bias", 1.0)], y))
        for _ in range(3):
            for xs, y in made:
                w = {f: weight(f) for f, _ in xs}
                p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[f] * x for f, x in xs)))))
                for f, x in xs:
                    g = (p - y) * x
                    z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                    n[f] += g * g
        self.weights = {f: weight(f) for f in z}
        return self

    def score(self, text):
        fs, k = self.features(text)
        z = self.weights.get("bias", 0.0) + (sum(self.weights.get(f, 0.0) for f in fs) / k if k else 0.0)
        return 1 / (1 + math.exp(-z))


def test_query_equals_plain_python(spark):
    """Learnt from the same rows in the same order, scores agree; weights are kept as 32-bit numbers."""
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(DATA / "sf0.01" / "documents.parquet").to_pylist()}
    labels = {}
    for r in pq.read_table(DATA / "sf0.01" / "labels.parquet").to_pylist():
        if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            labels[r["doc_id"]] = max(r["quality"], labels.get(r["doc_id"], 0))
    assert 50 < len(labels) < 1500  # one shard, all rows
    order = lambda i: (xxhash.xxh64_intdigest(b"fit", xxhash.xxh64_intdigest(str(i).encode(), 42)) >> 34, docs[i].encode())
    model = Plain().learn([(docs[i], labels[i]) for i in sorted((i for i in labels if docs.get(i) is not None), key=order)])
    got = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, str(DATA / "sf0.01")).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        assert got[i]["score"] == pytest.approx(model.score(text), abs=2e-5)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
