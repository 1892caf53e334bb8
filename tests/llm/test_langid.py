import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import langid, queries
from strandlake.llm.langid import END, ORDER, Scorer, estimate, grams
from tests.conftest import DATA


def counts(words):
    out = Counter()
    for w, n in words.items():
        for g in grams(w):
            out[g] += n
    return dict(out)


def plain(c, context, char, order):
    """Interpolated Kneser-Ney, straight from its definition."""
    levels = {ORDER: c}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    level = levels[order]
    n1, n2 = (sum(v == k for v in level.values()) for k in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
    lower = plain(c, context[1:], char, order - 1) if order > 1 else 1 / langid.ALPHABET
    total = sum(v for g, v in level.items() if g[:-1] == context)
    if not total:
        return lower
    kinds = sum(g[:-1] == context for g in level)
    return max(level.get(context + char, 0) - d, 0) / total + d * kinds / total * lower


def test_probabilities_equal_the_definition():
    c = {"x": counts({"banana": 3, "band": 1, "nab": 2}), "y": counts({"zoo": 1, "ban": 1})}
    m = estimate(c)
    for w in ("banana", "bond", "q", "", "nabban"):
        sums, n = m.log_probabilities([w])
        for k, lang in enumerate(m.languages):
            want = sum(np.log(plain(c[lang], g[:-1], g[-1], ORDER)) for g in grams(w))
            assert sums[0][k] == pytest.approx(want, rel=1e-9) and n[0] == len(w) + 1


def test_probabilities_of_a_context_sum_to_one():
    c = counts({"banana": 3, "band": 1, "nab": 2})
    chars = {ch for g in c for ch in g} | {END}
    for context in ("\x02\x02b", "ban", "xyz"):
        known = sum(plain(c, context, ch, ORDER) for ch in chars)
        unseen = plain(c, context, "Ω", ORDER) * (langid.ALPHABET - len(chars))
        assert known + unseen == pytest.approx(1, abs=1e-6)


def test_scores_do_not_depend_on_the_cache():
    m = estimate({"x": counts({"banana": 3, "band": 1}), "y": counts({"zoo": 1})})
    texts = [b"banana zoo", None, b"", b"12 !!", "ßé zoo".encode(), b"banana zoo"]
    a, b = Scorer(m), Scorer(m, most=1)
    for _ in range(2):
        for x, y in zip(a(texts), b(texts)):
            assert np.allclose(x, y)
    assert a(texts)[2].tolist() == [True, False, False, False, True, True]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(str(DATA / sf / "documents.parquet")).collect()}
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, str(DATA / sf)).collect()}
    assert set(got) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(r["lang_pred"], docs[i]["lang"]) for i, r in got.items() if r["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.98
    assert sum(r["rejected"] for r in got.values()) <= 0.05 * len(got)


def test_odd_rows(make, spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the end of the day", "en"), (None, "en"), ("les jours de la fin", "fr"), ("nobody knows", None)])], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.languages == ["en", "fr"]
    odd = make((1, "the dog"), (2, None), (3, ""), (4, "123 ..."), (5, "the " * 50_000), (None, "le chien"), (1, "the dog"))
    rows = langid.identify(odd, model, reject=False)
    assert rows.columns == [*odd.columns, "lang_pred", "score", "cross_entropy", "rejected"]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in rows.collect()) == [("1", "en"), ("1", "en"), ("2", "und"), ("3", "und"), ("4", "und"), ("5", "en"), ("None", "fr")]
    assert langid.identify(odd.limit(0), model).collect() == []
    assert langid.fit(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    replaced = langid.identify(odd.selectExpr("*", "1 AS Rejected"), model)
    assert replaced.columns == rows.columns and replaced.filter("rejected").count() == rows.filter("rejected").count()


def test_rejection(spark):
    docs = spark.read.parquet(str(DATA / "sf0.1/documents.parquet")).select("doc_id", "text", "lang")
    model = langid.fit(docs, F.lit(True))
    noise = spark.createDataFrame([(1, "qzx wvk jjq xkcd zqw vbn kjh " * 20)], "doc_id long, text string")
    assert langid.identify(noise, model).head()["lang_pred"] == "und"


def test_no_language_is_left_out(spark):
    """Many languages of few documents each: all are learnt, also where they share a small budget."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(3 * i + j, f"{letters[i % 26]}{letters[i // 26]}q{letters[i // 26]}{letters[i % 26]} " * 6, f"l{i:03}") for i in range(600) for j in range(1 + i % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (200_000, 100):
        model = langid.fit(docs, F.lit(True), most=most)
        assert len(model.languages) == 600
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model, reject=False).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.99


class Plain:
    """Interpolated Kneser-Ney in plain Python: probabilities by recursion, as its definition has them."""

    def __init__(self, counts):
        self.levels = {4: counts}
        for n in (3, 2, 1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.discount, self.sums, self.kinds = {}, {}, {}
        for n, c in self.levels.items():
            ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
            self.discount[n] = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
            self.sums[n], self.kinds[n] = Counter(), Counter()
            for g, v in c.items():
                self.sums[n][g[:-1]] += v
                self.kinds[n][g[:-1]] += 1
        self.known = {}

    def probability(self, g):
        if not g:
            return 1 / 0x110000
        if g not in self.known:
            n, lower = len(g), self.probability(g[1:])
            total = self.sums[n][g[:-1]]
            d = self.discount[n]
            self.known[g] = (max(self.levels[n][g] - d, 0) + d * self.kinds[n][g[:-1]] * lower) / total if total else lower
        return self.known[g]


def test_query_equals_plain_python(spark):
    """Learnt from the same documents: the language of least cross-entropy, and that cross-entropy."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet")).collect()}
    words = lambda text: [w.decode().lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    cut = lambda w: [("\x02\x02\x02" + w + "\x03")[i : i + 4] for i in range(len(w) + 1)]
    counts = defaultdict(Counter)
    for i, r in docs.items():
        told = xxhash.xxh64_intdigest(b"lang", xxhash.xxh64_intdigest(str(i).encode(), 42)) >> 34
        if zlib.crc32(str(i).encode()) % 4 != 2 and r["lang"] is not None and told % 5 > 0:
            for w in words(r["text"]):
                counts[r["lang"]].update(cut(w))
    models = {lang: Plain(c) for lang, c in counts.items()}
    by_word = {}
    for r in queries.op9_language_id(spark, str(DATA / "sf0.01")).collect():
        mine = words(docs[r["doc_id"]]["text"])
        if not any(map(str.isalpha, "".join(mine))):
            assert r["lang_pred"] == "und"
            continue
        for w in mine:
            if w not in by_word:
                by_word[w] = {lang: sum(math.log(m.probability(g)) for g in cut(w)) for lang, m in models.items()}
        length = sum(len(w) + 1 for w in mine)
        entropy = {lang: -sum(by_word[w][lang] for w in mine) / length for lang in models}
        best = min(entropy.values())
        assert r["cross_entropy"] == pytest.approx(best, rel=1e-4) and entropy[r["lang_pred"]] == pytest.approx(best, rel=1e-5)
