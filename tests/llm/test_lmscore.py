import math
import random
from collections import Counter

import pytest

from strandlake.llm import lmscore, queries
from strandlake.llm.lmscore import PAIR, score
from tests.conftest import DATA


def counted(texts):
    word, context, pair = Counter(), Counter(), Counter()
    for w in texts:
        word.update(w)
        context.update([None, *w][: len(w)])
        pair.update(zip([None, *w], w))
    return word, context, pair


def brute(rows, targets):
    """Losses by plain counting, without hashing; each row's own text is left out of both models."""
    split = [(i, (t or "").split()) for i, t in rows]
    kinds = len({x for _, w in split for x in w})
    models = [(counted(w for i, w in split if i in targets), lambda i: i in targets), (counted(w for _, w in split), lambda i: True)]
    out = []
    for i, w in split:
        loss, (mine, mine_before, mine_pair) = [], counted([w])
        for (word, context, pair), counts_me in models:
            k = int(counts_me(i))
            total = word.total() - k * len(w)
            s = 0.0
            for v, x in zip([None, *w], w):
                single = (word[x] - k * mine[x] + 1) / (total + kinds + 1)
                c = context[v] - k * mine_before[v]
                s -= math.log(PAIR * (pair[v, x] - k * mine_pair[v, x]) / c + (1 - PAIR) * single if c else single)
            loss.append(s / max(len(w), 1))
        out.append((i, len(w), *(loss if w else (None, None)), loss[1] - loss[0] if w else 0.0))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "target_loss", "background_loss", "lm_score").collect()), key=repr)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a[2:], b[2:]))


def key(r):
    return repr(r[:2]), round(r[4], 6)


@pytest.mark.parametrize("block,bucket", [(8_000_000, 16_000_000), (40, 30)])
def test_scores_equal_plain_counting(make, spark, monkeypatch, block, bucket):
    monkeypatch.setattr(lmscore, "BLOCK", block)
    monkeypatch.setattr(lmscore, "BUCKET", bucket)
    rows = [(1, "the cat sat on the mat"), (2, "buy now buy cheap"), (3, None), (4, ""), (1, "the cat sat on the mat"), (None, "the dog"), (5, "word " * (30_000 if block > 40 else 9)), (6, "cheap"), (7, "cheap mat the")]
    docs = make(*rows).selectExpr("*", "1 AS lm_score", "2 AS N_words", "3 AS lm_target")
    targets = spark.createDataFrame([(1,), (1,), (None,), (9,), (7,)], "doc_id long")
    out = score(docs, targets)
    assert out.columns == [*[c for c in docs.columns if c not in ("lm_score", "N_words")], "n_words", "target_loss", "background_loss", "lm_score"]
    same(out, brute(rows, {1, 7}))


def test_empty_tables(make, spark):
    docs, targets = make((1, "the cat"), (2, "the cat")), spark.createDataFrame([], "doc_id long")
    same(score(docs, targets), brute([(1, "the cat"), (2, "the cat")], set()))
    assert score(docs.limit(0), targets).collect() == []


def test_query_equals_plain_counting(spark):
    sf = str(DATA / "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    rows = [(i, (t or "").encode()) for i, t in rows]
    rows = [(i, " ".join(w.decode("latin-1") for w in t.split())) for i, t in rows]  # the same words, cut at ASCII white space
    want = brute([(i, t.replace("\x85", "\u0101").replace("\xa0", "\u0102").replace("\x1c", "\u0103").replace("\x1d", "\u0104").replace("\x1e", "\u0105").replace("\x1f", "\u0106")) for i, t in rows], good)
    same(queries.op4_lm_scoring(spark, sf), want)


def test_query_tells_good_from_bad_and_knows_what_occurs_twice(spark):
    sf = str(DATA / "sf0.1")
    got = {r["doc_id"]: r for r in queries.op4_lm_scoring(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    mean = {q: sum(got[i]["lm_score"] for i, y in labels.items() if y == q) / sum(y == q for y in labels.values()) for q in (0, 1)}
    assert len(got) == 10_000 and mean[1] > mean[0]
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    times = Counter(t for _, t in texts)
    loss = {twice: [got[i]["background_loss"] for i, t in texts if (times[t] > 1) == twice and got[i]["n_words"] > 50] for twice in (True, False)}
    assert sorted(loss[True])[len(loss[True]) // 2] < sorted(loss[False])[len(loss[False]) // 10]


def test_many_different_pairs_are_counted_apart(make, spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.choice((int(rng.paretovariate(2)), rng.randrange(90_000)))}" for _ in range(6_000))) for i in range(100)]
    assert len({p for _, t in rows for p in zip(t.split(), t.split()[1:])}) > 1 << 18
    same(score(make(*rows), spark.createDataFrame([(0,)], "doc_id long")), brute(rows, {0}))
