"""Near copies by shingles, against all pairs."""

import itertools
import random

import numpy as np
import pytest

from strandlake.llm import shingles
from strandlake.llm.simhash import classes, first_of_each
from tests.conftest import DATA


def plain(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(pairs_of, least=0.8):
    """Pairs of keys whose sets are similar, by counting what each two share."""
    inverted, common = {}, {}
    for k, s in pairs_of.items():
        for x in s:
            inverted.setdefault(x, []).append(k)
    for ks in inverted.values():
        for p in itertools.combinations(sorted(ks), 2):
            common[p] = common.get(p, 0) + 1
    return {p for p, n in common.items() if n >= least * (len(pairs_of[p[0]]) + len(pairs_of[p[1]]) - n)}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed):
    rng, texts = random.Random(seed), []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        texts += [" ".join(words)] + [edited(rng, words, rng.randint(1, 5)) for _ in range(rng.randint(0, 9))]
    return texts + ["", " ", "a b c", "A B c", "a b d", "one two three four five", "one two three four five six"]


def test_shingles_are_sets_of_the_definition():
    for text in corpus(1):
        got = shingles.shingles(text.encode())
        assert len(got) == len(plain(text)) and (np.diff(got.astype(object)) > 0).all()
    assert shingles.shingles(None).size == 0 and len(shingles.shingles(b"x " * 9)) == 1


def test_buckets_are_shared_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    shared = []
    for _ in range(200):
        base = rng.integers(1 << 63, size=900, dtype=np.uint64)
        a, b = base[:800], np.concatenate([base[100:800], base[800:]])  # similarity 700 / 900
        shared.append((shingles.buckets(a) == shingles.buckets(b)).mean())
    assert np.mean(shared) == pytest.approx((700 / 900) ** 4, abs=0.03)


def test_kept_rows_are_the_first_of_their_classes(make):
    """Classes are what links of fingerprints and pairs of similar sets connect."""
    texts = corpus(0)
    docs = make(*enumerate(texts))
    kept = {r["doc_id"] for r in first_of_each(docs, jaccard=0.8).collect()}
    root = {r["doc_id"]: r["component_id"] for r in classes(docs).collect()}
    by_bits = set(root.values())
    pairs = alike({i: plain(t) for i, t in enumerate(texts)})

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert kept == {find(i) for i in root} and kept < by_bits


def test_no_near_copies_stay_in_the_pipeline_stage(spark):
    docs = spark.read.parquet(str(DATA / "sf0.1" / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    pairs = alike({i: plain(t) for i, t in texts.items()})
    different = {p for p in pairs if texts[p[0]] != texts[p[1]]}
    kept = {r["doc_id"] for r in first_of_each(docs, jaccard=0.8).select("doc_id").collect()}
    assert len(different) >= 48 and not any(a in kept and b in kept for a, b in pairs)


def test_odd_rows(make):
    long = "many words in one long text " * 4000
    rows = [(5, "a b c d e"), (3, "A B C D E"), (3, "A B C D E"), (None, "a b c d e"), (7, None), (9, ""), (8, long), (None, "alone without an id"), (None, "alone without an id")]
    docs = make(*rows)
    kept = first_of_each(docs, jaccard=0.8)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert first_of_each(docs.limit(0), jaccard=0.8).collect() == []


def test_a_full_bucket_hides_no_pair(spark):
    """340 texts with most shingles in common, of which only 20 pairs are just alike, the others just not: all share buckets with very many."""
    rng = random.Random(5)
    core, texts = [f"c{i}" for i in range(600)], []
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(320):
        mine = own(80)
        texts.append(" ".join(core + mine))
        if k < 20:
            texts.append(" ".join(core + mine[:10] + own(70)))
    pairs = alike({i: plain(t) for i, t in enumerate(texts)})
    assert pairs == {(2 * k, 2 * k + 1) for k in range(20)}
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, h long, text string")
    got = {r["h"]: r["root"] for r in shingles.classes(docs, docs.selectExpr("h", "id", "h AS root")).collect()}
    assert len(got) == len(texts) and len(set(got.values())) == len(texts) - 20 and all(got[a] == got[b] for a, b in pairs)


@pytest.mark.parametrize("common", [0, 300])
def test_prefixes_of_alike_sets_meet(common):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, m = rng.integers(1, 200), rng.integers(0, 25)
        base = np.unique(rng.integers(400, size=n, dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(400, size=m, dtype=np.uint64)]))
        known = np.arange(common, dtype=np.uint64), rng.integers(4, 90, size=common)
        shared = len(np.intersect1d(base, other))
        if shared >= 0.8 * (len(base) + len(other) - shared):
            assert np.intersect1d(shingles.prefix(base, known, 0.8), shingles.prefix(other, known, 0.8)).size


def test_edits_of_one_text_are_few_pairs(spark, monkeypatch):
    """Edits that are alike to one text, but not to each other: pairs that are verified, and rows of the lists, grow with them and not with their square."""
    rng, proposed = random.Random(6), []
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)] + [edited(rng, base, 3) for _ in range(400)]
    pairs = alike({i: plain(t) for i, t in enumerate(texts)})
    assert len({i for p in pairs for i in p}) > 350 and len(pairs) < 40_000
    rest = shingles._rest

    def counted(*args):
        proposed.append(rest(*args).count())
        return rest(*args)

    monkeypatch.setattr(shingles, "_rest", counted)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, h long, text string")
    got = {r["h"]: r["root"] for r in shingles.classes(docs, docs.selectExpr("h", "id", "h AS root")).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert len(set(got.values())) == len({find(i) for i in root}) and all(got[a] == got[b] for a, b in pairs)
    assert proposed and max(proposed) < 3 * len(texts)


def test_parities_differ_at_most_as_often_as_sets():
    rng = np.random.default_rng(8)
    for n in (1, 5, 60, 400, 3000):
        base = rng.integers(1 << 63, size=n, dtype=np.uint64)
        other = np.concatenate([base[n // 9 :], rng.integers(1 << 63, size=n // 7, dtype=np.uint64)])
        differ = int(np.bitwise_count((shingles.parities(base) ^ shingles.parities(other)).view(np.uint64)).sum())
        assert differ <= n // 9 + n // 7 and (n > 400 or differ >= 0.6 * (n // 9 + n // 7))
        assert len(shingles.parities(base)) == shingles.PARITIES and (shingles.parities(base) == shingles.parities(base[::-1])).all()


def test_texts_that_only_share_a_passage_send_no_sets(spark, monkeypatch):
    """Their lists meet (nothing counts as frequent here), but of such pairs' texts no sets are made; those of alike pairs are."""
    rng, asked = random.Random(9), []
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(60)
    texts = [" ".join(own(150) + passage + own(150)) for _ in range(80)]
    texts += [edited(rng, texts[k].split(), 3) for k in (0, 1)]
    sets = shingles._sets

    def counted(df, width):
        asked.append(df.count())
        return sets(df, width)

    monkeypatch.setattr(shingles, "_sets", counted)
    monkeypatch.setattr(shingles, "COMMON", 10**9)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, h long, text string")
    got = {r["h"]: r["root"] for r in shingles.classes(docs, docs.selectExpr("h", "id", "h AS root")).collect()}
    assert got[0] == got[80] and got[1] == got[81] and len(set(got.values())) == 80
    assert asked and sum(asked) < 20


def test_the_most_frequent_shingles_are_told(spark, monkeypatch):
    texts = ["a b c d e f"] * 9 + ["g h i j k l"] * 6 + ["m n o p q r s"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    monkeypatch.setattr(shingles, "COMMON", 2)
    for most, counts in ((7, [3, 3, 3, 6, 6, 9, 9]), (6, [6, 6, 9, 9]), (3, [9, 9]), (1, [])):
        monkeypatch.setattr(shingles, "MOST", most)
        keys, n = shingles._common(df, 5, 1)
        assert sorted(n.tolist()) == counts and (np.diff(keys.astype(object)) > 0).all()
