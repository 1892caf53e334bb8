import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from strandlake.llm import queries, tandem
from tests.conftest import DATA


def brute_runs(w):
    """(start, length, period) of all runs of two periods or more, by trying every period at every place."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def factorised(w):
    """Ends of the Lempel-Ziv blocks, by trying every earlier place."""
    ends, i = [], 0
    while i < len(w):
        n = 0
        while i + n < len(w) and any(w[j : j + n + 1] == w[i : i + n + 1] for j in range(i)):
            n += 1
        i += max(1, n)
        ends.append(i)
    return ends


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randint(0, 45), rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 7)
            w = w[:a] + (w[a : a + p] * n)[: n - a]
        yield w


def test_blocks_and_runs_equal_brute_force():
    for w in sequences(1, 3000):
        assert tandem.SuffixTree(w).blocks == factorised(w)
        assert [tuple(r) for r in tandem.runs(w).tolist()] == brute_runs(w), w


def test_vocabulary_holds_every_primitive_square_once():
    for w in sequences(2, 600):
        tree = tandem.SuffixTree(w)
        found = [tuple(tree.text[tree.start[v] : tree.start[v] + d]) for v, d in tandem.vocabulary(tree, tandem.covering(w, tree.blocks))]
        squares = {tuple(w[i : i + 2 * k]) for k in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * k + 1) if w[i : i + k] == w[i + k : i + 2 * k]}
        primitive = {s for s in squares if not any(len(s) // 2 % p == 0 and s[: len(s) // 2] == s[:p] * (len(s) // 2 // p) for p in range(1, len(s) // 2))}
        assert len(found) == len(set(found)) and set(found) == primitive


def test_stretches_lose_no_run():
    rng = random.Random(3)
    for _ in range(300):
        texts = [[b"%d" % x for x in w] for w in sequences(rng.random(), 4)]
        for (exponent, least), found in [((e, m), tandem.texts_runs(texts, e, m)) for e, m in ((4, 6), (2, 2), (3, 5))]:
            for t, got in zip(texts, found):
                assert [tuple(r) for r in got.tolist()] == [r for r in brute_runs(t) if r[1] >= max(least, exponent * r[2])]


def test_long_sequences_stay_linear():
    for w in ([0] * 30_000, [i % 700 for i in range(30_000)]):
        assert tandem.runs(w).tolist() == [[0, 30_000, 1 if not any(w) else 700]]


def want(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j - i + q, q))
            i = j + 1
    found.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join("%d,%d,%d\n" % r for r in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, str(DATA / "sf0.01")).collect()}
    docs = pq.read_table(DATA / "sf0.01" / "documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 50
    for d in docs:
        assert got[d["doc_id"]] == want(d["doc_id"], d["text"])


def test_odd_rows(make):
    line = "again and again, "
    rows = [(None, line * 9), (1, None), (2, ""), (3, " \t\n"), (4, "w " * 6), (4, "w " * 6), (5, "w " * 5), (7, "x y x y x y x"), (8, "ü ü ü ü ü ü\x0bü ü")]
    got = sorted((tuple(r) for r in tandem.report(make(*rows, (9, "a b " * 60_000))).collect()), key=repr)
    assert [r[1:6] for r in got if r[0] == 9] == [(1, 0, 120_000, 2, 60_000_000)]
    assert [r for r in got if r[0] != 9] == sorted([(d, *want(None, t)[1:]) for d, t in rows], key=repr)
    assert tandem.report(make(extra=False)).collect() == []


@pytest.mark.parametrize("words,kept", [("a b a b a b a b c", "a b c"), ("x x x x x x x", "x"), ("a b c", "a b c")])
def test_collapse(words, kept):
    w = [x.encode() for x in words.split()]
    (found,) = tandem.texts_runs([w])
    assert b" ".join(tandem.collapse(w, found)).decode() == kept
