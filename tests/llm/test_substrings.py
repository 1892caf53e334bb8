import hashlib
import random

import numpy as np
import pytest

from strandlake.llm import queries, substrings
from strandlake.llm.fmindex import FMIndex, suffix_array
from strandlake.llm.substrings import WINDOW, remove, report
from tests.conftest import DATA


@pytest.mark.parametrize("seed", range(6))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    kinds = [1, 2, 3, 300, 5000, 2][seed]
    lengths = rng.integers(1, 60, rng.integers(1, 9))
    texts = [rng.integers(0, kinds, n) for n in lengths]
    index = FMIndex(np.concatenate(texts), lengths, kinds)
    stream = np.concatenate([*texts, rng.integers(-1, kinds, 50)])
    ends = np.arange(8, len(stream) + 1)
    reached, low, high = index.matches(stream, ends, 8)

    def places(p):
        return [int(b) + i for t, b in zip(texts, index.begins) for i in range(len(t) - len(p) + 1) if (t[i : i + len(p)] == p).all()]

    for e, n, a, b in zip(ends, reached, low, high):
        want = max([k for k in range(1, 9) if places(stream[e - k : e])], default=0)
        assert n == want
        if n:
            at = places(stream[e - n : e])
            assert sorted(index.locate(np.arange(a, b)).tolist()) == at
            assert index.earliest(np.array([a]), np.array([b])).tolist() == at[:1]
    symbols = np.append(texts[0], 0)
    assert suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())


def test_fm_index_is_compressed():
    rng = np.random.default_rng(0)
    index = FMIndex(rng.integers(0, 1000, 100_000), np.full(1000, 100), 1000)
    held = sum(b.words.nbytes + b.counts.nbytes for b in (index.marks, *index.matrix.planes)) + index.samples.nbytes
    assert held < 3 * 100_000  # 11 planes; a suffix array of 8 bytes a place and the words themselves are not kept


def brute(rows):
    """(id, text) rows; rows with one id are at one place."""
    key = lambda d: (d is None, d or 0)
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for s in range(len(w) - WINDOW + 1):
            k = tuple(w[s : s + WINDOW])
            first[k] = min(first.get(k, (key(d), s)), (key(d), s))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - WINDOW + 1):
            if first[tuple(w[s : s + WINDOW])] < (key(d), s):
                gone[s : s + WINDOW] = [True] * WINDOW
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(DATA / sf / "documents.parquet")).collect()]
    assert rows_of(queries.op10_substring_dedup(spark, str(DATA / sf))) == brute(rows)


def corpus(seed, n=40):
    rng = random.Random(seed)
    passages = [[f"w{rng.randint(0, 9 if seed % 2 else 500)}" for _ in range(rng.randint(15, 60))] for _ in range(5)]
    rows = []
    for i in range(n):
        words = [f"u{rng.randint(0, 10_000)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edited"
            words += p + [f"u{rng.randint(0, 10_000)}" for _ in range(rng.randint(0, 10))]
        if rng.random() < 0.2:
            words += ["run"] * rng.randint(10, 80)
        rows.append((i, " \n".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot,shard,stream", [(512, 500_000, 4_000_000), (1, 2_000, 1_000)])
def test_random_corpora(make, monkeypatch, seed, hot, shard, stream):
    monkeypatch.setattr(substrings, "HOT", hot)  # 1: all anchors with several segments go by single windows
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "STREAM", stream)  # a shard's segments are searched in several tasks
    rows = corpus(seed)
    assert rows_of(report(make(*rows))) == brute(rows)


@pytest.mark.parametrize("broken", ["matches", "earliest"])
def test_the_index_decides(make, monkeypatch, broken):
    """With an index that finds everything everywhere, or locates wrongly, other words go."""
    rows = corpus(1)
    real = substrings.search_shard
    table = parts(rows)
    want = real(table)
    if broken == "matches":
        monkeypatch.setattr(FMIndex, "matches", lambda self, w, e, n, least=1: (np.full(len(e), n), np.zeros(len(e), np.int64), np.full(len(e), self.n)))
    else:
        monkeypatch.setattr(FMIndex, "earliest", lambda self, low, high: np.zeros(len(low), np.int64))
    assert want.num_rows and real(table) != want


def parts(rows):
    """A shard of whole texts as segments."""
    import pyarrow as pa

    rows = [(i, b" ".join(t.encode().split())) for i, t in rows if len(t.split()) >= WINDOW]
    ids, words, n = [i for i, _ in rows], [w for _, w in rows], len(rows)
    return pa.table({"nn": [False] * n, "id": ids, "v": ids, "starts": pa.array([[0]] * n, pa.list_(pa.int32())), "words": pa.array(words, pa.binary()), "lead": [True] * n, "own": [True] * n})


def test_hot_passage(make, monkeypatch):
    """One passage in every document, different words around it: no shard and no task takes it whole."""
    monkeypatch.setattr(substrings, "HOT", 16)
    monkeypatch.setattr(substrings, "STREAM", 2_000)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join([*(f"a{i}-{k}" for k in range(8)), passage, *(f"b{i}-{k}" for k in range(25))])) for i in range(300)]
    assert rows_of(report(make(*rows))) == brute(rows)


def test_odd_rows(make):
    twenty = " ".join(f"w{i}" for i in range(20))
    rows = [(3, twenty), (1, twenty + " more"), (2, None), (4, ""), (5, "short text"), (5, "short text"), (6, twenty + "\n" + twenty), (6, twenty), (7, "x " * 60_000), (None, twenty), (None, "other " + twenty), (2**63 - 1, twenty + " last"), (-(2**63), "first " + twenty)]
    docs = make(*rows)
    assert rows_of(report(docs)) == brute(rows)
    out = remove(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by = sorted(((str(r["doc_id"]), r["text"]) for r in out.collect()), key=repr)
    assert ("1", "more") in by and ("-9223372036854775808", "first " + twenty) in by and ("3", "") in by and ("2", None) in by and ("None", "other") in by and ("6", "") in by
    # Repeated rows under one id are at one place: neither is earlier.
    assert [t for i, t in by if i == "5"] == ["short text"] * 2
    assert report(docs.limit(0)).collect() == [] and remove(docs.limit(0)).collect() == []
