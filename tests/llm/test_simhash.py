import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from strandlake.llm import queries
from strandlake.llm.common import scratch
from strandlake.llm.components import components
from strandlake.llm.simhash import _LEVELS, _finer, _long_lists, _partners, _triples, classes, fingerprint, first_of_each, linked_classes
from tests.conftest import DATA


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = {t: plain(t) for _, t in rows}
    different = sorted(set(fps.values()))
    pairs = [(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if (a ^ b).bit_count() <= 4]
    root = union(pairs, different)
    least = {}
    for d, t in rows:
        r = root[fps[t]]
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{fps[t]:016x}", least.get(root[fps[t]])) for d, t in rows), key=repr)


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "Ä É a b c d e a b c d", "x " * 500, "a\x1cb c d e"])
def test_fingerprint(text):
    assert fingerprint(text.encode() if text is not None else None) == plain(text)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).collect()]
    got = queries.op7_simhash_dedup(spark, str(DATA / "sf0.01")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def same_classes(got, want):
    assert set(got) == set(want)
    assert len({(got[n], want[n]) for n in want}) == len(set(got.values())) == len(set(want.values()))


def test_any_four_positions_hold_a_list():
    triples = [set(at) for at in _triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))


def near_fingerprints():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(8)]
    return set(base) | {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 4, 4, 5, 6) for _ in range(4)} | {b ^ 0x0101010100000000 for b in base} | {0, (1 << 64) - 1}


@pytest.mark.parametrize("long,levels", [(256, 0), (8, 2), (1, 2)])
def test_every_fingerprint_with_a_link_is_found(spark, long, levels):
    fps = near_fingerprints()
    df = spark.createDataFrame([(signed(x),) for x in fps], "node long").selectExpr("node", "node AS root")
    with scratch(spark) as put:
        lists = _long_lists(df, long, put)
        assert len(lists) == levels
        got = _partners(df, 4, lists).collect()
    linked = {signed(a) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}
    assert {r["node"] for r in got} == linked and len(got) == len(linked)
    assert all(0 < ((r["node"] ^ r["other"]) & (1 << 64) - 1).bit_count() <= 4 for r in got)


def test_finer_lists_lose_no_pair():
    """Any four different bits leave a list of every level that holds the pair."""
    rng = random.Random(2)
    for _ in range(400):
        x = sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4)))
        masks = [m for m in _LEVELS[0] if not m & x]
        for _ in range(2):
            assert masks
            for m in masks:
                assert any(not f & x for f in _finer(m))
            masks = [f for m in masks for f in _finer(m) if not f & x]
        assert masks and all(_finer(m) == [] for m in masks)


@pytest.mark.parametrize("bits", [4, 3, 1, 0])
def test_linked_classes(spark, bits):
    fps = near_fingerprints()
    got = linked_classes(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), bits).collect()
    pairs = [(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits]
    same_classes({r["node"]: r["root"] for r in got}, union(pairs, [signed(x) for x in fps]))
    assert {r["node"] for r in got if r["linked"]} == {x for p in pairs for x in p}


@pytest.mark.parametrize("count,centred", [(190_000, True), (6_000, False)])
def test_many_variants_of_one_fingerprint(spark, count, centred):
    """Fingerprints within four bits of one, which is there or not: many millions of links, none written out, few classes."""
    rng = np.random.default_rng(1)
    flips = np.uint64(1) << rng.integers(64, size=(count, 4), dtype=np.uint64)
    flips[rng.random(flips.shape) < 0.2] = 0
    center = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(np.append(np.bitwise_xor.reduce(flips, axis=1) ^ center, [center, ~center]))
    assert len(fps) > 100_000 or not centred
    if not centred:
        fps = fps[np.bitwise_count(fps ^ center) != 0]
    got = linked_classes(spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)})))
    # Every two of those with at most two flips are linked, and every other one with one of these.
    assert sorted(r["count"] for r in got.groupBy("root").count().collect()) == [1, len(fps) - 1]


def test_estimates_do_not_grow_with_the_rounds(spark):
    """A path is contracted in many rounds."""
    got = components(spark.range(3000).selectExpr("id AS a", "id + 1 AS b"))
    assert {r["count"] for r in got.groupBy("root").count().collect()} == {3001}
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(20)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(edges, {x for e in edges for x in e})
    same_classes(got, want)


def test_odd_rows(make, spark):
    long = "many words in one long text " * 4000
    rows = [(5, "a b c d e"), (3, "A B C D E"), (3, "A B C D E"), (None, "a b c d e"), (7, None), (9, ""), (8, long), (None, "alone without an id"), (None, "alone without an id")]
    docs = make(*rows)
    assert sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in classes(docs).collect()), key=repr) == brute(rows)
    kept = first_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert classes(docs.limit(0)).collect() == [] and first_of_each(docs.limit(0)).collect() == []
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_class_whatever_the_ids(make):
    a, b, c, d = "one text without an id", "another that is unlike it", "the third one under an id", "and a fourth under the same"
    docs = make((None, a), (None, a), (None, b), (5, c), (5, d), (None, c), (6, d), (5, c))
    assert sorted((str(r["doc_id"]), r["text"]) for r in first_of_each(docs).collect()) == sorted([("None", a), ("None", b), ("5", c), ("5", d)])


@pytest.mark.parametrize("few", [0, 20, 500_000])
def test_few_edges_are_finished_by_a_task(spark, monkeypatch, few):
    """Whether rounds or a task end it, the roots are the same classes; a path takes one task, not a round for each doubling."""
    monkeypatch.setattr("strandlake.llm.components.FEW", few)
    tables, write = [], type(spark.range(0).write).parquet
    monkeypatch.setattr(type(spark.range(0).write), "parquet", lambda *a, **k: (tables.append(a[1]), write(*a, **k))[1])
    edges = [(i, i + 1) for i in range(-40, 40)] + [(100, 101), (101, 100), (7, 7), (300, 300), (2**62, -(2**62))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    same_classes(got, union(edges, {x for e in edges for x in e}))
    assert few < 500_000 or len(tables) == 3
