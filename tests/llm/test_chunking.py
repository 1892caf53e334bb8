import hashlib
import random

import pytest

from strandlake.llm import chunking, queries
from strandlake.llm.chunking import GEAR, Cuts, chunks, containment, edited, fingerprint, from_text, gear_hashes, text_form, with_edits
from tests.conftest import DATA


def test_gear_hash_equals_the_rolling_loop():
    data = random.Random(0).randbytes(300)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert gear_hashes(data).tolist() == want and len(set(GEAR.tolist())) == 256


def test_chunks_hold_limits_and_survive_shifts():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    cuts = Cuts()
    parts = chunks(data, cuts)
    assert b"".join(parts) == data and all(cuts.least <= len(p) <= cuts.most for p in parts[:-1])
    assert 40 <= sum(map(len, parts)) / len(parts) <= 110
    assert containment(fingerprint(data), fingerprint(b"inserted " + data)) > 0.95
    assert chunks(b"") == [] and chunks(b"x") == [b"x"]


def test_containment():
    a, b = {1: 30, 2: 70}, {2: 70, 3: 10}
    assert containment(a, b) == 0.7 and containment(a, a) == 1.0 and containment({}, {}) == 1.0 and containment({}, a) == 0.0 and containment(a, {}) == 0.0
    fp = fingerprint(b"some text that is long enough to be cut into several chunks, " * 20)
    assert from_text(text_form(fp)) == fp


def brute(rows, id_of=lambda r: r[0]):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), (r[1] or "").encode()))
    out = []
    for i, (d, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        e = edited(text, following)
        a, b, c = (fingerprint(x.encode()) for x in (text, e, following))
        out.append((d, len(text), hashlib.sha256(e.encode()).hexdigest(), text_form(a), text_form(b), containment(a, b), containment(a, c)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).collect()]
    assert rows_of(queries.op5_chunk_fingerprints(spark, str(DATA / "sf0.01"))) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_odd_rows(make, n):
    rng = random.Random(n)
    some = [(rng.randint(0, n), rng.choice([None, "", "ü" * 99, "some words " * 30, "x" * 50_000 if n == 5 else "y"])) for _ in range(n)] + [(None, "no id")] * (n > 2)
    assert rows_of(with_edits(make(*some))) == brute(some)


def test_empty(make):
    assert with_edits(make((1, "x")).limit(0)).collect() == []
    assert chunking.fingerprints(make((1, None)), out="f2").head()["f2"] == ""
