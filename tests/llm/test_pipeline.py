import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import quality
from strandlake.llm.common import fold
from strandlake.llm.simhash import classes
from tests.conftest import DATA
from tests.llm.test_shingles import alike, plain
from tests.llm.test_packing import check
from tests.llm.test_substrings import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf, at = str(DATA / "sf0.01"), tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(at / name))
        out[name] = docs = spark.read.parquet(str(at / name))
    return out


def test_columns(stages):
    assert [n for n in stages] == ["documents", "quality_filter", "near_dedup", "substring_dedup", "source_mix", "pack"]
    assert all(stages[n].columns == COLUMNS for n in list(stages)[:-1])


def test_quality_stage(spark, stages):
    docs, labels = stages["documents"], spark.read.parquet(str(DATA / "sf0.01/labels.parquet"))
    model = quality.fit(docs, labels, where=fold(F.col("doc_id"), 5) != 0)
    want = {r["doc_id"] for r in quality.score(docs, model, score_col="s").filter("s >= 0.3").collect()}
    kept = [r["doc_id"] for r in stages["quality_filter"].collect()]
    assert sorted(kept) == sorted(want) and 0 < len(kept) < docs.count()
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert len(good - set(kept)) <= 0.01 * len(good) and len(bad & set(kept)) <= 0.1 * len(bad)


def test_near_dedup_stage(stages):
    """The first of each class that fingerprints within four bits, or shingle sets of similarity 0.8, connect: by all pairs."""
    before = {r["doc_id"]: r["text"] for r in stages["quality_filter"].collect()}
    root = {r["doc_id"]: r["component_id"] for r in classes(stages["quality_filter"]).collect()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in alike({i: plain(t) for i, t in before.items()}):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in stages["near_dedup"].collect()) == sorted({find(i) for i in root})


def test_substring_stage(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["near_dedup"].collect()]
    import hashlib

    want = {d: (n, gone, h) for d, n, gone, h in brute(before)}
    whole = dict(before)
    for r in stages["substring_dedup"].collect():
        n, gone, h = want[r["doc_id"]]
        if gone:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == h
        else:
            assert r["text"] == whole[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])


def test_mix_and_pack_stages(stages):
    before = {r["doc_id"]: tuple(r) for r in stages["substring_dedup"].collect()}
    mixed = [tuple(r) for r in stages["source_mix"].collect()]
    assert all(before[r[0]] == r for r in mixed) and max(sum(r[0] == d for r in mixed) for d in list(before)[:50]) <= 2
    pieces = stages["pack"].collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
    assert sum(p["start"] == 0 for p in pieces) == len(mixed)


def test_pack_of_different_documents(spark, stages):
    docs = stages["substring_dedup"]
    check(corpus_pipeline.pack(spark, docs, "").collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_run(spark):
    assert corpus_pipeline.run(spark, str(DATA / "sf0.001")).count() > 0 and corpus_pipeline.ORACLE_SQL is None


ODD = [(1, "a plain text of some words that is like no other one in this small table"), (1, "a plain text of some words that is like no other one in this small table"), (1, "quite another text under the same id, and its words differ all the way to the end"), (None, "no id here but still some words that nobody else has said before this line"), (None, None), (2, None), (3, ""), (4, "word " * 30_000), (None, "no id at all, again, and other words than those of the line above, I think")]


def test_stages_on_odd_rows(spark, make):
    """Nulls, repeated ids and rows, empty and long texts: each stage gives what its docstring says."""
    sf = str(DATA / "sf0.001")
    docs = make(*ODD, extra=False)
    rows = {n: f(spark, docs, sf) for n, f in corpus_pipeline.STAGES}
    got = {n: [(r["doc_id"], r["text"]) for r in rows[n].collect()] for n in list(rows)[:-1]}
    assert all(rows[n].columns == COLUMNS for n in got)
    assert set(got["quality_filter"]) <= set(ODD)
    # Copies and texts without words are one class each; unlike texts stay, whatever their ids.
    texts = [t or "" for _, t in got["near_dedup"]]
    assert sorted(texts) == sorted({t or "" for _, t in ODD}) and (2, None) in got["near_dedup"]
    assert len(got["substring_dedup"]) == len(ODD) and sorted(str(i) for i, _ in got["substring_dedup"]) == sorted(str(i) for i, _ in ODD)
    assert set(got["source_mix"]) <= set(ODD) and rows["pack"].filter("start = 0").count() == len(ODD)


def test_stages_on_an_empty_table(spark, make):
    docs = make(*ODD, extra=False).limit(0)
    assert all(f(spark, docs, str(DATA / "sf0.001")).collect() == [] for _, f in corpus_pipeline.STAGES)


def test_the_rest_imports_without_this_part(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    for p in root.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "strandlake", "tests"):
            os.symlink(p, tmp_path / p.name)
    (tmp_path / "strandlake").mkdir()
    for p in (root / "strandlake").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "strandlake" / p.name)
    said = subprocess.run([sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    names = json.loads(said.stdout.strip().splitlines()[-1])
    assert "filter_events" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
