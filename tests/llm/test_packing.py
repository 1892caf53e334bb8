import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm import queries
from strandlake.llm.packing import Limits, WordEncoder, pack, place, word_encoder
from tests.conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70), st.integers(0, 70)), max_size=25), st.integers(1, 5), st.integers(1, 32))
def test_place_keeps_every_token_within_all_limits(examples, segments, loss):
    limits = Limits(32, segments, loss)
    tokens = np.array([t for t, _ in examples], np.int64)
    prefix = np.array([min(p, t) for t, p in examples], np.int64)
    seen = defaultdict(list)
    for seq in place(tokens, prefix, limits):
        used = sum(p.length for p in seq)
        assert 0 < used <= 32 and len(seq) <= segments and sum(p.loss for p in seq) <= loss
        for p in seq:
            assert p.loss == max(0, p.start + p.length - max(prefix[p.example], p.start))
            seen[p.example].append((p.start, p.length))
    for i, n in enumerate(tokens):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_largest_dot_product_goes_first():
    limits = Limits(10, 10, 10)
    seqs = place(np.array([6, 4, 3, 7]), np.zeros(4, np.int64), limits)
    assert [[p.example for p in s] for s in seqs] == [[3, 2], [0, 1]]


def test_little_padding():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 3000, 500)
    seqs = place(tokens, np.zeros(500, np.int64))
    used = [sum(p.length for p in s) for s in seqs]
    assert all(u == 4096 or u & (u - 1) == 0 for u in used)


def test_words_encode_as_whole_texts():
    t, e = Tokenizer.from_file(PATH), WordEncoder(PATH, most=3)
    texts = ["Hello  wörld\tDON'T x\n", "", "a\x1cb c d", "<|endoftext|> x<|startoftext|>y", "É é ΟΔΟΣ 12345", "日本語 テキスト", "w" * 5000, "Word. word, WORD! a\". it's, É. x_. 12, ?! ...", "<|endoftext|>. x<|endoftext|>", "A" * 300 + ".", "a\x01b \x01 c", "x<|ENDOFTEXT|>y. A<|endoftext|>B, I\u0307x E\u0301"]
    for _ in range(2):
        assert e([s.encode() for s in texts]) == [np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes() for s in texts]


def check(pieces, docs):
    """Pieces against the tokenizer: every id once, gapless sequences. docs: (id, text) rows with different ids."""
    t = Tokenizer.from_file(PATH)
    ids = {i: [*t.encode(s or "", add_special_tokens=False).ids, 2] for i, s in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = np.array(ids[i][p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["doc_tokens"] == len(ids[i]) and p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids[i])
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        total += at
    assert padding <= 0.01 * total


def test_query_against_the_tokenizer(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()]
    check(queries.op3_packing(spark, str(DATA / "sf0.001")).collect(), docs)


def test_odd_rows(make):
    docs = make((1, None), (2, ""), (3, "word " * 9000), (4, "same"), (4, "same"), (None, "x"))
    out = pack(docs, word_encoder(PATH), with_ids=True).collect()
    assert sorted(str(r["doc_id"]) for r in out if r["start"] == 0) == ["1", "2", "3", "4", "4", "None"]
    assert sum(r["length"] for r in out if r["doc_id"] == 3) == 9001
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in out)
    assert pack(docs.limit(0), word_encoder(PATH)).collect() == []
    assert pack(make((1, None)), word_encoder(PATH), end_id=None).collect() == []


@pytest.mark.parametrize("rows", [1, 3])
def test_chunks_and_prompts(make, rows):
    docs = make(*[(i, "a b c d e f") for i in range(7)]).selectExpr("*", "4L AS prompt")
    out = pack(docs, word_encoder(PATH), limits=Limits(8, 2, 3), chunk_rows=rows, prompt_tokens="prompt").collect()
    assert sum(r["length"] for r in out) == 49 and sum(r["loss_tokens"] for r in out) == 21
    by = defaultdict(int)
    for r in out:
        by[r["sequence_id"]] += r["loss_tokens"]
    assert max(by.values()) <= 3
