import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import chat, queries
from strandlake.llm.chat import escape, formatted, read_turns, unescape, write_piece, write_turn
from tests.conftest import DATA

TEXT = st.text(alphabet=st.sampled_from(list("ab<[/]>\\|s \nINST")), max_size=20)
TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|", "tool["]), TEXT)


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=5))
def test_turns_read_back(turns):
    assert read_turns("".join(write_turn(*t)[0] for t in turns)) == turns


@given(TEXT)
def test_no_mark_in_escaped_text(text):
    e = escape(text)
    assert unescape(e) == text
    for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<|", "<|>", "<|end|>"):
        assert mark not in e


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(TURN, min_size=1, max_size=4), min_size=1, max_size=6))
def test_tree_shares_prefixes_and_its_intervals_give_each_conversation(conversations):
    rows = [(str(i), [r for r, _ in c], [t for _, t in c]) for i, c in enumerate(conversations)]
    above = [("root", 7), ("next", 5)] if len(rows) % 2 else []
    made = write_piece("p", rows, above)
    text, segments, ends = made["text"], made["segments"], made["conversations"]
    assert len(segments) == len({tuple(c[: k + 1]) for c in conversations for k in range(len(c))})
    assert sorted(e["key"] for e in ends) == sorted(k for k, _, _ in rows)
    for e in ends:
        s = segments[e["segment"]]
        assert [(i["piece"], i["end"]) for i in s["ancestors"][: len(above)]] == above
        inside = [*s["ancestors"][len(above) :], s]
        alone = "".join(text[i["start"] : i["end"]] for i in inside)
        assert sum((made["position_ids"][i["start"] : i["end"]].tolist() for i in inside), []) == list(range(12 if above else 0, (12 if above else 0) + len(alone)))
        assert read_turns(alone) == conversations[int(e["key"])]
        # Positions run as if the conversation were alone, and intervals lie before the segment.
        assert s["position"] == len(alone) - (s["end"] - s["start"]) + (12 if above else 0) and all(i["end"] <= s["start"] for i in inside[:-1])


def expected(rows):
    """(conv_id, turn, role, text) rows as the query's figures, all in plain Python."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        length = sum(len(write_turn(r, t)[0]) for _, _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), length, length * (length - 1) // 2)
    return out


FIELDS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "position_sum")


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(str(DATA / "sf0.01/conversations.parquet")).select("conv_id", "turn", "role", "text").collect()]
    got = queries.op2_chat_format(spark, str(DATA / "sf0.01")).collect()
    assert {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in got} == expected([*rows, *queries.MARKED]) and len(got) == len({r[0] for r in rows}) + 1


@pytest.mark.parametrize("most,shared", [(1, 0), (2, 10**6), (64, 10**6)])
def test_odd_rows_and_hot_turns(spark, monkeypatch, most, shared):
    monkeypatch.setattr(chat, "SHARED_BYTES", shared)
    rows = [(i, t, r, x) for i in range(12) for t, r, x in ((0, "user", "hi"), (1, "assistant", f"answer {i // 2}"), (2, "user", "hi" if i < 4 else str(i)))]
    rows += [(50, 0, None, None), (51, None, "assistant", None), (None, 0, "user", "null id"), (52, 0, "user", "x" * 100_000), (53, 0, "user", "twice"), (53, 0, "user", "twice"), (54, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS tree", "3 AS chain")
    got = formatted(df, most=most).collect()
    assert {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in got} == expected(rows) and len(got) == 18
    assert formatted(df.limit(0)).collect() == []


def test_shared_turns_are_written_once_in_bounded_pieces(spark):
    rows = [(i, t, r, x) for i in range(40) for t, r, x in ((0, "user", "common start"), (1, "assistant", f"a{i % 3}"), (2, "user", f"b{i}"))]
    rows += [(100, 0, "user", "common start"), (101, 0, "user", "common start"), (101, 1, "assistant", "a0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    _, distinct = chat.distinct_conversations(df, "conv_id", "turn", "role", "text")
    made = {p["piece"]: p for p in chat.trees(distinct, 8, lambda: lambda s: [ord(c) for c in s]).collect()}
    assert len({p["tree"] for p in made.values()}) == 1 and sum(len(p["conversations"]) for p in made.values()) == 42
    assert max(len(p["conversations"]) for p in made.values()) <= 16 and len(made) > 6
    every = "".join(p["text"] for p in made.values())
    assert every.count("common start") == 1 and all(every.count(f" a{k}</s>") == 1 for k in range(3))
    for p in made.values():
        assert "".join(map(chr, p["tokens"])) == p["text"]
        for s in p["segments"]:
            assert list(p["position_ids"][s["start"] : s["end"]]) == list(range(s["position"], s["position"] + s["end"] - s["start"]))
            before = [list(made[i["piece"]]["position_ids"][i["start"] : i["end"]]) for i in s["ancestors"]]
            assert sum(before, []) == list(range(s["position"]))
            if s["loss_end"] > s["loss_start"]:
                assert "".join(map(chr, p["tokens"][s["loss_start"] : s["loss_end"]])).startswith("a")
