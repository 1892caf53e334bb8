"""Chat formatting with prefix trees.

A conversation is a path of turns. Conversations that share their first turns share a path of a
tree; the tree is written depth first, each shared turn once, as segments. A segment has the
positions that follow those of its parent, and the intervals of the written text that its tokens
attend to besides their own segment: its ancestors. Following those intervals gives back each
conversation as if it were written alone.

A tree is written in pieces of bounded size. A turn that begins very many conversations is a piece by
itself, written once however many they are; what follows it is written in other pieces, whose segments
name it, and the interval in it, among their ancestors.

Template: a user's turn is ``<s>[INST] text [/INST]``, an assistant's `` text</s>``, any other
``<|role<|>text<|end|>``. Within texts and role names each ``<`` and ``[`` is followed by an inserted
backslash, so no mark can occur in them, and taking these backslashes out gives them back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, near, written

USER, USER_END, ASSISTANT, ASSISTANT_END = "<s>[INST] ", " [/INST]", " ", "</s>"
ROLE, ROLE_END, OTHER_END = "<|", "<|>", "<|end|>"

TREE = "tree string, piece string, text string, segments array<struct<start:long,end:long,position:long,parent:int,ancestors:array<struct<piece:string,start:long,end:long>>,loss_start:long,loss_end:long>>, conversations array<struct<key:string,segment:int>>, tokens array<int>, position_ids array<int>"

Encoder = Callable[[str], list[int]]


def escape(text: str) -> str:
    return re.sub(r"[<\[]", r"\g<0>\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\", r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template has it, and the range in it that bears loss (empty but for assistants)."""
    body = escape(text)
    if role == "user":
        return USER + body + USER_END, 0, 0
    if role == "assistant":
        return ASSISTANT + body + ASSISTANT_END, len(ASSISTANT), len(ASSISTANT) + len(body)
    return ROLE + escape(role) + ROLE_END + body + OTHER_END, 0, 0


_TURN = re.compile(
    rf"{re.escape(USER)}(?P<user>(?:[^<\[]|[<\[]\\)*){re.escape(USER_END)}"
    rf"|{re.escape(ASSISTANT)}(?P<assistant>(?:[^<\[]|[<\[]\\)*){re.escape(ASSISTANT_END)}"
    rf"|{re.escape(ROLE)}(?P<role>(?:[^<\[]|[<\[]\\)*){re.escape(ROLE_END)}(?P<other>(?:[^<\[]|[<\[]\\)*){re.escape(OTHER_END)}"
)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns that :func:`write_turn` wrote one after the other."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup if m.lastgroup in ("user", "assistant") else None
        out.append((kind, unescape(m[kind])) if kind else (unescape(m["role"]), unescape(m["other"])))
        at = m.end()
    return out


def _parts(role: str, text: str) -> tuple[str, str, str]:
    """A written turn, cut at the ends of the range that bears loss."""
    body, a, b = write_turn(role, text)
    return body[:a], body[a:b], body[b:]


def turn_length(role: str, text: str, encode: Encoder | None = None) -> int:
    """Tokens of a written turn; code points without ``encode``."""
    return sum(len(encode(x)) if encode else len(x) for x in _parts(role, text))


def write_piece(name: str, conversations: list[tuple[str, list[str], list[str]]], above: Sequence[tuple[str, int]] = (), encode: Encoder | None = None) -> dict[str, Any]:
    """A piece of a tree (columns of ``TREE``) for conversations (key, roles, texts) that follow the turns ``above``.

    ``above`` names the pieces that hold the turns before, from the root, and their lengths. Turns are shared
    as long as role and text are equal; siblings follow in the order of their first conversation.
    """
    children: list[dict[tuple[str, str], int]] = [{}]
    turns: list[tuple[str, str]] = [("", "")]
    leaves: list[list[str]] = [[]]
    for key, roles, texts in conversations:
        node = 0
        for turn in zip(roles, texts):
            if turn not in children[node]:
                children[node][turn] = len(children)
                children.append({})
                turns.append(turn)
                leaves.append([])
            node = children[node][turn]
        leaves[node].append(key)
    out: list[str] = []
    tokens: list[int] = []
    positions: list[np.ndarray] = []
    segments: list[dict] = []
    ends: list[dict] = []
    outside = [{"piece": p, "start": 0, "end": n} for p, n in above]
    length = 0
    stack = [(n, -1, sum(n for _, n in above), ()) for n in reversed(children[0].values())]
    while stack:  # depth first
        node, parent, position, path = stack.pop()
        parts = _parts(*turns[node])
        out += parts
        coded = [encode(x) for x in parts] if encode else parts
        if encode:
            tokens += [t for x in coded for t in x]
        bare, loss, rest = map(len, coded)
        end = length + bare + loss + rest
        number = len(segments)
        segments.append({"start": length, "end": end, "position": position, "parent": parent, "ancestors": [*outside, *path], "loss_start": length + bare, "loss_end": length + bare + loss})
        ends += [{"key": k, "segment": number} for k in leaves[node]]
        positions.append(np.arange(position, position + end - length, dtype=np.int32))
        # Neighbouring intervals are one.
        first = path[-1]["start"] if path and path[-1]["end"] == length else length
        path = (*(path[:-1] if first < length else path), {"piece": name, "start": first, "end": end})
        stack += [(n, number, position + end - length, path) for n in reversed(children[node].values())]
        length = end
    return {"piece": name, "text": "".join(out), "segments": segments, "conversations": ends, "tokens": tokens, "position_ids": np.concatenate(positions) if positions else np.zeros(0, np.int32)}


def distinct_conversations(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every conversation, and (key, roles, texts, chain) of every different one.

    ``chain`` has a digest of each start of the conversation. Null roles and texts are as empty ones;
    turns are in the order of ``turn_col`` (null first), then role and text.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = turns.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.select("id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    id_field = whole.schema["id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = []
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                digest, chain = b"", []
                for role, text in zip(roles, texts):
                    r, t = role.encode("utf-8"), text.encode("utf-8")
                    digest = xxhash.xxh3_128_digest(digest + len(r).to_bytes(8, "little") + r + t)
                    chain.append(digest.hex())
                chains.append(chain)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chains, pa.list_(pa.string()))], [*batch.schema.names, "chain"])

    chained = map_texts(whole, task, f"id {id_field.dataType.simpleString()}, roles array<string>, texts array<string>, chain array<string>")
    chained = written(chained.withColumn("key", F.element_at("chain", -1)))
    ids = chained.select("id", "key")
    return ids, written(chained.groupBy("key").agg(F.first("roles").alias("roles"), F.first("texts").alias("texts"), F.first("chain").alias("chain")))


def dealt(distinct: DataFrame, most: int) -> DataFrame:
    """The conversations of each piece: piece, trunk, above, key, roles, texts, chain.

    Conversations with a common first turn make a tree. A turn that begins more than ``most``
    different conversations is a piece of its own (trunk: one row, a conversation with that turn cut after it, its key
    null unless one ends there). The conversations behind it are dealt out by their next turns. ``above``: how many
    first turns have pieces of their own.
    """
    starts = distinct.select("key", F.posexplode("chain").alias("depth", "prefix"))
    counts = starts.groupBy("prefix").agg(F.count("*").alias("n"))
    common = near(checkpointed(counts.filter(F.col("n") > most)))
    shared = starts.join(common, "prefix")
    last = near(checkpointed(shared.groupBy("key").agg(F.max(F.struct("depth", "prefix", "n")).alias("last"))))
    rest = distinct.join(last, "key", "left").withColumn("above", F.coalesce(F.col("last.depth") + 1, F.lit(0))).filter(F.size("chain") > F.col("above"))
    slot = F.pmod(F.xxhash64(F.get("chain", F.col("above"))), F.ceil(F.col("last.n") / most)).cast("string")
    piece = F.when(F.col("last").isNull(), F.get("chain", F.lit(0))).otherwise(F.concat_ws("-", F.col("last.prefix"), slot))
    rest = rest.select(piece.alias("piece"), F.lit(False).alias("trunk"), "above", "key", "roles", "texts", "chain")
    one = near(checkpointed(shared.groupBy("prefix").agg(F.min("key").alias("key"), F.max(F.col("key") == F.col("prefix")).alias("ends"), F.max("depth").alias("depth"))))
    cut = [F.slice(c, 1, F.col("depth") + 1).alias(c) for c in ("roles", "texts", "chain")]
    trunks = distinct.join(one, "key").select(F.col("prefix").alias("piece"), F.lit(True).alias("trunk"), F.col("depth").alias("above"), F.when(F.col("ends"), F.col("prefix")).alias("key"), *cut)
    return rest.union(trunks)


def trees(distinct: DataFrame, most: int = 64, encode: Callable[[], Encoder] | None = None) -> DataFrame:
    """One row for each piece of the prefix trees (schema ``TREE``) over (key, roles, texts, chain).

    Without ``encode`` a token is a code point of ``text`` and the array tokens stays empty. With it
    (called once a piece, it gives a function from a text to token ids) each segment is encoded by itself, the
    range that bears loss apart from the marks around it. Segments, intervals and positions count tokens; position_ids has each token's position.
    """

    def build(table: pa.Table) -> pa.Table:
        rows = table.select(["piece", "trunk", "above", "chain", "key", "roles", "texts"]).to_pylist()
        rows.sort(key=lambda r: (r["chain"], r["key"] or ""))
        run, first = encode() if encode else None, rows[0]
        n = first["above"]
        above = [(p, turn_length(r, t, run)) for p, r, t in zip(first["chain"][:n], first["roles"], first["texts"])]
        made = write_piece(first["piece"], [(r["key"], r["roles"][n:], r["texts"][n:]) for r in rows], above, run)
        if first["trunk"] and first["key"] is None:
            made["conversations"] = []
        interval = pa.list_(pa.struct([("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        segment = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("ancestors", interval), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))
        conversation = pa.list_(pa.struct([("key", pa.string()), ("segment", pa.int32())]))
        types = {"tree": pa.string(), "piece": pa.string(), "text": pa.string(), "segments": segment, "conversations": conversation, "tokens": pa.list_(pa.int32()), "position_ids": pa.list_(pa.int32())}
        made["tree"] = first["chain"][0]
        return pa.table({c: pa.array([made[c]], t) for c, t in types.items()})

    return dealt(distinct, most).groupBy("piece").applyInArrow(build, TREE)


#: Bytes of turns with pieces of their own up to which all tasks get them; else they are joined to the pieces that name them.
SHARED_BYTES = 16_000_000
SAID = "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, position_sum long"


def read_back(pieces: DataFrame) -> DataFrame:
    """What each conversation of the pieces (in code points) says, read from the written text alone, along the intervals.

    Columns: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, position_sum (of the position ids of its tokens).
    """
    names = F.array_distinct(F.flatten(F.transform("segments", lambda s: s["ancestors"]["piece"])))
    wanted = pieces.select("piece", F.explode(names).alias("at")).filter("at != piece")
    one, total = F.get("segments", F.lit(0)), F.aggregate("position_ids", F.lit(0).cast("long"), lambda x, y: x + y)
    told = pieces.select(F.col("piece").alias("at"), "text", total.alias("positions"), one["loss_start"].alias("loss_start"), one["loss_end"].alias("loss_end"))
    told = checkpointed(told.join(near(checkpointed(wanted.select("at").distinct())), "at"))
    columns = ["piece", "text", "segments", "conversations", "position_ids"]
    if (told.agg(F.sum(F.octet_length("text") + 200)).first()[0] or 0) <= SHARED_BYTES:
        known = pieces.sparkSession.sparkContext.broadcast({r["at"]: (r["text"], r["positions"], r["loss_start"], r["loss_end"]) for r in told.collect()})
        joined = pieces.select(*columns, F.lit(None).cast("array<struct<at:string,text:string,positions:long,loss_start:long,loss_end:long>>").alias("trunks"))
    else:
        known = None
        trunks = wanted.join(told, "at").groupBy("piece").agg(F.collect_list(F.struct(*told.columns)).alias("trunks"))
        joined = pieces.join(trunks, "piece", "left").select(*columns, "trunks")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, segments, ends, ids, trunks in zip(*(batch.column(c) for c in batch.schema.names)):
                segments, ids = segments.as_py(), ids.values.to_numpy()
                name, own = name.as_py(), text.as_py()
                outer = known.value if known is not None else {t["at"]: (t["text"], t["positions"], t["loss_start"], t["loss_end"]) for t in trunks.as_py() or ()}
                for end in ends.as_py():
                    path, at = [], end["segment"]
                    while at >= 0:
                        path.append(segments[at])
                        at = segments[at]["parent"]
                    path.reverse()
                    last = path[-1]
                    outside = [outer[i["piece"]] for i in last["ancestors"] if i["piece"] != name]
                    inside = [i for i in last["ancestors"] if i["piece"] == name] + [last]
                    said = [t[0] for t in outside] + [own[i["start"] : i["end"]] for i in inside]
                    total = sum(t[1] for t in outside) + sum(int(ids[i["start"] : i["end"]].sum(dtype=np.int64)) for i in inside)
                    loss = "".join(unescape(x) for x in [*(t[a:b] for t, _, a, b in outside), *(own[s["loss_start"] : s["loss_end"]] for s in path)])
                    alone = "".join(said)
                    turns = read_turns(alone)
                    words = "".join(f"{role}\n{t}\n" for role, t in turns)
                    out.append((end["key"], len(turns), hashlib.sha256(words.encode("utf-8")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(alone), total))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in SAID.split(", ")])

    return map_texts(joined, task, SAID)


def formatted(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = 64) -> DataFrame:
    """All conversations, formatted in prefix trees and read back: id and the columns of :func:`read_back`.

    Equal conversations are written once. Null roles and texts are as empty ones, null ids are one
    conversation, repeated rows are turns of their own, and an empty table gives no rows. A
    conversation is held in one task, as is a piece of at most about twice ``most`` conversations.
    """
    ids, distinct = distinct_conversations(turns, id_col, turn_col, role_col, text_col)
    said = near(checkpointed(read_back(written(trees(distinct, most)))))  # a few hundred bytes for each different conversation
    return ids.join(said, "key").drop("key").withColumnRenamed("id", id_col)
