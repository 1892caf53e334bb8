"""Packing of examples into training sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_texts, slices

SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, padding long, ids binary"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most: tokens, segments (pieces), loss-bearing tokens."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


@dataclass(frozen=True)
class Piece:
    example: int
    start: int
    length: int
    loss: int


def place(tokens: np.ndarray, prefix: np.ndarray, limits: Limits = Limits()) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of every example once.

    ``tokens[i]``: number of tokens of example i. ``prefix[i]``: how many of its first tokens bear
    no loss (the prompt); all later ones do.

    Each sequence is filled greedily. Among the examples (or what is left of them) that fit under
    all three limits, the one whose demand has the largest dot product with the sequence's free
    capacity goes in, both as shares of the limits; ties go to the earlier example. When none fits,
    the example with the largest dot product is cut so that the sequence becomes full. A sequence
    that no example is left to fill is cut at powers of two, so it needs no padding.
    Examples without tokens get no piece.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
    left, start, bare = tokens.astype(np.int64), np.zeros(len(tokens), np.int64), prefix.astype(np.int64)
    loss = np.maximum(left - bare, 0)
    alive = np.flatnonzero(left > 0)
    done: list[list[Piece]] = []

    def cut(i: int, n: int) -> Piece:
        borne = int(max(0, min(loss[i], n - max(0, left[i] - loss[i]))))
        piece = Piece(i, int(start[i]), n, borne)
        start[i] += n
        left[i] -= n
        loss[i] -= borne
        return piece

    # Whole sequences out of one long example need no search.
    for i in alive[left[alive] >= limits.tokens]:
        while left[i] >= limits.tokens:
            bare_left = left[i] - loss[i]
            n = int(min(limits.tokens, bare_left + limits.loss))
            done.append([cut(i, n)])
    alive = alive[left[alive] > 0]
    live = np.zeros(len(tokens), bool)
    live[alive] = True
    while alive.size:
        free, seq = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64), []
        while alive.size and free[0] and free[1]:
            demand_t, demand_l = left[alive], loss[alive]
            score = demand_t * (free[0] / cap[0] ** 2) + demand_l * (free[2] / cap[2] ** 2) + free[1] / cap[1] ** 2
            fits = (demand_t <= free[0]) & (demand_l <= free[2])
            if fits.any():
                at = int(np.argmax(np.where(fits, score, -1.0)))
                n = int(demand_t[at])
            else:
                at = int(np.argmax(score))
                i = alive[at]
                n = int(min(free[0], left[i] - loss[i] + free[2]))
                if n <= 0:  # no example can add a token without loss, and the loss limit is reached
                    break
            i = int(alive[at])
            piece = cut(i, n)
            seq.append(piece)
            free -= (piece.length, 1, piece.loss)
            if not left[i]:
                alive = np.delete(alive, at)
        done.append(seq)
    out = []
    for seq in done:
        used = sum(p.length for p in seq)
        out += [seq] if used == limits.tokens else list(_binary(seq, used))
    return out


def _binary(seq: list[Piece], used: int) -> Iterator[list[Piece]]:
    """``seq`` cut into sequences whose lengths are the powers of two in ``used``."""
    rest = list(seq)
    for bit in reversed(range(used.bit_length())):
        room, part = used & (1 << bit), []
        while room:
            p = rest.pop(0)
            if p.length > room:
                bare = p.length - p.loss  # the tokens without loss come first
                a = max(0, room - bare)
                rest.insert(0, Piece(p.example, p.start + room, p.length - room, p.loss - a))
                p = Piece(p.example, p.start, room, a)
            part.append(p)
            room -= p.length
        if part:
            yield part


MARK, MARK_BETWEEN = b"\x01", b" \x01 "


class WordEncoder:
    """Token ids of texts, remembered by their words.

    Only for tokenizers that lower ASCII letters, drop white space, and split words into runs of letters,
    single digits and runs of other characters before they encode each by itself: the ids of a text
    are then those of its parts between ASCII white space, and those of a word that ends in a letter or
    digit and then stops, commas and the like are those of both. About ``most`` different words are
    remembered, the others are encoded again in each call.
    """

    STOPS = re.compile(rb"(?<=[0-9A-Za-z])[.,!?;:]+$", re.MULTILINE)

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {b"": b""}
        mark = self._ids(MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def cores(self, words: list[bytes]) -> list[bytes]:
        """Each word with ASCII letters lowered, without the stops behind a last letter or digit. Words that may hold special tokens stay as they are."""
        blob = b"\n".join(words)
        if b"<|" not in blob:
            return self.STOPS.sub(b"", blob.lower()).split(b"\n")
        return [w if b"<|" in w else self.STOPS.sub(b"", w.lower()) for w in words]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Many words make one text, a mark that is one token by itself between any two."""
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            if self.mark is not None and not any(MARK in w for w in some):
                ids = self._ids(MARK_BETWEEN.join(some))
                ends = np.flatnonzero(ids == self.mark)
                data = ids.tobytes()
                parts = [data[4 * a : 4 * b] for a, b in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)])]
                if len(parts) == len(some):
                    out += parts
                    continue
            out += [self._ids(w).tobytes() for w in some]
        return out

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype="<u4")

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        known = self.known
        split = [t.split() for t in texts]
        rare = set(chain.from_iterable(split)).difference(known)
        new: dict[bytes, bytes] = {}
        if rare:
            words = list(rare)
            cores = self.cores(words)
            whole = {w: (c, w[len(c) :]) for w, c in zip(words, cores) if len(w) != len(c)}
            wanted = list(set(cores).union([stops for _, stops in whole.values()]).difference(known))
            new.update(zip(wanted, self.encode(wanted)))
            known.update(new)
            whole = {w: known[c] + known[stops] for w, (c, stops) in whole.items()}
            whole.update((w, known[c]) for w, c in zip(words, cores) if w not in whole)
            new.update(whole)
            known.update(whole)
        out = [b"".join(map(known.get, words)) for words in split]
        if len(known) > self.most:
            for w in new:
                del known[w]
        return out


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[bytes]], list[bytes]]], id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), end_id: int | None = 2, chunk_rows: int = 4096, chunk_tokens: int = 4_000_000, with_ids: bool = False, prompt_tokens: str | None = None) -> DataFrame:
    """Pieces of all texts, packed. One row for each piece.

    ``encoder()`` is called once in each task and gives a function from UTF-8 texts to
    their little-endian 32-bit ids; ``end_id`` follows each text. ``prompt_tokens`` names a column with
    the number of first tokens that bear no loss (null or absent: 0).
    A task packs its rows in chunks of ``chunk_rows`` or ``chunk_tokens``, so memory is bounded and
    no shuffle is needed; ``sequence_id`` holds the task's number and a running number.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, padding
    (of the whole sequence, 0 at a power of two), and ids if ``with_ids``.
    Null text: as empty. A text without ids and no ``end_id`` has no piece. Repeated rows and rows
    with the same or a null id are packed each on its own. Other columns play no part.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    prompt = F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(0)) if prompt_tokens else F.lit(0).cast("long")
    wanted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), prompt.alias("prompt"))
    schema = SCHEMA.format(id=id_type)
    if not with_ids:
        schema = schema.removesuffix(", ids binary")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        number = TaskContext.get().partitionId() << 36
        ids: list[bytes] = []
        keys: list[pa.Array] = []
        prompts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            tokens = np.array([len(x) // 4 for x in ids], np.int64)
            seqs = place(tokens, np.minimum(np.concatenate(prompts), tokens), limits)
            example, start, length, loss, crc, sid, off, pad, raw = ([] for _ in range(9))
            for seq in seqs:
                at = 0
                used = sum(p.length for p in seq)
                padding = 0 if used & (used - 1) == 0 else limits.tokens - used
                for p in seq:
                    part = ids[p.example][4 * p.start : 4 * (p.start + p.length)]
                    example.append(p.example)
                    start.append(p.start)
                    length.append(p.length)
                    loss.append(p.loss)
                    crc.append(zlib.crc32(part))
                    sid.append(number)
                    off.append(at)
                    pad.append(padding)
                    if with_ids:
                        raw.append(part)
                    at += p.length
                number += 1
            key = pa.concat_arrays(keys).take(pa.array(example, pa.int64()))
            columns = [key, *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[np.array(example, int)], sid, off, loss, pad))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "padding"]
            if with_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in slices(batch, "text", rows=1024):
                new = [x + tail for x in encode(as_bytes(part.column("text")))]
                held += sum(map(len, new)) // 4
                ids += new
                keys.append(part.column("id"))
                prompts.append(part.column("prompt").to_numpy(zero_copy_only=False))
                if len(ids) >= chunk_rows or held >= chunk_tokens:
                    yield flush()
                    ids, keys, prompts, held = [], [], [], 0
        if ids:
            yield flush()

    return map_texts(wanted, task, schema).withColumnRenamed("doc_id", id_col)


@lru_cache(maxsize=1)
def _shared_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def word_encoder(path: str) -> Callable[[], WordEncoder]:
    """Makes encoders; a Python worker keeps its encoder, with the words it knows, from task to task."""
    return lambda: _shared_encoder(path)
