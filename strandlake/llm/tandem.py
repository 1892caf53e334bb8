"""Periodic runs of words, by the linear method of Gusfield and Stoye for tandem repeats.

A tandem repeat (square) is a sequence of words written twice in a row. For a sequence:

1. A suffix tree is built from left to right (Ukkonen); the suffixes that it holds back at each
   step also tell where the blocks of the Lempel-Ziv factorisation end.
2. The leftmost place of every square has its middle in one block and reaches no further than the next,
   so extensions around the block's ends, found by prefix matching, give a set of squares that
   covers all leftmost places (each stands for its rotations to the right).
3. The covering squares are marked in the tree, bottom up, each node looking only at its first leaf's
   squares. From a mark, the suffix link and one more word lead to the next rotation, if the tree has it;
   these walks end at marks, and mark the whole vocabulary of squares.
4. The leaves below a mark are the places of that square. Places of one period that follow each other
   merge into a run.

Only squares of primitive words are kept: they make the same runs, and have at most n log n places.

A run of at least ``exponent`` periods holds every pair of neighbouring words at least ``exponent`` - 1
times. Stretches of a text that can't hold such a run are therefore told by counting pairs before a tree is built;
what is left goes through the method whole. Time and memory are linear in the stretch (about 400 bytes a word).
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, map_texts, slices


class SuffixTree:
    """Suffix tree of ``words`` (numbers from 0) and an end mark, with suffix links. Node 0 is the root.

    A node's words are ``words[start : start + depth]``; ``child`` is keyed by node * width + word. ``blocks``:
    the ends of the Lempel-Ziv blocks, each the longest sequence that begins further left too (or one new word).
    """

    def __init__(self, words: list[int]):
        n = len(words)
        text = [*words, max(words, default=0) + 1]
        self.text, self.width = text, text[-1] + 1
        first, last, link, child = [0], [0], [0], {}  # of the edge above each node; last is None at leaves
        width, blocks, begun = self.width, [], 0
        node, edge, length, held = 0, 0, 0, 0
        for i, word in enumerate(text):
            held, fresh = held + 1, 0
            while held:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(i), last.append(None), link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    end = last[below]
                    size = (i + 1 if end is None else end) - first[below]
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    if text[first[below] + length] == word:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    at, leaf = first[below], len(first) + 1
                    split = leaf - 1
                    first += (at, i)
                    last += (at + length, None)
                    link += (0, 0)
                    child[key] = split
                    child[split * width + text[at + length]] = below
                    child[split * width + word] = leaf
                    first[below] = at + length
                    if fresh:
                        link[fresh] = split
                    fresh = split
                held -= 1
                if not node and length:
                    length, edge = length - 1, i - held + 1
                elif node:
                    node = link[node]
            # What begins at i + 1 - held is the longest suffix that occurs further left: a block that began before it ends here.
            while begun < min(n, i + 1 - held):
                begun = max(i, begun + 1)
                blocks.append(begun)
        if begun < n:
            blocks.append(n)
        self.child, self.link, self.blocks = child, link, blocks
        count = len(first)
        parent, depth, start = [0] * count, [0] * count, [0] * count
        down: list[list[int]] = [[] for _ in range(count)]
        for key, below in child.items():
            down[key // width].append(below)
        order, stack = [], [0]
        while stack:
            at = stack.pop()
            order.append(at)
            d = depth[at]
            for below in down[at]:
                parent[below] = at
                end = last[below]
                depth[below] = d + (n + 1 if end is None else end) - first[below]
                start[below] = first[below] - d
                stack.append(below)
        self.parent, self.depth, self.start, self.down, self.order = parent, depth, start, down, order


def prefix_matches(s: list[int]) -> list[int]:
    """How far ``s`` equals itself from each of its places on (the Z function)."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def matches_of(pattern: list[int], text: list[int]) -> list[int]:
    """How far ``pattern`` equals ``text`` from each of its places on."""
    return prefix_matches([*pattern, -1, *text])[len(pattern) + 1 :]


def _factors(most: int) -> list[int]:
    """The smallest prime factor of each number."""
    out = list(range(most + 1))
    for p in range(2, int(most**0.5) + 1):
        if out[p] == p:
            for q in range(p * p, most + 1, p):
                if out[q] == q:
                    out[q] = p
    return out


def covering(words: list[int], ends: list[int]) -> set[tuple[int, int]]:
    """(start, period) of primitive squares that cover the leftmost places of all of them; ``ends``: of the Lempel-Ziv blocks."""
    n, out, begin = len(words), set(), 0
    factor = _factors(n)

    def primitive(k: int, start: int, low: list[int], high: list[int]) -> bool:
        """Whether the square has no smaller period that divides k: that one's stretch, from low to high, would hold the square."""
        rest = k
        while rest > 1:
            p = factor[rest]
            while not rest % p:
                rest //= p
            if low[k // p] <= start and high[k // p] >= start + 2 * k:
                return False
        return True

    for i, end in enumerate(ends):
        size = end - begin
        if end < n:
            # First halves within the block, second halves that go on behind it: from its end, compared with `end - k`.
            ahead = matches_of(words[end : end + size], words[begin : end + size])
            behind = prefix_matches(words[max(0, end - 1 - 3 * size) : end][::-1])
            low = [end - k - (behind[k] if k < len(behind) else 0) for k in range(size + 1)]
            high = [end, *[end + ahead[size - k] for k in range(1, size + 1)]]
            for k in range(1, size + 1):
                start = low[k] if low[k] > end - 2 * k else end - 2 * k + 1
                if start + 2 * k <= high[k] and start <= end - k and primitive(k, start, low, high):
                    out.add((start, k))
        if begin:
            # First halves that begin before the block and end in it, second halves up to the end of the next block: from its start, compared with `begin + k`.
            most = (ends[i + 1] if i + 1 < len(ends) else end) - begin
            ahead = prefix_matches(words[begin : begin + 3 * most + 1])
            left = max(0, begin - 1 - 2 * most)
            behind = matches_of(words[left:begin][::-1], words[left : begin + most][::-1])
            low = [begin, *[begin - behind[most - k] for k in range(1, most + 1)]]
            high = [begin + k + (ahead[k] if k < len(ahead) else 0) for k in range(most + 1)]
            for k in range(1, most + 1):
                start = low[k] if low[k] > begin - k else begin - k + 1
                if start + 2 * k <= high[k] and start < begin and start <= end - k and primitive(k, start, low, high):
                    out.add((start, k))
        begin = end
    return out


def vocabulary(tree: SuffixTree, seeds: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """(node, length) of every square in the tree that rotations of ``seeds`` lead to; the square ends on the edge above the node, or at it."""
    text, width, child, link = tree.text, tree.width, tree.child, tree.link
    parent, depth, start = tree.parent, tree.depth, tree.start
    lists: dict[int, list[int]] = {}
    for at, k in sorted(seeds, key=lambda s: s[1]):
        lists.setdefault(at, []).append(2 * k)
    first, marks = [len(text)] * len(parent), []
    for v in reversed(tree.order):
        if not tree.down[v]:
            first[v] = start[v]
        if not v:
            break
        u = parent[v]
        own = lists.get(first[v])
        if own:
            above = depth[u]
            while own and own[-1] > above:
                marks.append((v, own.pop()))
        if first[v] < first[u]:
            first[u] = first[v]
    known: set[tuple[int, int]] = set(marks)
    for v, d in marks:
        while True:
            s, u = start[v], parent[v]
            node = link[u] if u else 0
            while depth[node] < d - 1:
                node = child[node * width + text[s + 1 + depth[node]]]
            if depth[node] == d - 1:
                node = child.get(node * width + text[s])
                if node is None:
                    break
            elif text[start[node] + d - 1] != text[s]:
                break
            if (node, d) in known:
                break
            known.add((node, d))
            v = node
    return known


def located(tree: SuffixTree, squares: set[tuple[int, int]]) -> np.ndarray:
    """Rows (start, length, period) of the runs that the places of ``squares`` merge into, by start, then period."""
    if not squares:
        return np.empty((0, 3), np.int64)
    low, high, leaves = [0] * len(tree.order), [0] * len(tree.order), []
    # `order` visits a node before what is below it, and all of that before anything else.
    for v in tree.order:
        low[v] = len(leaves)
        if not tree.down[v]:
            leaves.append(tree.start[v])
    for v in reversed(tree.order):
        high[v] = max([high[x] for x in tree.down[v]], default=low[v] + 1)
    marks = np.array([(low[v], high[v], d // 2) for v, d in squares], np.int64)
    sizes = marks[:, 1] - marks[:, 0]
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.array(leaves, np.int64)[np.repeat(marks[:, 0], sizes) + inside]
    n = len(tree.text) + 1
    keys = np.sort(np.repeat(marks[:, 2], sizes) * n + places)
    begins = np.concatenate([[True], np.diff(keys) != 1])
    start, period = keys[begins] % n, keys[begins] // n
    end = keys[np.concatenate([begins[1:], [True]])] % n + 2 * period
    out = np.stack([start, end - start, period], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs(words: list[int]) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least two periods of a sequence of numbers, by start, then period."""
    tree = SuffixTree(words)
    seeds = covering(words, tree.blocks)
    return located(tree, vocabulary(tree, seeds)) if seeds else np.empty((0, 3), np.int64)


def stretches(numbers: np.ndarray, text: np.ndarray, exponent: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of what may hold runs of at least ``exponent`` periods and ``least`` words; ``text``: the text of each word.

    Each pair of neighbours within such a run occurs ``exponent`` - 1 times in its text at least.
    """
    n = len(numbers)
    if n < max(2, least):
        return
    pairs = numbers[:-1].astype(np.int64) * (int(numbers.max()) + 1) + numbers[1:]
    inside = text[:-1] == text[1:]
    order = np.lexsort((pairs, text[:-1]))
    same = (pairs[order][1:] == pairs[order][:-1]) & (text[:-1][order][1:] == text[:-1][order][:-1])
    group = np.cumsum(np.concatenate([[0], ~same]))
    often = np.empty(n - 1, bool)
    often[order] = np.bincount(group)[group] >= exponent - 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], often & inside, [False]])))
    for a, b in edges.reshape(-1, 2).tolist():
        if b + 1 - a >= least:
            yield a, b + 1


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query's documents: of every tenth, by the checksum of its id, the last part repeats itself."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapse(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """``words`` without what any of the runs (start, length, period) holds after its first period."""
    if not len(found):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def texts_runs(texts: list[list[bytes]], exponent: int = 4, least: int = 6) -> list[np.ndarray]:
    """For each text (a list of words) the rows (start, length, period) of its runs with at least ``exponent`` periods and ``least`` words."""
    flat = [w for t in texts for w in t]
    empty = np.empty((0, 3), np.int64)
    out = [[] for _ in texts]
    if flat:
        numbers = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = (np.cumsum(sizes) - sizes).tolist()
        for a, b in stretches(numbers, np.repeat(np.arange(len(texts)), sizes), exponent, least):
            _, own = np.unique(numbers[a:b], return_inverse=True)
            found = runs(own.tolist())
            found = found[found[:, 1] >= np.maximum(least, exponent * found[:, 2])]
            if len(found):
                t = bisect_right(begins, a) - 1
                while not len(texts[t]):
                    t -= 1
                found[:, 0] += a - begins[t]
                out[t].append(found)
    return [np.concatenate(x) if x else empty for x in out]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6, change: Callable | None = None) -> DataFrame:
    """For every row: its id, how many runs its text has, the one of most periods, and digests of all runs and of the text without them.

    A run is a longest stretch of words with a smallest period q that has at least ``least`` words and
    ``exponent`` periods. ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the run with the greatest length / period
    (ties: smallest start, then period), null if there are none. ``collapsed`` texts lack what a run holds
    after its first period. ``change(words, id)`` may alter the words first. Null texts have no words; repeated rows
    come out repeatedly, each judged alone; null ids stay; an empty table gives no rows; further columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(OUT).fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id").to_pylist()
                texts = [t.split() if t else [] for t in as_bytes(part.column("text"))]
                if change:
                    texts = [change(t, i) for t, i in zip(texts, ids)]
                made = [[] for _ in range(7)]
                for words, found in zip(texts, texts_runs(texts, exponent, least)):
                    best = [None] * 4
                    if len(found):
                        best = None
                        for s, n, q in found.tolist():
                            if best is None or n * best[2] > best[1] * q:
                                best = [s, n, q]
                        best.append(1000 * best[1] // best[2])
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
                    digests = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(collapse(words, found)))]
                    for column, value in zip(made, (len(found), *best, *digests)):
                        column.append(value)
                arrays = [pa.array(c, f) for c, f in zip(made, [pa.int64()] * 5 + [pa.string()] * 2)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], schema.names)

    return map_texts(rows, task, schema)
