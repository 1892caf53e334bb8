"""A compressed full-text index (FM-index) over sequences of words, its ranks in a wavelet matrix.

The index holds bit planes with their counts, and every 16th place of the text; the suffix array and the
text itself are needed only while it is built. All work on many patterns at once, as array operations.
"""

from __future__ import annotations

import numpy as np

#: One text place in so many is kept, and found again by walking back at most as far.
SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order, by doubling the length that is compared until all differ.

    A suffix that is the start of another comes before it.
    """
    n = len(symbols)
    bits = int(symbols.max(initial=0) + 1).bit_length()
    width = max(1, 63 // bits)
    padded = np.concatenate([symbols.astype(np.uint64) + np.uint64(1), np.zeros(width, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = key << np.uint64(bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    while n:
        sorted_ = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
        if rank[order[-1]] == n - 1 or width >= n:
            break
        after = np.zeros(n, np.uint64)
        after[: n - width] = rank[width:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + after
        order, width = np.argsort(key, kind="stable"), 2 * width
    return order


class Bits:
    """A bit vector with counted ones."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def at(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Bit planes of a sequence of numbers, the highest first, each sorted stably by the planes above."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.planes, self.zeros = [], []
        s = symbols
        for level in reversed(range(self.levels)):
            one = (s >> level & 1).astype(bool)
            self.planes.append(Bits(one))
            self.zeros.append(len(s) - int(one.sum()))
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each symbol's run begins in the sorted sequence, plus how often it stands before the place."""
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.ones(at)
            at = np.where(symbol >> (self.levels - 1 - level) & 1, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and their :meth:`rank` there."""
        symbol = np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros):
            one, ones = plane.at(at), plane.ones(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at


class FMIndex:
    """Index of texts of numbers from 0 to ``kinds`` - 1, which lie one after the other, each with an end of its own."""

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, kinds: int):
        many = len(lengths)
        self.shift, self.kinds = many, kinds
        n = len(texts) + many
        #: Where each text begins, ends counted.
        self.begins = np.cumsum(lengths + 1) - lengths - 1
        symbols = np.empty(n, np.int64)
        symbols[self.begins + lengths] = np.arange(many)
        symbols[np.arange(len(texts)) + np.repeat(np.arange(many), lengths)] = texts + many
        places = suffix_array(symbols)
        kept = places % SAMPLE == 0
        self.marks, self.samples = Bits(kept), places[kept].astype(np.int32)
        self.matrix = WaveletMatrix(symbols[places - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=many + kinds))]).astype(np.int64)
        every = np.arange(many + kinds)
        self.base = self.matrix.rank(every, np.zeros(len(every), np.int64))
        self.n = n

    def matches(self, words: np.ndarray, ends: np.ndarray, length: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics by backward search: how far before each of ``ends`` the ``words`` occur in the index.

        Words that the index doesn't know are negative. Returns for each end how many words back (``length`` at
        most) they still occur ``least`` times, and the interval of suffixes that begin so.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        reached = np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        for back in range(1, length + 1):
            c = words[ends[active] - back]
            active, c = active[c >= 0], c[c >= 0] + self.shift
            both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([low[active], high[active]]))
            step = self.first[c] - self.base[c]
            a, b = both[: len(c)] + step, both[len(c) :] + step
            on = b - a >= least
            active = active[on]
            if not len(active):
                break
            low[active], high[active], reached[active] = a[on], b[on], back
        return reached, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text where the suffixes at ``rows`` of the order begin."""
        at, out = rows.astype(np.int64), np.empty(len(rows), np.int64)
        active, steps = np.arange(len(rows)), 0
        while len(active):
            known = self.marks.at(at[active])
            done = active[known]
            out[done] = self.samples[self.marks.ones(at[done])] + steps
            active = active[~known]
            symbol, rank = self.matrix.access(at[active])
            at[active] = self.first[symbol] + rank - self.base[symbol]
            steps += 1
        return out

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in the text of the suffixes in each interval (none is empty)."""
        lows, which = np.unique(low, return_index=True)
        sizes = high[which] - lows
        begin = np.cumsum(sizes) - sizes
        places = self.locate(np.arange(sizes.sum()) + np.repeat(lows - begin, sizes))
        return (np.minimum.reduceat(places, begin) if len(begin) else places)[np.searchsorted(lows, low)]
