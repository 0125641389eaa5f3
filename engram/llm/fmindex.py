"""A compressed FM-index over word ids: wavelet tree, marks of common prefixes, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """A bit vector with rank: 64 bits a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class Marks:
    """A bit vector that finds the one at or before a place, and the next one after it; place 0 and the end are ones."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        pad[[0, len(bits)]] = 1
        self.words = np.packbits(pad, bitorder="little").view("<u8")
        some, at = self.words != 0, np.arange(len(self.words), dtype=np.int32)
        self.left = np.maximum.accumulate(np.where(some, at, np.int32(0)))
        self.right = np.minimum.accumulate(np.where(some, at, np.int32(len(at) - 1))[::-1])[::-1]

    def before(self, i: np.ndarray) -> np.ndarray:
        """The last one at or before i."""
        w = i >> 6
        own = self.words[w] & (~U64(0) >> (U64(63) - (i & 63).astype(U64)))
        w = np.where(own == 0, self.left[np.maximum(w - 1, 0)], w)
        x = np.where(own == 0, self.words[w], own)
        for k in (1, 2, 4, 8, 16, 32):
            x = x | (x >> U64(k))
        return w.astype(np.int64) * 64 + np.bitwise_count(x) - 1

    def after(self, i: np.ndarray) -> np.ndarray:
        """The first one after i, for i before the end."""
        i = i + 1
        w = i >> 6
        own = self.words[w] & (~U64(0) << (i & 63).astype(U64))
        w = np.where(own == 0, self.right[np.minimum(w + 1, len(self.right) - 1)], w)
        x = np.where(own == 0, self.words[w], own)
        return w.astype(np.int64) * 64 + np.bitwise_count((x & (~x + U64(1))) - U64(1))


class WaveletTree:
    """A sequence of small numbers as one bit vector for each of their bits, highest first."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for k in range(self.depth - 1, -1, -1):
            bit = ((values >> k) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        # where each symbol's run starts on the lowest level
        self.first = np.searchsorted(_reversed_bits(values, self.depth), _reversed_bits(np.arange(sigma), self.depth)) if len(values) else np.zeros(sigma, np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before place i, for arrays of both."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.depth - 1 - level)) & 1
            r = bits.rank(i)
            i = np.where(one == 1, zeros + r, i - r)
        return i - self.first[symbol]


def _reversed_bits(values: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    v = values.astype(np.int64)
    for _ in range(depth):
        out = (out << 1) | (v & 1)
        v >>= 1
    return out


class FMIndex:
    """Index of sequences of word ids for patterns of up to `length` words.

    sequences holds ids from 1 to sigma - 1, sizes[k] of them for each sequence; owners are numbers of the sequences. Suffixes
    are in order of their first `length` words (a k-BWT, Navarro and Petri et al.), which is all that such patterns need. Kept are the
    wavelet tree of the words before the suffixes, how many words are below each id, a bit for each suffix and
    shorter length that marks where the first so many words change, and each suffix's owner in 32 bits.
    Neither the sequences nor the suffix order are kept: a pattern can only be found by the search.
    """

    def __init__(self, sequences: np.ndarray, sizes: np.ndarray, owners: np.ndarray, sigma: int, length: int):
        self.length, self.sigma = length, sigma
        starts = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + len(sizes)
        text = np.zeros(n, np.int64)  # 0 ends each sequence
        text[np.repeat(starts, sizes) + np.arange(n - len(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = sequences
        rank, have = text, 1
        while have < length:
            step = min(have, length - have)
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:]
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)
            have += step
        order = np.argsort(rank, kind="stable")
        self.n = n
        self.owner = np.repeat(owners, sizes + 1).astype(np.int32)[order]
        padded = np.concatenate([text, np.zeros(length, np.int64)])
        same, self.marks = np.ones(max(n - 1, 0), bool), []
        for k in range(length):
            self.marks.append(Marks(np.concatenate([[True], ~same])))  # of the first k words
            same = same & (padded[order[1:] + k] == padded[order[:-1] + k])
        self.tree = WaveletTree(text[order - 1], sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)

    def extend(self, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of symbol + pattern from those of the patterns; empty for a symbol that no sequence has."""
        base = self.below[symbol]
        return base + self.tree.rank(symbol, begin), base + self.tree.rank(symbol, end)

    def shorten(self, begin: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges and lengths of the patterns without their last word."""
        b, e, less = np.empty_like(begin), np.empty_like(begin), have - 1
        for k in np.unique(less):
            at = less == k
            b[at], e[at] = self.marks[k].before(begin[at]), self.marks[k].after(begin[at])
        return b, e, less

    def matches(self, starts: np.ndarray, sizes: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of sequences of a stream: for each place the length of the longest match from there, up to
        `length`, and the range of suffixes that begin with it. Numbers that no sequence has match nowhere.

        Sequences are read from their ends, all at once: the word in front is put before the match; where that fits nowhere,
        or the match has full length, the match loses its last word first.
        """
        total = int(sizes.sum())
        long, low, high = (np.zeros(total, np.int64) for _ in range(3))
        at = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, at = starts[order], sizes[order], at[order]
        begin, end = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        have = np.zeros(len(sizes), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -back, "right"))
            full = np.flatnonzero(have[:live] == self.length)
            begin[full], end[full], have[full] = self.shorten(begin[full], have[full])
            symbol = stream[starts[:live] + sizes[:live] - back]
            lanes = np.arange(live)
            while len(lanes):
                b, e = self.extend(symbol[lanes], begin[lanes], end[lanes])
                fits = e > b
                to = lanes[fits]
                begin[to], end[to], have[to] = b[fits], e[fits], have[to] + 1
                lanes = lanes[~fits]
                lanes = lanes[have[lanes] > 0]  # an empty match stays empty
                if len(lanes):
                    begin[lanes], end[lanes], have[lanes] = self.shorten(begin[lanes], have[lanes])
            to = at[:live] + sizes[:live] - back
            long[to], low[to], high[to] = have[:live], begin[:live], end[:live]
        return long, low, high

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner in each range. Ranges of full-length matches are equal or apart, so all cost one pass at most."""
        heads, which = np.unique(low, return_index=True)
        if not len(heads):
            return np.zeros(0, np.int32)
        edges = np.stack([heads, high[which]], 1).ravel()
        least = np.minimum.reduceat(np.append(self.owner, np.int32(np.iinfo(np.int32).max)), edges)[::2]
        return least[np.searchsorted(heads, low)]
