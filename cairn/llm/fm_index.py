"""An FM-index over a wavelet matrix, for one shard of texts at a time; runs inside tasks."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector per bit of a symbol, packed in words with running counts."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        s = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            words[: len(packed)] = packed
            words = words.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        every = np.arange(n_symbols)
        self.first = self._descend(every, np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            word, rest = i >> 6, (i & 63).astype(np.uint64)
            below = (np.uint64(1) << rest) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & below)
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, i) - self.first[symbol]


def suffix_order(s: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions sorted by the ``depth`` or more symbols that follow (symbols under 2^21), and the ranks by 1, 3, 6, 12, ... symbols."""
    n = len(s)
    at = lambda a, k: np.concatenate([a[k:], np.zeros(min(k, n), a.dtype)])
    s = s.astype(np.int64)
    levels = [(1, s)]
    key, length = (s << 42) | (at(s, 1) << 21) | at(s, 2), 3
    while True:
        order = np.argsort(key, kind="stable" if n < 2 else "quicksort")
        k = key[order]
        rank = np.empty(n, np.int64)
        new = np.concatenate([[1], (k[1:] != k[:-1]).astype(np.int64)])
        rank[order] = np.cumsum(new)
        levels.append((length, rank))
        if length >= depth or rank.max() == n:
            return order, levels
        key, length = rank * (n + 1) + at(rank, length), length * 2


def shared_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The number of equal leading symbols of each sorted position and the one before it (0 for the first)."""
    n = len(order)
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for length, rank in reversed(levels):
        for _ in range(2):  # lengths 1, 3, 6, ...: one step of the lowest may be taken twice
            inside = (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            common[same] += length
            a[same] += length
            b[same] += length
            if length > 1:
                break
    return np.concatenate([[0], common])


class FMIndex:
    """Matching statistics of streamed texts against indexed texts that belong to other owners.

    texts: the indexed texts as arrays of code points; owners: an integer for each. An owner of -1 stands for several:
    what lies in such a text is another's for everybody. Answers hold for matches of up to ``depth`` code points.
    """

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, depth: int):
        lengths = np.array([len(t) for t in texts])
        points = np.concatenate([np.append(t.astype(np.int64) + 1, 0) for t in texts])  # 0 ends a text
        self.alphabet, s = np.unique(points, return_inverse=True)
        s = s.astype(np.int64)
        order, levels = suffix_order(s, depth)
        self.n = len(s)
        self.lcp = np.append(shared_prefixes(order, levels), -1).astype(np.int32)
        self.lcp[0] = -1
        self.bwt = WaveletMatrix(s[order - 1], len(self.alphabet))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(self.alphabet)))])
        owner = np.repeat(owners, lengths + 1)[order]
        change = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        nxt = np.append(change, self.n)
        self.next_owner = nxt[np.searchsorted(change, np.arange(self.n), "right")]
        self.owner = owner
        # minima of the prefix lengths over blocks of 2^j entries, for finding where a wider interval ends
        self.minima = [self.lcp]
        while (1 << len(self.minima)) <= self.n:
            m, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(m[:-half], m[half:]))

    def _widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first ``length`` symbols of what the interval [lo, hi) stands for."""
        for j in range(len(self.minima) - 1, -1, -1):
            m, step = self.minima[j], 1 << j
            start = lo - step + 1
            ok = (start >= 0) & (m[np.maximum(start, 0)] >= length)
            lo = np.where(ok, lo - step, lo)
            ok = (hi < len(m)) & (m[np.minimum(hi, len(m) - 1)] >= length)
            hi = np.where(ok, hi + step, hi)
        return lo, hi

    def matches(self, texts: list[np.ndarray], owners: np.ndarray, least: int) -> list[np.ndarray]:
        """For each text, the positions at which a match of ``least`` or more code points with another owner's text begins.

        All texts are read from right to left in lockstep. Each holds the interval of the longest match that begins at
        its last position; one more code point on the left is a step of backward search, and where no other owner has
        it the match is cut on the right to the next shorter one that more suffixes share.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(lengths)])
        points = np.concatenate(texts).astype(np.int64) + 1
        code = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        code = np.where(self.alphabet[code] == points, code, -1)
        found = np.zeros(len(points), bool)
        lane = np.flatnonzero(lengths > 0)
        pos, lo, hi = lengths[lane].copy(), np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        size = np.zeros(len(lane), np.int64)
        while len(lane):
            c = code[base[lane] + pos - 1]
            known = np.maximum(c, 0)
            r = self.bwt.rank(np.concatenate([known, known]), np.concatenate([lo, hi]))
            lo2, hi2 = self.smaller[known] + r[: len(lane)], self.smaller[known] + r[len(lane) :]
            inside = np.minimum(lo2, self.n - 1)
            other = self.owner[inside]
            ok = (c >= 0) & (hi2 > lo2) & ((other != owners[lane]) | (other == -1) | (self.next_owner[inside] < hi2))
            # longer: the match grows to the left
            lo, hi = np.where(ok, lo2, lo), np.where(ok, hi2, hi)
            size = size + ok
            stuck = ~ok & (size == 0)
            pos = pos - (ok | stuck)
            hit = ok & (size >= least)
            found[base[lane[hit]] + pos[hit]] = True
            # shorter: what remains is the longest prefix of the match that occurs more widely
            cut = np.flatnonzero(~ok & (size > 0))
            if len(cut):
                less = np.maximum(self.lcp[lo[cut]], self.lcp[hi[cut]]).astype(np.int64)
                less = np.where(c[cut] < 0, 0, np.minimum(np.maximum(less, 0), size[cut] - 1))
                wide_lo, wide_hi = self._widen(lo[cut], hi[cut], np.maximum(less, 1))
                lo[cut], hi[cut] = np.where(less > 0, wide_lo, 0), np.where(less > 0, wide_hi, self.n)
                size[cut] = less
            # nothing further left can reach the length any more
            go = (pos > 0) & (size >= least - pos)
            if not go.all():
                lane, pos, lo, hi, size = lane[go], pos[go], lo[go], hi[go], size[go]
        return [np.flatnonzero(found[a:b]) for a, b in zip(base, base[1:])]
