"""A compressed FM-index over many short word sequences, in numpy.

The Burrows-Wheeler transform of the sequences is kept as a wavelet matrix:
one bit vector a level with counts every 64 bits.  Backward search runs for
many streamed sequences side by side, a word at a time, and keeps each one's
matching statistic: the length, up to ``size``, of the longest match that
begins at its place.  Where the next word does not fit, the match gives up
words at its far end until it does.  ``window_minima`` reports the intervals
where the statistic reaches ``size``, with the smallest owner of the match.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(((len(bits) >> 6) + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits]] = []
        s = symbols
        for shift in range(levels - 1, -1, -1):
            bit = (s >> shift) & 1
            self.levels.append((shift, Bits(bit.astype(np.uint8))))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` lies once all symbols are sorted apart, followed along ``symbol``."""
        for shift, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1, bits.zeros + ones, at - ones)
        return at


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    return np.unique(first.astype(np.int64) * (int(second.max()) + 1) + second, return_inverse=True)[1]


class FmIndex:
    """Over ``symbols`` split into sequences of ``lens`` with an owner number each."""

    def __init__(self, symbols: np.ndarray, lens: np.ndarray, owners: np.ndarray, size: int = 13):
        if not 9 <= size <= 16:
            raise ValueError("windows of 9 to 16 words are supported")
        self.size = size
        alphabet, dense = np.unique(symbols, return_inverse=True)
        self.alphabet = alphabet
        ends = np.cumsum(lens + 1)
        self.starts = ends - lens - 1
        n = int(ends[-1])
        text = np.zeros(n, np.int64)  # 0 ends a sequence
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        text[inside] = dense + 1
        owner = np.repeat(owners, lens + 1)
        ahead = lambda r, d: np.concatenate([r[d:], np.zeros(min(d, n), r.dtype)])[:n]
        r1 = text
        r2 = _ranks(r1, ahead(r1, 1)) + 1
        r4 = _ranks(r2, ahead(r2, 2)) + 1
        r8 = _ranks(r4, ahead(r4, 4)) + 1
        order = np.lexsort((ahead(r8, 8), r8))  # sorted by 16 words: enough for windows
        self.text, self.order = text, order
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(alphabet) + 1))])
        levels = max(1, int(len(alphabet)).bit_length())
        self.bwt = WaveletMatrix(text[order - 1], levels)
        self.origin = self.bwt.descend(np.arange(len(alphabet) + 1), np.zeros(len(alphabet) + 1, np.int64))

        # Common words of neighbours in the order, up to 15.
        same = np.zeros(n, np.int64)
        for width, ranks in ((8, r8), (4, r4), (2, r2), (1, r1)):
            at = np.minimum(order + same, n - 1)
            before = np.minimum(np.roll(order, 1) + same, n - 1)
            same += width * (ranks[at] == ranks[before])
        same[0] = 0
        self.same, self.n, self._starts = same, n, {}
        self.minima = np.minimum.reduceat(owner[order], self.starts_at(size))

    def starts_at(self, depth: int) -> np.ndarray:
        """Where the intervals of sequences with ``depth`` equal first words begin."""
        if depth not in self._starts:
            cut = self.same < depth
            cut[0] = True
            self._starts[depth] = np.flatnonzero(cut)
        return self._starts[depth]

    def widen(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals around positions that share their first ``depth`` words."""
        if depth == 0:
            return np.zeros(len(at), np.int64), np.full(len(at), self.n)
        starts = self.starts_at(depth)
        k = np.searchsorted(starts, at, "right")
        return starts[k - 1], np.append(starts, self.n)[k]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the matches with ``symbol`` put before them."""
        base = self.counts[symbol] - self.origin[symbol]
        return base + self.bwt.descend(symbol, lo), base + self.bwt.descend(symbol, hi)

    def window_minima(self, symbols: np.ndarray, lens: np.ndarray, nowhere: int = -1) -> np.ndarray:
        """For streamed sequences of ``lens``: the smallest owner of each window of ``size`` words, ``nowhere`` where it has none.

        A row per sequence, a column per window.
        """
        q = len(lens)
        out = np.full((q, max(0, int((lens - self.size + 1).max()))), nowhere, np.int64)
        place = np.searchsorted(self.alphabet, symbols)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == symbols
        dense = np.where(known, place + 1, 0)
        first = np.cumsum(lens) - lens
        lo, hi, depth = np.zeros(q, np.int64), np.full(q, self.n), np.zeros(q, np.int64)
        for back in range(1, int(lens.max()) + 1):
            live = np.flatnonzero(lens >= back)
            symbol = dense[first[live] + lens[live] - back]
            lost = live[symbol == 0]  # a word of no indexed sequence ends every match
            lo[lost], hi[lost], depth[lost] = 0, self.n, 0
            live, symbol = live[symbol != 0], symbol[symbol != 0]
            while len(live):
                a, b = self.step(symbol, lo[live], hi[live])
                fits = a < b
                done = live[fits]
                lo[done], hi[done], depth[done] = a[fits], b[fits], depth[done] + 1
                full = done[depth[done] == self.size]
                if len(full):
                    out[full, lens[full] - back] = self.minima[np.searchsorted(self.starts_at(self.size), lo[full], "right") - 1]
                    lo[full], hi[full] = self.widen(lo[full], self.size - 1)
                    depth[full] = self.size - 1
                live, symbol = live[~fits], symbol[~fits]
                for d in np.unique(depth[live]).tolist():  # give up the last word and try again
                    some = live[depth[live] == d]
                    lo[some], hi[some] = self.widen(lo[some], d - 1)
                depth[live] -= 1
        return out
