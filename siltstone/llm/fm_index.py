"""Compressed FM-index of one shard: wavelet matrix over the BWT, backward search, truncated matching statistics."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed in 64-bit words with a running count per word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n >> 6) + 1 << 3, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            vector = BitVector(bits)
            self.levels.append((vector, len(symbols) - vector.ones))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol: where its run begins on the last level, and that plus its occurrences before `at`."""
        start = np.zeros_like(at)
        both = np.concatenate((start, at))
        n = len(at)
        for k, (vector, zeros) in enumerate(self.levels):
            one = (symbols >> (self.depth - 1 - k) & 1).astype(bool)
            ones = vector.rank(both)
            both = np.where(np.concatenate((one, one)), zeros + ones, both - ones)
        return both[:n], both[n:]


class FMIndex:
    """Index of a sequence of numbers (0 separates texts), for patterns of up to `depth` numbers.

    The suffixes are sorted to `depth` numbers once; of that order only the Burrows-Wheeler transform stays, as a
    wavelet matrix, and where groups of suffixes that agree in depth - 1 and in depth numbers begin. With `owners` (one
    for each place) the least owner of each group of the latter is kept too, so an interval is answered without places.
    """

    def __init__(self, sequence: np.ndarray, depth: int, owners: np.ndarray | None = None):
        n = len(sequence)
        self.n, self.depth = n, depth
        self.sigma = int(sequence.max()) + 1 if n else 1
        names, have = sequence.astype(np.int64), 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: max(n - have, 0)] = names[have:] + 1
            keys = names * (int(nxt.max(initial=0)) + 1) + nxt
            if 2 * have >= depth:
                order = np.argsort(keys, kind="stable")
                break
            _, names = np.unique(keys, return_inverse=True)
            have *= 2
        self.bwt = WaveletMatrix(sequence[order - 1], self.sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=self.sigma))))

        def begins(length: int) -> np.ndarray:
            """Where groups of suffixes that agree in so many numbers begin."""
            second = np.minimum(order + length - have, n - 1)
            same = (names[order[1:]] == names[order[:-1]]) & (names[second[1:]] == names[second[:-1]])
            same &= np.maximum(order[1:], order[:-1]) + length <= n
            return np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), ~same))).astype(np.int32)

        self.wide, self.full = begins(depth - 1), begins(depth)
        self.least = np.minimum.reduceat(owners[order], self.full) if owners is not None and n else None

    def widened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffixes that agree in depth - 1 numbers with the one at each place of the order."""
        group = np.searchsorted(self.wide, low, side="right")
        return self.wide[group - 1].astype(np.int64), np.append(self.wide, self.n)[group].astype(np.int64)

    def least_owners(self, low: np.ndarray) -> np.ndarray:
        """The least owner of the interval of depth numbers that begins at each of these places."""
        return self.least[np.searchsorted(self.full, low)]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of symbol + pattern from the pattern's."""
        m = len(symbols)
        begin, place = self.bwt.rank(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        count = place - begin
        return self.first[symbols] + count[:m], self.first[symbols] + count[m:]


def window_intervals(index: FMIndex, sequence: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stream texts (slices of sequence) backwards through the index; for every place the interval of its next `width` numbers.

    These are matching statistics cut at width: each text keeps one interval, and before a step that would exceed width
    it is widened to the suffixes that share the last width - 1 numbers. Where the match breaks off, the interval is
    empty, and the matches that could still reach further left are sought again, shorter by one at the right each time.
    Places with fewer than width numbers left, or whose window does not occur, have [0, 0).
    """
    low_of, high_of = np.zeros(len(sequence), np.int64), np.zeros(len(sequence), np.int64)
    if not index.n or not len(starts):
        return low_of, high_of
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), index.n, np.int64)
    matched = np.zeros(len(starts), np.int64)
    for step in range(int(lengths[0])):
        live = int(np.searchsorted(-lengths, -step, side="left"))  # texts longer than step
        at = starts[:live] + lengths[:live] - 1 - step
        lo, hi, m = low[:live], high[:live], matched[:live]
        full = m >= width
        wide_low, wide_high = index.widened(np.minimum(lo, index.n - 1))
        lo, hi = np.where(full, wide_low, lo), np.where(full, wide_high, hi)
        m = np.where(full, width - 1, m)
        symbols = sequence[at]
        known = symbols < index.sigma
        new_lo, new_hi = index.extend(np.where(known, symbols, 0), lo, hi)
        m, broken = m + 1, (new_lo >= new_hi) | ~known
        for k in np.flatnonzero(broken):
            new_lo[k], new_hi[k], m[k] = longest(index, sequence[at[k] : at[k] + m[k] - 1]) if known[k] else (0, index.n, 0)
        low[:live], high[:live], matched[:live] = new_lo, new_hi, m
        hit = m >= width
        low_of[at[hit]], high_of[at[hit]] = new_lo[hit], new_hi[hit]
    return low_of, high_of


def longest(index: FMIndex, pattern: np.ndarray) -> tuple[int, int, int]:
    """The interval and length of the longest prefix of pattern that occurs: by halving, as occurring is monotone."""
    best, few, many = (0, index.n, 0), 0, len(pattern)
    while few < many:
        middle = (few + many + 1) // 2
        low, high = np.zeros(1, np.int64), np.full(1, index.n, np.int64)
        for symbol in pattern[:middle][::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
            if low[0] >= high[0]:
                break
        if low[0] < high[0]:
            best, few = (int(low[0]), int(high[0]), middle), middle
        else:
            many = middle - 1
    return best
