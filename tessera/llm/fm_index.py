"""A compressed full-text index over numbers: Burrows-Wheeler transform in a wavelet matrix of bit vectors."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int32)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(np.uint8)
            self.levels.append((b, Bits(bit)))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each value before each place."""
        low, high = np.zeros_like(i), i
        for b, bits in self.levels:
            one = (value >> b) & 1 == 1
            ones_low, ones_high = bits.ones(low), bits.ones(high)
            low = np.where(one, bits.zeros + ones_low, low - ones_low)
            high = np.where(one, bits.zeros + ones_high, high - ones_high)
        return high - low


class FMIndex:
    """Over sequences of numbers laid end to end, each followed by a separator.

    Suffixes are sorted by their first 16 symbols, so patterns of up to 16 symbols have exact intervals.
    """

    DEPTH = 16

    def __init__(self, symbols: np.ndarray, separator: np.ndarray):
        """symbols: any integers; separator marks the places that end a sequence."""
        self.alphabet, code = np.unique(symbols[~separator], return_inverse=True)
        text = np.zeros(len(symbols), np.int64)
        text[~separator] = code + 1
        n, ranks, width = len(text), [text], 1
        while width < self.DEPTH:
            rank = ranks[-1]
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - width, 0)] = rank[width:] + 1
            ranks.append(np.unique(rank * (int(ahead.max(initial=0)) + 1) + ahead, return_inverse=True)[1])
            width *= 2
        self.suffixes = np.argsort(ranks[-1], kind="stable")
        self.starts = np.searchsorted(text[self.suffixes], np.arange(len(self.alphabet) + 2))
        self.bwt = WaveletMatrix(text[self.suffixes - 1], max(1, int(len(self.alphabet)).bit_length()))
        self._ranks, self._text = ranks, text

    def same_prefix(self, length: int) -> np.ndarray:
        """For each row of the sorted suffixes, whether its first symbols are those of the row before."""
        same = np.ones(len(self.suffixes), bool)
        same[:1] = False
        at, level = 0, len(self._ranks) - 1
        while at < length:
            while (1 << level) > length - at:
                level -= 1
            rank = np.r_[self._ranks[level], np.full(self.DEPTH, -1)]
            row = rank[np.minimum(self.suffixes + at, len(rank) - 1)]
            same[1:] &= row[1:] == row[:-1]
            at += 1 << level
        return same

    def forget(self) -> None:
        """Keep the compressed index alone."""
        del self._ranks, self._text

    def encode(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of symbols, -1 for those that the index lacks."""
        if not len(self.alphabet):
            return np.full(len(symbols), -1, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, -1)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns with one more symbol in front."""
        known = np.maximum(code, 0)
        low, high = self.starts[known] + self.bwt.rank(known, low), self.starts[known] + self.bwt.rank(known, high)
        gone = (code < 0) | (low >= high)
        return np.where(gone, 0, low), np.where(gone, 0, high)


class Windows:
    """Which windows of streamed sequences occur in an index, and the least label of an occurrence.

    Matching statistics cut off at the window: going left, the interval of a matched window loses its last
    symbol (the enclosing block of suffixes that share one symbol less) and takes one in front; where
    nothing matched, the search starts anew.
    """

    def __init__(self, symbols: np.ndarray, separator: np.ndarray, label: np.ndarray, width: int):
        self.index, self.width = FMIndex(symbols, separator), width
        shorter, full = self.index.same_prefix(width - 1), self.index.same_prefix(width)
        heads = np.flatnonzero(~shorter)
        self._head = np.cumsum(~shorter) - 1
        self._block_low, self._block_high = heads, np.r_[heads[1:], len(shorter)]
        starts = np.flatnonzero(~full)
        self._full = np.cumsum(~full) - 1
        self.least = np.minimum.reduceat(label[self.index.suffixes], starts) if len(starts) else label[:0]
        self.index.forget()

    def scan(self, symbols: np.ndarray, first: np.ndarray, count: np.ndarray, missing: int) -> np.ndarray:
        """Least label of each window; sequence i has ``count[i]`` windows from ``first[i]``, in order."""
        code = self.index.encode(symbols)
        out = np.full(int(count.sum()), missing, np.int64)
        base = np.cumsum(count) - count
        low, high = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for back in range(1, int(count.max(initial=0)) + 1):
            who = np.flatnonzero(count >= back)
            at = first[who] + count[who] - back
            warm = high[who] > low[who]
            block = self._head[low[who]]
            l, h = np.where(warm, self._block_low[block], 0), np.where(warm, self._block_high[block], len(self._head))
            cold = np.flatnonzero(~warm)
            for step in range(self.width - 1, 0, -1):
                if not len(cold):
                    break
                l[cold], h[cold] = self.index.extend(code[at[cold] + step], l[cold], h[cold])
                cold = cold[h[cold] > l[cold]]
            l, h = self.index.extend(code[at], l, h)
            low[who], high[who] = l, h
            hit = h > l
            out[base[who[hit]] + count[who[hit]] - back] = self.least[self._full[l[hit]]]
        return out
