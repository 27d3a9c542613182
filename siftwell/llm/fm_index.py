"""A compressed FM-index over word sequences: Burrows-Wheeler transform in a wavelet matrix with packed bits and rank counts."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over a sequence of whole numbers, a level of packed bits for each binary digit."""

    def __init__(self, values: np.ndarray, limit: int):
        self.n, self.levels = len(values), max(1, int(limit - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        symbols = np.arange(limit, dtype=np.int64)
        start = np.zeros(limit, np.int64)
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.uint32))
            self.zeros.append(int(len(bits) - bits.sum()))
            start = self.step(len(self.words) - 1, symbols >> level & 1, start)
            values = np.concatenate([values[bits == 0], values[bits == 1]])
        self.start = start.astype(np.min_scalar_type(max(self.n, 1)))

    def step(self, k: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        ones = self.counts[k][word].astype(np.int64) + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for k in range(self.levels):
            at = self.step(k, symbols >> (self.levels - 1 - k) & 1, at)
        return at - self.start[symbols]


class FMIndex:
    """Index of sequences of symbols above 0. Suffixes are ordered by their first `depth` symbols, enough for patterns up to that length.

    What stays is the transform in the wavelet matrix, a few bits a symbol, and in the smallest whole numbers that hold them the
    counts by symbol and the sequence of each suffix; the text itself is not kept."""

    def __init__(self, sequences: list[np.ndarray], limit: int, depth: int):
        lengths = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(int(lengths.sum()), np.int64)
        self.n = len(text)
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(sequences)), lengths)
        inside = np.ones(len(text), bool)
        inside[first + lengths - 1] = False
        text[inside] = np.concatenate(sequences) if len(sequences) else []
        order, span = text.copy(), 1
        suffixes = np.argsort(order, kind="stable")
        while span < depth:
            ahead = np.zeros_like(order)
            ahead[:-span] = order[span:] if span < len(order) else 0
            key = order * (int(order.max()) + 1) + ahead
            suffixes = np.argsort(key, kind="stable")
            ranked = key[suffixes]
            order = np.empty_like(key)
            order[suffixes] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
            span *= 2
        self.owner = owner[suffixes].astype(np.min_scalar_type(len(sequences)))
        bwt = text[suffixes - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=limit))][:limit].astype(np.min_scalar_type(len(text)))
        self.wavelet = WaveletMatrix(bwt, limit)

    def backward(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that a symbol put in front makes."""
        both = self.before[np.r_[symbols, symbols]].astype(np.int64) + self.wavelet.rank(np.r_[symbols, symbols], np.r_[low, high])
        return both[: len(symbols)], both[len(symbols) :]

    def matching_statistics(self, query: np.ndarray, ends: np.ndarray, cap: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end place (exclusive) the longest match that ends there, up to cap, with at least `least` occurrences: its length and interval."""
        length, low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        live = np.arange(len(ends))
        for k in range(cap):
            at = ends[live] - 1 - k
            ok = at >= 0
            symbols = np.where(ok, query[np.maximum(at, 0)], 0)
            ok &= symbols > 0
            live, symbols = live[ok], symbols[ok]
            if not len(live):
                break
            a, b = self.backward(symbols, low[live], high[live])
            more = b - a >= least
            live, a, b = live[more], a[more], b[more]
            low[live], high[live], length[live] = a, b, k + 1
        return length, low, high
