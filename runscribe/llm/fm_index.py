"""An FM-index over words: wavelet matrix with succinct bit vectors, searched backward for many queries at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of non-negative integers, the last of which occurs once; by prefix doubling."""
    n = len(text)
    rank, reach = text.astype(np.int64), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - reach] = rank[reach:] + 1
        key = rank * (int(behind.max()) + 1) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        reach *= 2


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """rank(c, i): how often c occurs among the first i values."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels, x = [], values
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = (x >> bit & 1).astype(np.uint8)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((bit, BitVector(bits), zeros))
            x = np.concatenate([x[bits == 0], x[bits == 1]])
        every = np.arange(symbols)
        self.start = np.zeros(symbols, np.int64)
        self.start = self._walk(every, np.zeros(symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.ones(i)
            i = np.where(c >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.start[c]


class FMIndex:
    """Index of documents given as lists of words; a match never spans two documents."""

    def __init__(self, documents: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        new = self.ids.setdefault
        parts = []
        for words in documents:
            parts.append(np.fromiter((new(w, len(self.ids) + 2) for w in words), np.int64, len(words)))
            parts.append(np.ones(1, np.int64))
        text = np.concatenate([*parts, np.zeros(1, np.int64)])
        self.symbols, self.n = len(self.ids) + 2, len(text)
        order = suffix_array(text)
        self.wavelet = WaveletMatrix(text[order - 1], self.symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=self.symbols))]

    def encode(self, words: list[bytes]) -> np.ndarray:
        """-1 stands for words that the index doesn't have."""
        get = self.ids.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes after each match is extended by c to the left; empty where c isn't there."""
        known = np.maximum(c, 0)
        both = self.wavelet.rank(np.concatenate([known, known]), np.concatenate([low, high])) + np.tile(self.before[known], 2)
        low, high = np.split(both, 2)
        return low, np.where(c < 0, low, high)


def long_matches(index: FMIndex, queries: list[np.ndarray], threshold: int, stretch: int = 128) -> list[tuple[int, int, int]]:
    """(query, start, end) of stretches of each query that occur in the index, of at least ``threshold`` words.

    Together they cover exactly the windows of ``threshold`` words that occur.  This is matching statistics
    from the right, cut off at the threshold: a match grows to the left word by word; where it can't, the next
    one ends at most ``threshold`` words behind the word that failed, because every longer one would hold a
    stretch already known not to occur.  Queries are cut into pieces of ``stretch`` windows and all pieces
    advance together.
    """
    flat = np.concatenate([*queries, np.empty(0, np.int64)])
    offset = np.cumsum([0, *map(len, queries)])
    owner, start, end = [], [], []
    for q, words in enumerate(queries):
        for s in range(0, len(words) - threshold + 1, stretch):
            owner.append(q)
            start.append(offset[q] + s)
            end.append(offset[q] + min(len(words), s + stretch + threshold - 1))
    owner, start, end = (np.array(x, np.int64) for x in (owner, start, end))
    at, low, high = end - 1, np.zeros(len(end), np.int64), np.full(len(end), index.n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(owner):
        low, high = index.extend(flat[at], low, high)
        ok = high > low
        begin = np.where(ok, at, at + 1)  # of the match as it stands
        over = (ok & (at == start)) | ~ok
        report = over & (end - begin >= threshold)
        if report.any():
            found.append((owner[report], begin[report], end[report]))
        fail = ~ok
        end = np.where(fail, np.minimum(end - 1, at + threshold), end)
        low, high = np.where(fail, 0, low), np.where(fail, index.n, high)
        done = (ok & (at == start)) | (fail & (end - start < threshold))
        at = np.where(fail, end - 1, at - 1)
        owner, start, end, at, low, high = (x[~done] for x in (owner, start, end, at, low, high))
    return sorted((int(q), int(b - offset[q]), int(e - offset[q])) for o, bs, es in found for q, b, e in zip(o, bs, es, strict=True))
