"""A compressed full-text index over word sequences: suffix order, wavelet tree of its transform, backward search.

The text is a row of pieces (runs of words).  Every piece ends with a separator; separators differ from each other, in order of
their places, so the order of two suffixes is settled within their pieces.  The transform (the word before each suffix, in order of
suffixes) is held as a wavelet tree in the shape of a Huffman code: a bit vector a level with counts for every 64 bits, so it takes about the
entropy of the words.  The suffix order itself isn't kept.
"""

from __future__ import annotations

import heapq

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols`` by prefix doubling; zeros are separators."""
    n, gaps = len(symbols), symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + gaps.sum())
    step = 1
    while True:
        key = rank * (n + int(symbols.max(initial=0)) + 2)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0] = True
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        step *= 2
        if fresh.all() or step >= n:
            return order


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for symbols that occur ``counts`` times (one bit at least)."""
    if len(counts) == 1:
        return np.ones(1, np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, n = [0] * (2 * len(counts) - 1), len(counts)
    while len(heap) > 1:
        a = heapq.heappop(heap)
        b = heapq.heapreplace(heap, (a[0] + heap[0][0], n))
        parent[a[1]] = parent[b[1]] = n
        n += 1
    depth = [0] * n
    for x in range(n - 2, -1, -1):
        depth[x] = depth[parent[x]] + 1
    return np.array(depth[: len(counts)], np.int64)


def canonical_codes(length: np.ndarray) -> np.ndarray:
    """Codes of the given lengths, none the beginning of another, ascending in order of (length, symbol)."""
    order = np.lexsort((np.arange(len(length)), length))
    code, last, out = -1, int(length[order[0]]), np.empty(len(length), np.int64)
    for x, size in zip(order.tolist(), length[order].tolist()):
        code = (code + 1) << (size - last)
        last, out[x] = size, code
    return out


class _Bits:
    """A bit vector with the number of ones before each position."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """How often a symbol occurs before a position, in time of its code's length."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        counts = np.bincount(values, minlength=symbols)
        length = code_lengths(np.maximum(counts, 1))
        code = canonical_codes(length)
        self.length, self.levels = length, []
        for level in range(int(length.max())):
            deep = np.flatnonzero(length > level)
            prefix = code >> np.maximum(length - level, 0)
            values = values[length[values] > level]
            values = values[np.argsort(prefix[values], kind="stable")]
            side = (code >> np.maximum(length - level - 1, 0)) & 1
            bits = _Bits(side[values])
            start = np.zeros(symbols, np.int64)
            start[deep] = np.searchsorted(prefix[values], prefix[deep])
            self.levels.append((bits, start, bits.ones(start), side == 1))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, live = at.copy(), None
        size = self.length[symbol]
        for level, (bits, start, base, side) in enumerate(self.levels):
            live = np.flatnonzero(size > level) if live is None else live[size[live] > level]
            if not len(live):
                break
            c, p = symbol[live], out[live]
            ones = bits.ones(start[c] + p) - base[c]
            out[live] = np.where(side[c], ones, p - ones)
        return out


class FMIndex:
    """Backward search over pieces of words.  ``symbols``: words as numbers from 1, each piece followed by a zero."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        order = suffix_order(symbols)
        n = int(symbols.max(initial=0)) + 1
        self.tree = WaveletTree(symbols[order - 1], n)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n))])

    def matching(self, starts: np.ndarray, window: int, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the windows that start at ``starts`` in the indexed text itself, by backward search.

        For each: how many of its last words, up to ``window``, also stand elsewhere in the pieces (0: not even the last), and the least
        place in the suffix order under which it was found; windows matched in full are equal exactly if those places are.
        """
        matched, place = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
        for a in range(0, len(starts), block):
            live = np.arange(a, min(a + block, len(starts)))
            word = self.symbols[starts[live] + window - 1]
            low, high = self.first[word], self.first[word + 1]
            for step in range(1, window + 1):
                on = high - low > 1
                live, low, high = live[on], low[on], high[on]
                if not len(live):
                    break
                matched[live] = step
                if step == window:
                    place[live] = low
                    break
                word = self.symbols[starts[live] + window - 1 - step]
                both = self.tree.rank(np.concatenate([word, word]), np.concatenate([low, high]))
                low, high = self.first[word] + both[: len(live)], self.first[word] + both[len(live) :]
        return matched, place


def repeated_windows(pieces: list[list[bytes]], window: int) -> list[np.ndarray]:
    """For each piece, for each of its windows, whether the same words stand earlier: in a piece before it or further left in it."""
    known: dict[bytes, int] = {}
    numbers = [known.setdefault(w, len(known) + 1) for piece in pieces for w in piece]
    sizes = np.array([len(p) for p in pieces], np.int64)
    symbols = np.zeros(len(numbers) + len(pieces), np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    of = np.repeat(np.arange(len(pieces)), sizes)
    symbols[np.arange(len(numbers)) + of] = numbers
    windows = np.maximum(sizes - window + 1, 0)
    ends = np.cumsum(windows)
    starts = np.arange(windows.sum()) + np.repeat(begins - (ends - windows), windows)
    matched, place = FMIndex(symbols).matching(starts, window)
    full = np.flatnonzero(matched == window)
    _, first = np.unique(place[full], return_index=True)
    again = np.zeros(len(starts), bool)
    again[full] = True
    again[full[first]] = False
    return np.split(again, ends[:-1])
