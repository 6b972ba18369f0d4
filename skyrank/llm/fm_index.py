"""FM-index of one shard: suffix order, Burrows-Wheeler symbols in a wavelet matrix, sampled positions.

A shard is a row of symbols (numbers from 1) in which 0 ends a document.  Ends are all different for
the order of suffixes, in order of position, so no match runs past one.
"""

from __future__ import annotations

import numpy as np

from .arrow import repeat_ranges

SAMPLE = 32


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the place of every suffix; ``symbols`` ends with 0."""
    n = len(symbols)
    key = symbols.astype(np.int64)
    ends = np.flatnonzero(key == 0)
    key += len(ends)
    key[ends] = np.arange(len(ends))
    idx = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    fresh = np.flatnonzero(np.diff(key[idx], prepend=-1))
    first = np.repeat(fresh, np.diff(fresh, append=n))
    place[idx] = first
    idx = idx[_open(first)]
    depth = 1
    while len(idx):
        group = place[idx]
        by = group * (n + 1) + place[idx + depth]
        order = np.argsort(by, kind="stable")
        idx, group, by = idx[order], group[order], by[order]
        at = np.arange(len(idx))
        new_group = np.diff(group, prepend=-1) != 0
        new = np.diff(by, prepend=-1) != 0
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        inner = np.maximum.accumulate(np.where(new, at, 0))
        first = group + inner - start
        place[idx] = first
        idx = idx[_open(first)]
        depth *= 2
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    return order, place


def _open(first: np.ndarray) -> np.ndarray:
    """Of sorted places, those that several suffixes still share."""
    same = np.zeros(len(first), bool)
    if len(first) > 1:
        equal = first[1:] == first[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    return same


class WaveletMatrix:
    """Symbols by bit levels; each level is packed bits with a running count per 64 of them."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n, self.depth = len(symbols), max(1, int(size - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.bitwise_count(words).astype(np.int32)
            self.words.append(words)
            self.before.append(np.cumsum(counts, dtype=np.int32) - counts)
            one = bit == 1
            self.zeros.append(self.n - int(one.sum()))
            now = np.concatenate([now[~one], now[one]])
        self.base = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & low)

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.depth):
            ones = self._ones(level, at)
            bit = (symbol >> (self.depth - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.base[symbol]

    def at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.depth):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, at)
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return symbol, at - self.base[symbol]


class FMIndex:
    """Backward search, location and matching statistics over one shard of symbols below ``size``."""

    def __init__(self, symbols: np.ndarray, size: int, limit: int = 0):
        """``limit``: how many symbols matching statistics tell apart at most (0: not wanted)."""
        self.n, self.size, self.limit = len(symbols), size, limit
        order, place = suffix_order(symbols)
        bwt = symbols[order - 1]
        bwt[order == 0] = 0
        self.matrix = WaveletMatrix(bwt, size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        # every SAMPLE-th position is kept, and every start, where walking back ends
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.marks = WaveletMatrix(kept.astype(np.int64), 2)
        self.positions = order[kept].astype(np.int32)
        if limit:
            self.common = self._common(symbols, order)
            self.bounds = [np.zeros(1, np.int64)] + [np.flatnonzero(self.common < d) for d in range(1, limit + 1)]

    def _common(self, symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Leading symbols that neighbours in suffix order share, up to the limit."""
        common = np.zeros(self.n, np.int8)
        row = np.arange(1, self.n)
        for d in range(self.limit):
            a, b = order[row] + d, order[row - 1] + d
            inside = np.maximum(a, b) < self.n
            row, a, b = row[inside], a[inside], b[inside]
            row = row[(symbols[a] == symbols[b]) & (symbols[a] != 0)]
            common[row] = d + 1
        return common

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges after putting a symbol before what was matched."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[:len(low)], self.first[symbol] + both[len(low):]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length, a row each, all at once from their last symbol."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            low[alive], high[alive] = self.extend(phrases[alive, column], low[alive], high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a kept one."""
        found, steps = np.empty(len(rows), np.int64), 0
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            mark, rank = self.marks.at(rows)
            hit = mark == 1
            found[todo[hit]] = self.positions[rank[hit]] + steps
            todo, rows = todo[~hit], rows[~hit]
            symbol, rank = self.matrix.at(rows)
            rows = self.first[symbol] + rank
            steps += 1
        return found

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range number, text position) of everything the ranges hold."""
        sizes = high - low
        return np.repeat(np.arange(len(low)), sizes), self.locate(repeat_ranges(low, sizes))

    def shorten(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the first ``depth`` symbols of what was matched."""
        low, high = low.copy(), high.copy()
        for d in np.unique(depth):
            at, bound = depth == d, self.bounds[d]
            if d == 0:
                low[at], high[at] = 0, self.n
                continue
            low[at] = bound[np.searchsorted(bound, low[at], "right") - 1]
            end = np.searchsorted(bound, high[at] - 1, "right")
            high[at] = np.append(bound, self.n)[end]
        return low, high

    def matching(self, texts: np.ndarray, ends: np.ndarray):
        """Matching statistics of streamed texts, from their ends to their starts and all at once.

        ``texts`` holds symbols (unknown ones: 0), ``ends`` where each text ends; texts start where the
        one before ends.  Yields (text numbers, positions, matched lengths up to the limit, low, high).
        """
        starts = np.concatenate([[0], ends[:-1]])
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        length = np.zeros(len(ends), np.int64)
        common = np.append(self.common, 0)
        alive, at = np.arange(len(ends)), ends - 1
        while True:
            keep = at >= starts[alive]
            alive, at, low, high, length = alive[keep], at[keep], low[keep], high[keep], length[keep]
            if not len(alive):
                return
            symbol = texts[at]
            full = length == self.limit
            if full.any():
                low[full], high[full] = self.shorten(low[full], high[full], length[full] - 1)
                length[full] -= 1
            todo = np.flatnonzero(symbol != 0)
            gone = symbol == 0
            low[gone], high[gone], length[gone] = 0, self.n, 0
            while len(todo):
                a, b = self.extend(symbol[todo], low[todo], high[todo])
                ok = a < b
                hit = todo[ok]
                low[hit], high[hit] = a[ok], b[ok]
                length[hit] += 1
                todo = todo[~ok]
                over = length[todo] == 0    # the symbol does not occur at all
                todo = todo[~over]
                depth = np.maximum(common[low[todo]], common[high[todo]]).astype(np.int64)
                depth = np.minimum(depth, length[todo] - 1)
                low[todo], high[todo] = self.shorten(low[todo], high[todo], depth)
                length[todo] = depth
            yield alive, at, length, low, high
            at = at - 1
