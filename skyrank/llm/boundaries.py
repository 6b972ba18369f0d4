"""A compressed set of positions with select: array, bitmap and run containers of 65 536 positions each.

The set answers "where is the k-th member" for many k at once: cumulative cardinalities find the
container, and a select inside it finds the position.
"""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16
#: A sorted array of two-byte positions is as large as the bitmap at this many members.
ARRAY_LIMIT = 4096
_WORDS = SPAN // 64
_BIT = np.arange(64, dtype=np.uint64)


class ArrayContainer:
    """Few members: their positions in order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)


class BitmapContainer:
    """Many scattered members: one bit each, and how many stand before every word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, "right") - 1
        bits = (self.words[word][:, None] >> _BIT) & np.uint64(1)
        rank = np.cumsum(bits, axis=1, dtype=np.int64)
        return word * 64 + (rank <= (k - self.before[word])[:, None]).sum(axis=1)


class RunContainer:
    """Stretches of consecutive members: starts, and how many members stand before each."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        self.starts = starts.astype(np.int64)
        self.before = np.cumsum(sizes) - sizes

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, "right") - 1
        return self.starts[run] + k - self.before[run]


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted positions below ``SPAN``."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    runs_cost, array_cost = 4 * len(first), 2 * len(low) if len(low) <= ARRAY_LIMIT else SPAN
    if runs_cost < min(array_cost, SPAN // 8):
        return RunContainer(low[first], np.diff(first, append=len(low)))
    return ArrayContainer(low) if array_cost <= SPAN // 8 else BitmapContainer(low)


class BoundarySet:
    """Sorted positions in containers; ``select`` maps ranks to positions."""

    def __init__(self, positions: np.ndarray):
        chunk = positions // SPAN
        self.keys, first = np.unique(chunk, return_index=True)
        ends = np.append(first[1:], len(positions))
        self.before = first.astype(np.int64)    # cardinality of all containers before each
        self.size = len(positions)
        self.containers = [container(positions[a:b] - key * SPAN)
                           for key, a, b in zip(self.keys.tolist(), first.tolist(), ends.tolist())]

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Positions of the members with these ranks, counted from 0."""
        ranks = np.asarray(ranks, np.int64)
        which = np.searchsorted(self.before, ranks, "right") - 1
        out = np.zeros(len(ranks), np.int64)
        for i in np.unique(which).tolist():
            at = np.flatnonzero(which == i)
            out[at] = self.keys[i] * SPAN + self.containers[i].select(ranks[at] - self.before[i])
        return out
