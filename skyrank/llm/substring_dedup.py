"""Substring de-duplication over words with a compressed FM-index per shard.

A shard's different segments are indexed once and then streamed against the index.  Backward search over the
wavelet matrix gives the matching statistics of every position, up to the window; where a whole window
matches in two places or more, all its places are located and the earliest of them found.  A window
with an earlier place is to go.

Defined results: a null or empty text has no words; texts with fewer words than a window keep all; rows with
one doc_id and one text are one document, rows with one doc_id and different texts are ordered by
a hash of the text; a null doc_id comes last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .fm_index import FMIndex
from .repeats import Words, covered, remove_repeats

SHARD_BYTES = 2_000_000
SCHEMA = "n_words long, n_removed long, kept_sha256 string"


def numbered(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of all bodies as numbers from 1, with 0 after each body; where bodies end; numbers used."""
    numbers: dict[bytes, int] = {b"": 0}
    flat: list[int] = []
    ends = np.zeros(len(bodies), np.int64)
    for i, body in enumerate(bodies):
        flat += [numbers.setdefault(w, len(numbers)) for w in body.split(b" ")]
        ends[i] = len(flat)
        flat.append(0)
    return np.array(flat, np.int64), ends, len(numbers)


def earlier_windows(bodies: list[bytes], order: np.ndarray, start: np.ndarray,
                    window: int = Words.window) -> tuple[np.ndarray, np.ndarray]:
    """(body, offset) of the windows that also occur at an earlier place of the shard."""
    text, ends, size = numbered(bodies)
    begins = np.concatenate([[0], ends[:-1] + 1])
    index = FMIndex(text, size, window)
    places, lows, highs = [], [], []
    # streamed texts end before the mark of their body, and the mark starts the next one
    for _, at, length, low, high in index.matching(np.delete(text, ends), ends - np.arange(len(ends))):
        full = (length == window) & (high - low > 1)
        places.append(at[full])
        lows.append(low[full])
        highs.append(high[full])
    place, low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, lows, highs))
    if not len(place):
        return place, place
    body = np.searchsorted(ends - np.arange(len(ends)), place, "right")
    offset = place - (begins - np.arange(len(begins)))[body]
    # equal windows share a range: locate each range once
    first, inverse = np.unique(low, return_inverse=True)
    last = np.zeros(len(first), np.int64)
    last[inverse] = high
    which, found = index.occurrences(first, last)
    holder = np.searchsorted(ends, found, "right")
    rank = (order[holder] << 40) + start[holder] + found - begins[holder]
    edges = np.cumsum(last - first) - (last - first)
    earliest = np.minimum.reduceat(rank, edges)
    mine = (order[body] << 40) + start[body] + offset
    later = earliest[inverse] < mine
    return body[later], offset[later]


def kept_words(text: bytes, gone: list[dict] | None) -> tuple[int, int, str]:
    words = text.split()
    if gone:
        left = covered(gone, len(words))
        kept = [w for w, out in zip(words, left.tolist()) if not out]
    else:
        kept = words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def deduplicate(docs: DataFrame, shard_bytes: int = SHARD_BYTES, group_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return remove_repeats(docs, Words(), earlier_windows, True, shard_bytes, kept_words, SCHEMA, group_bytes)
