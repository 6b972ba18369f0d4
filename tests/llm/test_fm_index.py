import random

import numpy as np
import pytest

from skyrank.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def flat_of(rng, sigma, texts=6, most=30):
    out = []
    for _ in range(rng.randint(1, texts)):
        out += [rng.randint(1, sigma) for _ in range(rng.randint(0, most))] + [0]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rank_and_access(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(2, 40))
    row = rng.integers(0, size, 500)
    matrix = WaveletMatrix(row, size)
    at, symbol = rng.integers(0, 501, 200), rng.integers(0, size, 200)
    assert matrix.rank(symbol, at).tolist() == [int((row[:i] == s).sum()) for i, s in zip(at, symbol)]
    got, rank = matrix.at(np.arange(500))
    assert (got == row).all() and rank.tolist() == [int((row[:i] == row[i]).sum()) for i in range(500)]


@pytest.mark.parametrize("seed", range(10))
def test_search_locate_and_order(seed):
    rng = random.Random(seed)
    sigma = rng.choice([1, 2, 5])
    flat = flat_of(rng, sigma)
    order, place = suffix_order(np.array(flat))
    assert sorted(order.tolist()) == list(range(len(flat))) and (order[place] == np.arange(len(flat))).all()
    index = FMIndex(np.array(flat), sigma + 2)
    for size in (1, 2, 4):
        phrases = np.array([[rng.randint(1, sigma + 1) for _ in range(size)] for _ in range(12)])
        which, places = index.occurrences(*index.search(phrases))
        for k, phrase in enumerate(phrases.tolist()):
            assert sorted(places[which == k].tolist()) == [
                i for i in range(len(flat) - size + 1) if flat[i:i + size] == phrase]


@pytest.mark.parametrize("seed", range(10))
def test_matching_statistics(seed):
    rng = random.Random(100 + seed)
    sigma, limit = rng.choice([1, 2, 4]), 6
    flat = flat_of(rng, sigma)
    streamed = [[rng.randint(0, sigma + 1) for _ in range(rng.randint(0, 20))] for _ in range(5)]
    index = FMIndex(np.array(flat), sigma + 2, limit)
    text = np.array(sum(streamed, []), np.int64)
    found = {}
    for _, at, length, low, high in index.matching(text, np.cumsum([len(s) for s in streamed])):
        found.update({a: (n, h - l) for a, n, l, h in zip(at.tolist(), length.tolist(), low.tolist(), high.tolist())})
    base = 0
    for s in streamed:
        for i in range(len(s)):
            spots = lambda n: sum(flat[j:j + n] == s[i:i + n] for j in range(len(flat) - n + 1))
            fits = [n for n in range(1, min(limit, len(s) - i) + 1) if 0 not in s[i:i + n] and spots(n)]
            best = max(fits, default=0)
            assert found[base + i][0] == best
            assert not best or found[base + i][1] == spots(best)
        base += len(s)
