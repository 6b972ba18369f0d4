import hashlib
import random

import numpy as np
import pytest
from helpers import LONG, docs, tuples

from skyrank.llm import repeats, substring_dedup, suffix_dedup


def keys(rows):
    """Documents as the operators tell them apart; the hash only orders those that share an id."""
    return [(r[0] is None, r[0] or 0) for r in rows]


def slow_words(rows, window=20):
    texts, first = [(r[1] or "").encode().split() for r in rows], {}
    place = keys(rows)
    for i, w in enumerate(texts):
        for k in range(len(w) - window + 1):
            seen = (*place[i], k)
            p = tuple(w[k:k + window])
            first[p] = min(first.get(p, seen), seen)
    out = []
    for i, w in enumerate(texts):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (*place[i], k):
                gone |= set(range(k, k + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((rows[i][0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def slow_bytes(rows, window=50):
    texts, first, place = [(r[1] or "").encode() for r in rows], {}, keys(rows)
    for i, t in enumerate(texts):
        for k in range(len(t) - window + 1):
            first[t[k:k + window]] = min(first.get(t[k:k + window], place[i]), place[i])
    out = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if first[t[k:k + window]] < place[i]:
                gone[k:k + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((rows[i][0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def corpus(seed, n=60):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice("the of and alpha beta gamma delta straße 東京".split()) + (
        str(rng.randrange(60)) if rng.random() < 0.5 else "") for _ in range(k))
    passages = [say(rng.randint(15, 50)) for _ in range(4)]
    rows = []
    for i in range(n):
        text = say(rng.randint(0, 40))
        for _ in range(rng.randrange(3)):
            text += rng.choice([" ", "\n", "  \t"]) + rng.choice(passages) + " " + say(rng.randint(0, 25))
        rows.append((i * 3 % 71 + 100, text))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (4, rows[3][1] + " x"), (502, passages[0] + " " + passages[0])]
    rows += [(1, None), (2, ""), (3, " \n "), (600, "a " * 80), (601, "b" * 200), (602, "b" * 120 + "c" * 90), (603, "ab" * 90)]
    rows += [(None, rows[5][1]), (700, LONG[:9000]), (701, "pre " + LONG[:9000] + " post")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [None, 400, 1])
def test_words_against_brute_force(spark, seed, limit):
    rows = corpus(seed)
    found = substring_dedup.deduplicate(docs(spark, rows, extra=True).repartition(5), shard_bytes=3000, group_bytes=limit)
    assert tuples(found) == slow_words(rows)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("limit", [None, 400, 1])
def test_bytes_against_brute_force(spark, seed, limit):
    rows = corpus(seed)
    found = suffix_dedup.deduplicate(docs(spark, rows, extra=True).repartition(5), shard_bytes=3000, group_bytes=limit)
    assert tuples(found) == slow_bytes(rows)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"u{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text)]
    assert [r[2] for r in tuples(substring_dedup.deduplicate(docs(spark, rows)))] == [0, 0, 60]
    assert [r[2] for r in tuples(suffix_dedup.deduplicate(docs(spark, rows)))] == [0, 0, len(text)]


def test_rows_of_one_id_with_different_texts_keep_one(spark):
    text = " ".join(f"u{i}" for i in range(60))
    rows = [(1, text + " one"), (1, text + " two")]
    assert sorted(r[2] for r in tuples(substring_dedup.deduplicate(docs(spark, rows)))) == [0, 60]


def test_empty_tables(spark):
    assert substring_dedup.deduplicate(docs(spark, [])).collect() == []
    assert suffix_dedup.deduplicate(docs(spark, [])).collect() == []


@pytest.mark.parametrize("units", [repeats.Words(), repeats.Bytes()])
def test_equal_windows_have_equal_minimizers(units):
    rng = random.Random(9)
    say = lambda k: " ".join(rng.choice("the of and alpha beta".split()) + str(rng.randrange(9)) for _ in range(k))
    shared = say(80)
    texts = [t.encode() for t in (say(30) + " " + shared + " " + say(9), "", shared, say(7) + " " + shared, "x")]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = repeats.Segments(units, np.frombuffer(b"".join(texts), np.uint8), bounds)
    seen, covered = {}, 0
    for key, doc, start, n in zip(found.key.tolist(), found.doc.tolist(), found.start.tolist(), found.windows.tolist()):
        parts = units.parts(units.body(texts[doc]))
        for k in range(start, start + n):
            window = units.joined(parts[k:k + units.window])
            assert len(parts[k:k + units.window]) == units.window and seen.setdefault(window, key) == key
            covered += 1
    assert covered == sum(max(0, len(units.parts(units.body(t))) - units.window + 1) for t in texts)


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = random.Random(seed)
    sigma = rng.choice([1, 2, 3, 26])
    texts = [[rng.randint(1, sigma) for _ in range(rng.randint(0, rng.choice([3, 60])))] for _ in range(rng.randint(1, 8))]
    texts = [t * rng.randint(1, 4) for t in texts] + texts[:2]
    flat = [s for t in texts for s in (*t, 0)]
    suffix = lambda i: flat[i:flat.index(0, i)]
    array = suffix_dedup.suffix_array(np.array(flat, np.int16)).tolist()
    expected = sorted((i for i in range(len(flat)) if flat[i]), key=suffix)
    assert sorted(array) == sorted(expected) and [suffix(i) for i in array] == [suffix(i) for i in expected]
