import random

import numpy as np
import xxhash
from helpers import LONG, docs, tuples

from skyrank.llm import components as graph
from skyrank.llm import simhash
from skyrank.llm.components import components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    """[(doc_id, fingerprint)] to {position: least id reachable}."""
    left, out = set(range(len(rows))), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            at = todo.pop()
            near = {k for k in left if (rows[at][1] ^ rows[k][1]).bit_count() <= radius}
            left -= near
            group |= near
            todo += near
        least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        out.update(dict.fromkeys(group, least))
    return out


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"{rng.choice('abcdef')}{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9999)}"
        rows.append((i + 100, " ".join(words)))
    return rows


CASES = [(5, None), (6, ""), (7, " \t"), (8, "one two"), (3, "one two"), (3, "one two"), (None, "one two"),
         (None, "only here and nowhere else"), (9, LONG), (10, LONG + " end"), (11, "A B C D E"), (12, "a b  c\nd e")]


def expected(rows):
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    roots = slow_components(prints)
    return sorted(((p[0], f"{p[1]:016x}", roots[i]) for i, p in enumerate(prints)),
                  key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_every_pair_within_the_radius_meets_in_a_table():
    rng = random.Random(1)
    masks = simhash.masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & diff == 0 for m in masks)


def test_against_brute_force(spark):
    rows = CASES + near_copies(120)
    assert tuples(simhash.near_duplicates(docs(spark, rows, extra=True))) == expected(rows)


def test_overfull_buckets_are_linked_by_midpoints(spark):
    rows = near_copies(60)
    assert tuples(simhash.near_duplicates(docs(spark, rows), bucket_limit=2)) == expected(rows)


def test_midpoints_join_what_brute_force_joins(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(25)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = dict(tuples(components(simhash.midpoint_links(df, 4))))
    groups = slow_components([(x, x & (2 ** 64 - 1)) for x in signed])
    assert [roots.get(x, x) for x in signed] == [groups[i] for i in range(len(signed))]


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    assert simhash.keep_first(docs(spark, [])).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = CASES + near_copies(40)
    kept = simhash.keep_first(docs(spark, rows, extra=True))
    assert kept.columns == docs(spark, [], extra=True).columns
    roots = slow_components([(r[0], slow_fingerprint(r[1])) for r in rows])
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault((roots[i], slow_fingerprint(r[1]) if roots[i] is None else None), []).append(r[0])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == sorted(
        (g[0] is not None, g[0] or 0) for g in groups)


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).selectExpr("id as a", "id - 1 as b")
    assert tuples(components(chain)) == sorted(((i, 0) for i in range(1, 200)), key=lambda r: (True, str(r[0])))


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    plans, stage = [], simhash.stage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(simhash, "stage", noted)
    monkeypatch.setattr(graph, "stage", noted)
    rows = near_copies(30)
    for df in (simhash.near_duplicates(docs(spark, rows)), simhash.near_duplicates(docs(spark, rows), bucket_limit=2),
               simhash.keep_first(docs(spark, rows))):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not [p for p in plans if "Broadcast" in p]
