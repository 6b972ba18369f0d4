import hashlib
import re

import pytest
from helpers import LONG, docs, tuples

from pyspark.sql import functions as F
from skyrank.llm import mixing, sharding

WORD = re.compile("[^\x20\x09-\x0D]+")
ROWS = ([(i, "w " * (i % 37), None, f"s{i % 5}") for i in range(300)] + [(i, "a b c", None, None) for i in range(300, 340)]
        + [(7, None, None, "s1"), (8, "", None, "empty"), (None, "x y", None, "s2"), (None, "x y", None, "s2"), (9, LONG, None, "big"),
           (10, "p q", None, "s1"), (10, "p q", None, "s1")])


def slow_targets(sizes):
    """Water filling by rounds: {source: target}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {s: 0.0 for s in names}
    left = float(total)
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]} if w else set()
        if not over:
            target.update({s: left * weight[s] / w for s in open_} if w else {})
            return target
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over


def check(spark, rows, report):
    sizes, most = {}, {}
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        most[r[3]] = max(most.get(r[3], 0), n)
    target = slow_targets(sizes)
    got = report.collect()
    assert len(got) == len(rows)
    taken = sum(r["taken"] for r in got)
    total = sum(sizes.values())
    assert taken <= total and taken > total - 2 * max(most.values(), default=1) - 1
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    by_target = {}
    for r in got:
        by_target.setdefault(round(r["target"], 6), [0, r["source_size"]])[0] += r["taken"]
    assert sorted(by_target) == sorted({round(t, 6) for t in target.values()})


def test_mix_against_rounds_of_filling(spark):
    check(spark, ROWS, mixing.mix_report(docs(spark, ROWS, extra=True)))


def test_each_source_comes_near_its_target(spark):
    rows = [(i, "w " * (1 + i % 9), None, f"s{i % 4}" if i % 3 else "hot") for i in range(3000)]
    report = mixing.mix_report(docs(spark, rows))
    check(spark, rows, report)
    source = docs(spark, rows).select("doc_id", "source")
    for r in report.join(source, "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 30


def test_small_buckets_and_ranges_change_nothing(spark, monkeypatch):
    given = docs(spark, ROWS)
    before = tuples(mixing.mix_report(given))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(mixing, "RANGES", 8)
    assert tuples(mixing.mix_report(given)) == before


def test_mix_emits_every_copy(spark):
    given = docs(spark, ROWS, extra=True)
    mixed = mixing.mix(given)
    assert mixed.columns == given.columns
    counts = {tuple(r): n for *r, n in mixed.groupBy("doc_id", "source", "text").count().collect()}
    want = {}
    for r in mixing.mix_report(given).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    for doc, t in want.items():
        assert sum(n * len(WORD.findall(k[2] or "")) for k, n in counts.items() if k[0] == doc) == t


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_report(docs(spark, [])).collect() == []
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix_report(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_no_python_on_the_main_path(spark):
    plan = sharding.place(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_table(shards, slots):
    h = lambda s, seed: int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:12], 16)
    orders = [[(h(s, "offset") % slots + j * (h(s, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    table = {}
    while len(table) < slots:
        for k, order in enumerate(orders):
            if len(table) < slots:
                table[next(x for x in order if x not in table)] = k
    return [table[i] for i in range(slots)]


def test_table_against_brute_force():
    shards = tuple(f"n{i}" for i in range(7))
    assert sharding.fill(shards, 101) == brute_table(shards, 101)


def test_shares_are_even_and_stable():
    table = sharding.fill()
    counts = [table.count(k) for k in range(len(sharding.SHARDS))]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer)) / len(table)
    assert moved < 0.06


@pytest.mark.parametrize("shards,slots", [((), 101), (("a", "a"), 101), (("a",), 100), (("a", "b", "c"), 2)])
def test_bad_tables_are_refused(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)


def test_placement(spark):
    placed = sharding.place(docs(spark, ROWS, extra=True)).collect()
    assert len(placed) == len(ROWS)
    table = sharding.fill()
    for r in placed:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(hashlib.md5(key.encode()).hexdigest()[:12], 16) % sharding.SLOTS
        assert r["shard"] == table[r["slot"]]
    assert sharding.place(docs(spark, [])).collect() == []
