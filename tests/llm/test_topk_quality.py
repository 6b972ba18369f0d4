import math
import random
import zlib

import numpy as np
import pytest
from helpers import LONG, docs, tuples

from pyspark.sql import functions as F
from skyrank.llm import quality, topk

VECTORS = "vec_id long, embedding array<float>, label int, v string, cells string, dim string"


def slow_topk(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, *_ in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, v in dict((r for r in good if r[0] is not None and r[0] % 50 == 0)).items():
        scores = [(sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def vectors(seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, dim).astype(np.float32)]) for i in range(n)]
    rows += [(i, rows[i % 9][1]) for i in range(1000, 1030)]
    rows += [(1050, None), (1100, [None] + [0.0] * (dim - 1)), (1150, [float("nan")] * dim), (1200, [float("inf")] * dim),
             (1250, []), (1251, []), (1300, [0.1, 0.2]), (1301, [0.3, -0.2]), (None, rows[0][1]), (1350, [0.0] * dim), (1351, rows[1][1]),
             (1351, rows[1][1])]
    return [(*r, 0, "v", "c", "d") for r in rows]


@pytest.mark.parametrize("bits", [2, 6, 8])
def test_topk_against_brute_force(spark, bits):
    rows = vectors(bits)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    assert tuples(topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, bits=bits)) == slow_topk(rows)


@pytest.mark.parametrize("bits", [2, 6, 8])
def test_topk_of_large_components(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(0, [1.0, 0.5]), (1, [5e6, 1.0]), (2, [1.0, 1.0]), (50, [-3e8, 3e8]), (100, [2.0 ** 26, -2.0 ** 26 + 4])]
    rows += [(i, [float(np.float32(x)) for x in rng.normal(0, 10.0 ** rng.integers(0, 8), 2)]) for i in range(3, 300) if i % 50]
    rows += [(350, [1e30, -1.0]), (351, [-1e30, 2.0]), (352, [1e30, 2.0]), (353, [1e30, 2.0 ** 70])]
    rows = [(*r, 0, "v", "c", "d") for r in rows]
    found = topk.top_k(topk.quantised(spark.createDataFrame(rows, VECTORS).repartition(4)), F.col("vec_id") % 50 == 0, bits=bits)
    clipped = [(q, n, i, min(max(s, topk.LEAST), topk.MOST)) for q, n, i, s in slow_topk(rows)]
    assert tuples(found) == sorted(clipped, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_topk_in_blocks(spark):
    rows = vectors(3)
    df = spark.createDataFrame(rows, VECTORS)
    assert tuples(topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, block=3)) == slow_topk(rows)


def test_topk_of_few_rows_and_none(spark):
    rows = [(0, [0.5], 0, "", "", ""), (1, [0.5], 0, "", "", ""), (2, [-0.5], 0, "", "", "")]
    assert tuples(topk.top_k(topk.quantised(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 50 == 0)) == slow_topk(rows)
    assert topk.top_k(topk.quantised(spark.createDataFrame([], VECTORS)), F.col("vec_id") % 50 == 0).collect() == []


def slow_quality(rows, labels, top, below):
    """Posteriors by the formulas, with the given strengths."""
    hashed = [np.array([zlib.crc32(w) % quality.FEATURES for w in (r[1] or "").encode().lower().split()], int) for r in rows]
    counts = np.zeros((2, quality.FEATURES))
    sites, hosts, whole = {}, {}, [0, 0]
    for doc, q in labels:
        for r, words in zip(rows, hashed):
            if r[0] == doc and q in (0, 1) and doc is not None:
                np.add.at(counts[q], words, 1)
                for c in (sites.setdefault((r[3], r[2]), [0, 0]), hosts.setdefault(r[3], [0, 0]), whole):
                    c[0] += q
                    c[1] += 1
    ratio = np.log((counts[1] + 1) / (counts[1].sum() + quality.FEATURES)) - np.log((counts[0] + 1) / (counts[0].sum() + quality.FEATURES))
    ratio[counts.sum(axis=0) == 0] = 0
    rate = (whole[0] + 0.5) / (whole[1] + 1)
    host_rate = {h: (g + top * rate) / (n + top) for h, (g, n) in hosts.items()}
    path_rate = {s: (g + below * host_rate[s[0]]) / (n + below) for s, (g, n) in sites.items()}
    out = []
    for r, words in zip(rows, hashed):
        prior = path_rate.get((r[3], r[2]), host_rate.get(r[3], rate))
        ev = ratio[words].mean() * min(len(words), quality.EVIDENCE_WORDS) if len(words) else 0.0
        out.append((r[0], round(1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + ev))), 9)))
    return sorted(out, key=str)


def test_quality_against_the_formulas(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        q = rng.random() < (0.9 if i % 5 else 0.3)
        text = " ".join(rng.choice(["good", "fine", "text", "the"] if q else ["spam", "junk", "text", "the"]) for _ in range(20))
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 5}" if i % 7 else None))
        if i % 2:
            labels.append((i, int(q)))
    rows += [(900, None, "xx", "new"), (901, "", "en", "s1"), (902, LONG, "en", "s1"), (None, "good", "en", "s1"), (1, "good", "en", "s1")]
    labels += [(3, None), (5, 7), (None, 1), (7, 1), (7, 1), (12345, 0)]
    lab = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, source string")
    given = docs(spark, rows, extra=True)
    known = [r for r in labels if r[1] in (0, 1)]
    joined = given.join(spark.createDataFrame(known, "doc_id long, quality int"), "doc_id")
    sites = joined.groupBy("source", "lang").agg(F.sum("quality").alias("good"), F.count("quality").alias("n"))
    hosts = sites.groupBy("source").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    rate = (total[0] + 0.5) / (total[1] + 1)
    top = quality.strength(hosts, F.col("good") / F.col("n"), F.lit(rate))
    hosts = hosts.select(F.col("source").alias("h"), ((F.col("good") + top * rate) / (F.col("n") + top)).alias("hr"))
    below = quality.strength(sites.join(hosts, F.col("source").eqNullSafe(F.col("h"))), F.col("good") / F.col("n"), F.col("hr"))
    found = quality.classify(given, lab, F.col("source"), F.col("lang"))
    got = sorted(((r["doc_id"], round(r["posterior"], 9)) for r in found.collect()), key=str)
    assert got == slow_quality(rows, known, top, below)


def test_sparse_sites_shrink_more():
    pull = lambda good, n, rate, s: (good + s * rate) / (n + s)
    assert abs(pull(0, 1, 0.8, 10) - 0.8) < abs(pull(0, 100, 0.8, 10) - 0.8)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.classify(docs(spark, [(1, "a"), (2, None)]), none, F.col("source"), F.col("lang")).collect()
    assert [r["posterior"] for r in found] == [0.5, 0.5]
    assert quality.classify(docs(spark, []), none, F.col("source"), F.col("lang")).collect() == []


def test_quality_separates_held_out_labels(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0 and quality is not null")
    found = quality.classify(given, train, F.col("source"), F.col("lang")).join(test, "doc_id").collect()
    right = sum((r["posterior"] >= 0.5) == (r["quality"] == 1) for r in found) / len(found)
    base = max(sum(r["quality"] for r in found), sum(1 - r["quality"] for r in found)) / len(found)
    assert right >= base - 0.02
