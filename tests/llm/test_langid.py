import random

import numpy as np
from helpers import LONG, docs

from pyspark.sql import functions as F
from skyrank.llm import langid

DIR = "/root/testdata/sf0.01"


def slow_bits(grams, counts):
    """Interpolated Kneser-Ney by its definition over tuples of symbols: a function of (context, symbol)."""
    levels, now = [], dict(zip(grams, counts))
    while True:
        order = len(next(iter(now)))
        once, twice = (sum(n == k for n in now.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        levels.insert(0, (now, d))
        if order == 1:
            break
        shorter = {}
        for g in now:
            shorter[g[1:]] = shorter.get(g[1:], 0) + 1
        now = shorter

    def p(gram):
        value = 1 / (len(levels[0][0]) + 1)
        for order, (table, d) in enumerate(levels, 1):
            part = gram[-order:]
            mine = [n for g, n in table.items() if g[:-1] == part[:-1]]
            if mine:
                value = max(table.get(part, 0) - d, 0) / sum(mine) + d * len(mine) / sum(mine) * value
        return -np.log2(value)

    return p


def test_model_by_its_definition():
    rng = random.Random(1)
    grams = list({tuple(rng.randrange(4) for _ in range(4)) for _ in range(60)})
    counts = [rng.choice([1, 1, 2, 3, 9]) for _ in grams]
    pack = lambda g: sum(s << 16 * k for k, s in enumerate(reversed(g)))
    model = langid.KneserNey(np.array([pack(g) for g in grams], np.uint64), np.array(counts))
    asked = [tuple(rng.randrange(6) for _ in range(4)) for _ in range(200)]
    p = slow_bits(grams, counts)
    assert np.allclose(model.bits(np.array([pack(g) for g in asked], np.uint64)), [p(g) for g in asked], rtol=1e-5)


def test_probabilities_add_up():
    rng = random.Random(2)
    grams = sorted({tuple(rng.randrange(1, 6) for _ in range(4)) for _ in range(80)})
    pack = lambda g: sum(s << 16 * k for k, s in enumerate(reversed(g)))
    model = langid.KneserNey(np.array([pack(g) for g in grams], np.uint64), np.ones(len(grams), int))
    seen = range(1, 6)
    for context in ((1, 2, 3), (9, 9, 9), (5, 5, 1)):
        bits = model.bits(np.array([pack((*context, s)) for s in (*seen, 99)], np.uint64))
        assert abs((2.0 ** -bits).sum() - 1) < 1e-5


def test_held_out_accuracy(spark):
    given = spark.read.parquet(f"{DIR}/documents.parquet")
    found = langid.learn_and_identify(given).where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right, n, kept = found.agg(F.avg((F.col("language.pred") == F.col("lang")).cast("int")), F.count("*"),
                               F.avg((~F.col("language.rejected")).cast("int"))).first()
    assert n > 100 and right > 0.99 and kept > 0.99


def test_prediction_sees_the_text_only(spark):
    given = spark.read.parquet(f"{DIR}/documents.parquet")
    models = langid.train(given.where(~langid.held_out(F.col("doc_id"))))
    plain = langid.identify(given, models).select("doc_id", "language")
    other = langid.identify(given.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 0}), models)
    assert plain.exceptAll(other.select("doc_id", "language")).isEmpty()


CASES = [(1, "the cat sat on the mat and the dog sat on the log", "en"), (2, "der hund und die katze sind auf der matte", "de"),
         (3, "the man and the hat are in the house", "en"), (6, "die frau und der mann sind in dem haus", "de"),
         (7, None, "en"), (8, "", "de"), (9, "123 ... !!", "en"), (11, "the dog", None), (None, "the cat and the dog", "de"),
         (12, "\U0001d4d0\U0001d4d1 İstanbul ß", "en"), (12, "\U0001d4d0\U0001d4d1 İstanbul ß", "en"),
         (13, LONG, None), (14, "中文字 " * 400, None)]


def test_odd_rows(spark):
    given = docs(spark, CASES, extra=True)
    models = langid.train(given)
    assert set(models) == {"en", "de"}
    found = langid.identify(given, models)
    assert set(found.columns) == set(given.columns)
    got = {r["doc_id"]: r["language"] for r in found.collect()}
    for doc in (7, 8, 9):
        assert (got[doc]["pred"], got[doc]["score"], got[doc]["rejected"]) == ("und", 0.0, True)
    assert got[3]["pred"] == "en" and got[2]["pred"] == "de" and 0 < got[3]["score"] <= 1
    assert got[14]["pred"] in models and got[14]["rejected"]
    kept = langid.keep_identified(given)
    assert kept.columns == given.columns


def test_nothing_to_learn_from(spark):
    found = langid.learn_and_identify(docs(spark, [(1, "some text"), (2, None)])).collect()
    assert [(r["language"]["pred"], r["language"]["rejected"]) for r in found] == [("und", True)] * 2
    assert langid.learn_and_identify(docs(spark, [])).collect() == []


def test_a_bounded_model_keeps_the_commonest(spark):
    models = langid.train(docs(spark, CASES), max_entries=40)
    assert sum(len(m.levels[-1][0].hashes) for m in models.values()) <= 40


def test_small_batches_change_nothing(spark, monkeypatch):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = langid.train(given)
    before = langid.identify(given, models).select("doc_id", "language.pred", F.round("language.cross_entropy", 6).alias("c"))
    monkeypatch.setattr(langid, "BATCH_BYTES", 900)
    after = langid.identify(given, models).select("doc_id", "language.pred", F.round("language.cross_entropy", 6).alias("c"))
    assert before.exceptAll(after).isEmpty()


def test_blocks_keep_every_gram(spark, monkeypatch):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = langid.train(given)
    monkeypatch.setattr(langid, "BLOCK_ENTRIES", 2000)
    monkeypatch.setattr(langid, "ROUND_GRAMS", 50_000)
    models = langid.train(given)
    assert isinstance(models, langid.Blocks) and list(models) == list(whole) and len(models.parts) > 3
    assert np.allclose(models.means, [m.mean for m in whole.values()], rtol=1e-5)
    assert np.allclose(models.deviations, [m.deviation for m in whole.values()], rtol=1e-4)
    seen = [np.frombuffer(f"x{i}{c}ab ".encode("utf-16-le")[:8], np.uint64)[0] for i in range(10) for c in "eqz"]
    seen += [r[0] % 2 ** 64 for r in langid.gram_counts(given).select("gram").distinct().limit(3000).collect()]
    seen = np.array(seen, np.uint64)
    assert np.allclose(models.bits(seen), [m.bits(seen) for m in whole.values()], rtol=1e-5)
    columns = ["doc_id", "language.pred", "language.rejected", F.round("language.cross_entropy", 3).alias("c")]
    assert langid.identify(given, models).select(columns).exceptAll(langid.identify(given, whole).select(columns)).isEmpty()


def test_a_small_language_stays_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_ENTRIES", 60)
    large = [(i, "the cat sat on the mat and the dog sat on the log", "en") for i in range(9)]
    models = langid.train(docs(spark, large + [(99, "ωραία μέρα", "el")]))
    assert set(models) == {"el", "en"}
    assert [r["language"]["pred"] for r in langid.identify(docs(spark, [(1, "ωραία μέρα")]), models).collect()] == ["el"]
