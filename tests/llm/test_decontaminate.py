import random
import re

from helpers import LONG, docs, tuples

from pyspark.sql import functions as F
from skyrank.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(rows, items, width=13):
    out = []
    for doc_id, text, *_ in rows:
        w, hit, of = words(text), set(), set()
        for item_id, item in items:
            p = words(item)
            n = min(width, len(p))
            for k in range(len(p) - n + 1 if p else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == p[k:k + n]:
                        hit |= set(range(i, i + n))
                        of.add("" if item_id is None else str(item_id))
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((doc_id, len(w), len(hit), str(spans), ",".join(sorted(of)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def result(df):
    c = F.col("contamination")
    rows = df.select("doc_id", c["n_words"], c["n_hit"], c["spans"], F.array_join(F.array_sort(c["items"]), ","),
                     decontaminate.is_contaminated()).collect()
    return sorted(((r[0], r[1], r[2], str([tuple(s) for s in r[3]]), r[4], r[5]) for r in rows),
                  key=lambda r: tuple((x is not None, str(x)) for x in r))


def cases(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)] + ["ünï", "Straße", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(30)), (2, say(13)), (10, say(4)), (3, None), (4, ""), (5, "..."), (1, say(15)), (None, say(14)), (7, "v1")]
    rows = [(i, say(rng.randint(0, 60))) for i in range(25)]
    rows += [(50 + k, f"start {t.upper()}! {say(3)}; {t}") for k, (_, t) in enumerate(items) if t]
    rows += [(70, None), (71, ""), (72, "!?"), (None, items[0][1]), (73, LONG + " " + items[0][1]), (73, LONG)]
    return rows, items


def test_against_brute_force(spark):
    rows, items = cases()
    bench = spark.createDataFrame(items, ITEMS)
    assert result(decontaminate.search(docs(spark, rows, extra=True), bench)) == slow(rows, items)


def test_without_short_items_unknown_words_fold_away(spark):
    rows, items = cases(6)
    items = [i for i in items if len(words(i[1])) >= 13]
    rows.append((90, "unknown words " + items[0][1] + " and more of them"))
    assert result(decontaminate.search(docs(spark, rows), spark.createDataFrame(items, ITEMS))) == slow(rows, items)


def test_small_shards_and_blocks_change_nothing(spark):
    rows, items = cases(7)
    bench = spark.createDataFrame(items, ITEMS)
    found = decontaminate.search(docs(spark, rows), bench, shard_bytes=200, block_bytes=150)
    assert result(found) == slow(rows, items)


def test_empty_tables(spark):
    rows, items = cases()
    assert decontaminate.search(docs(spark, []), spark.createDataFrame(items, ITEMS)).collect() == []
    assert result(decontaminate.search(docs(spark, rows), spark.createDataFrame([], ITEMS))) == slow(rows, [])


def test_clean_documents_stay_as_they_are(spark):
    rows, items = cases()
    given = docs(spark, rows, extra=True)
    kept = decontaminate.decontaminate(given, spark.createDataFrame(items, ITEMS))
    assert kept.columns == given.columns
    clean = [r for r in slow(rows, items) if not r[5]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in clean)
    assert tuples(kept.select("size").distinct()) == [("x",)]
