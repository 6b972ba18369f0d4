from collections import Counter

from helpers import EXTRA, LONG, docs

import corpus_pipeline
from skyrank.llm import langid, mixing
from test_decontaminate import slow as slow_contamination
from test_simhash import slow_components, slow_fingerprint

DIR = "/root/testdata/sf0.001"


def steps(spark, given, sf_dir):
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, given, sf_dir)
        yield name, given, after
        given = after


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def check(spark, given, sf_dir):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = []
    for name, before, after in steps(spark, given, sf_dir):
        seen.append(name)
        old, new = rows_of(before), rows_of(after)
        if name == "language_id":
            gone = Counter(old) - Counter(new)
            assert all(not any(c.isalpha() for c in r[1] or "") for r in gone)
        if name == "near_dedup":
            roots = slow_components([(r[0], slow_fingerprint(r[1])) for r in old])
            assert Counter(r[0] for r in new) == Counter({v: 1 for v in set(roots.values())})
        if name == "benchmark_decontamination":
            clean = Counter(r[0] for r in slow_contamination(old, bench) if not r[5])
            assert Counter(r[0] for r in new) == clean
        if name == "source_mixing":
            report = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_report(before).collect()}
            counts = Counter(r[0] for r in new)
            assert all(counts[d] * s == t for d, (s, t) in report.items() if s)
        if name == "sharding":
            assert Counter(old) == Counter(new) and {"slot", "shard"} <= set(after.columns)
        else:
            assert after.columns == before.columns
            if set(EXTRA) <= set(after.columns):    # clashing columns keep their values
                assert after.select(*EXTRA).distinct().collect() == [("x",) * len(EXTRA)]
    assert seen == ["language_id", "near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]


def test_every_stage_against_brute_force(spark):
    check(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR)


def test_odd_rows_pass_every_stage(spark):
    good = spark.read.parquet(f"{DIR}/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in good]
    rows += [(9001, None, "en", "src0"), (9002, "", None, None), (9003, "12 !", "en", None), (9004, rows[0][1] * 40, "en", None),
             (9005, rows[1][1], None, "src1"), rows[2]]
    check(spark, docs(spark, rows, extra=True), DIR)


def test_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0
    given = docs(spark, [])
    for _, _, given in steps(spark, given, DIR):
        pass
    assert given.collect() == []
