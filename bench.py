"""Headline timings at one scale; prints one JSON line.

The board query is the whole job: raw reports to ranked boards of every task.  The
others read or reshape the same tables; those in ``SHARED`` only add their last steps to the
run that is already there.  The board of a tenth of the fixes shows what is fixed cost.  A small warm-up run comes first, so the
numbers are those of a running session and not of JVM start-up.
"""

from __future__ import annotations

import json
import os
import time

from skyrank.plans.catalog import QUERIES
from skyrank.plans.race import Race
from skyrank.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
TENTH_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.01")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
FRESH = ["score_field"]
SHARED = ["final_ranking", "classification", "points_derivation", "zone_reach", "track_integrity"]
TABLES = ["merge_sessions", "igc_ingest", "points_upsert", "late_data_classify", "events_export", "plausibility_quarantine"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "skyrank-bench")
    if os.path.isdir(WARM_DIR):
        warm = Race(spark, WARM_DIR)
        for name in FRESH + TABLES:
            run(QUERIES[name](warm))
    race, seconds = Race(spark, SF_DIR), {}
    for name in FRESH + SHARED + TABLES:
        start = time.perf_counter()
        run(QUERIES[name](race))
        seconds[name] = round(time.perf_counter() - start, 3)
    reports = race.views.raw_fixes().count()
    tenth = None
    if os.path.isdir(TENTH_DIR) and TENTH_DIR != SF_DIR.rstrip("/"):
        start = time.perf_counter()
        run(QUERIES["score_field"](Race(spark, TENTH_DIR)))
        tenth = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "fixes": reports, "fixes_per_sec_board": round(reports / seconds["score_field"]),
        "score_field_of_sf0.01": tenth}))
    spark.stop()


if __name__ == "__main__":
    main()
