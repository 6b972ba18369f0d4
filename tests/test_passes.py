"""What the scoring run does once, it does not do again."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skyrank.operators import starts, tracks
from skyrank.plans.race import Race
from skyrank.plans.scoring import Scoring
from skyrank.session import cut, cut_dealt, spread
from skyrank.streaming import live


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def fixes(spark):
    rows = [("T1" if p % 2 else None, f"p{p % 9}" if p else None, 1000 + (s * 7) % 60, 42 + s / 1e4, 1.0 + p / 1e3, 500 + s, 480)
            for p in range(12) for s in range(60)]
    df = spark.createDataFrame(rows, "task_id string, pilot_id string, t long, lat double, lon double, alt_gps int, alt_baro int")
    one = df.groupBy("task_id", "pilot_id", "t").agg(*[F.min(c).alias(c) for c in ("lat", "lon", "alt_gps", "alt_baro")])
    return one.withColumns({"x": F.col("lat") * 1e5, "y": F.col("lon") * 1e5})


def test_a_dealt_track_holds_what_a_cut_one_holds_and_is_not_shuffled_again(spark, fixes):
    dealt, plain = cut_dealt(fixes, tracks.indexed_track), cut(tracks.indexed_track(fixes))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert dealt.schema == plain.schema and dealt.count() == plain.count() > 300
    assert dealt.exceptAll(plain).count() == 0
    lead = dealt.withColumn("n", F.lead("t").over(tracks.by_time()))
    assert "Exchange" not in plan(tracks.track_facts(dealt)) and "Exchange" not in plan(lead) and "Sort" not in plan(lead)
    legs = spread(dealt.select(*tracks.KEY).distinct(), *tracks.KEY).hint("merge")
    assert plan(dealt.join(legs, tracks.KEY)).count("Exchange") == plan(legs).count("Exchange")
    assert cut_dealt(fixes.limit(0), tracks.indexed_track).count() == 0


def test_the_track_of_a_run_is_dealt_by_pilot(spark, fixes):
    run = Scoring(None, None, None)
    run.__dict__["fixes"] = fixes
    assert "Exchange" not in plan(tracks.track_facts(run.track))
    assert starts.track_facts(run.track).count() == fixes.select(*tracks.KEY).distinct().count()


@pytest.fixture()
def race(spark, tmp_path):
    spark.createDataFrame([(11,), (12,), (25,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    reports = [(k, s, 1 + i % 7, 0, 10.0 + i, 26.0) for k in (11, 25) for i, s in enumerate((0, 0, 100, 5400, 6000, 9000))]
    spark.createDataFrame(reports, "l_suppkey long, l_orderkey long, l_linenumber long, l_partkey long, l_extendedprice double, l_quantity double"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = Race(spark, str(tmp_path))
    c.__dict__["s"] = SimpleNamespace(
        course=c.views.task_rows(), rims=c.views.task_rows().select("task_id", F.lit(3).alias("wp_ix")),
        board=c.views.task_rows().select("task_id", F.lit(1).alias("rank")))
    return c


def test_a_moment_is_scored_without_the_others(race):
    run = race.as_of(4500)
    assert sorted(r.task_id for r in run.task_rows.collect()) == ["T1@4500", "T2@4500"]
    assert race.as_of(4500) is run
    assert sorted((r.task_id, r.wp_ix) for r in run.rims.collect()) == [("T1@4500", 3), ("T2@4500", 3)]
    assert {r.now - r.gate for r in run.course.collect()} == {4500}
    ladder = race.ladder
    assert race.as_of(1800) is ladder
    assert {r.now - r.gate for r in ladder.course.collect()} == {1800, 4500, 7200}


def test_pairs_hear_what_was_reported_up_to_their_moment(race):
    """The same fixes as tagging all reports, settling each second and leaving out what is later."""
    one = tracks.first_reports(race.views.raw_fixes()).join(race.views.task_rows().select("task_id", "gate"), "task_id")
    want = {(f"{r.task_id}@{m}", r.pilot_id, r.t, r.lat) for r in one.collect() for m in (1800, 4500, 7200) if r.t <= r.gate + m}
    rows = [(r.task_id, r.pilot_id, r.t, r.lat) for r in race.ladder._fixes.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_a_run_takes_the_course_and_rims_it_is_given(spark, monkeypatch):
    course, rims = spark.range(1), spark.range(2)
    run = Scoring(None, None, None, course=course, rims=rims)
    assert run.course is course and run.rims is rims
    seen = {}

    def scoring(fixes, tasks, waypoints, **given):
        seen.update(given, fixes=fixes)
        state = fixes.select("task_id", "pilot_id", F.lit("again").alias("state"))
        return SimpleNamespace(staged_state=state, course=given["course"])

    monkeypatch.setattr(live, "Scoring", scoring)
    monkeypatch.setattr(live, "score_field", lambda state, course: (state, course))
    old = spark.createDataFrame([("T", "a", "old"), ("T", "b", "old"), (None, "c", "old")], "task_id string, pilot_id string, state string")
    late = spark.createDataFrame([("T", "a"), ("T", "a"), (None, "c")], "task_id string, pilot_id string")
    state, given = live.rescore_touched(old, late, old.drop("state"), None, None, course, rims)
    assert given is course and seen["rims"] is rims
    assert "Exchange hashpartitioning" not in plan(seen["fixes"])
    assert sorted(tuple(r) for r in state.select("pilot_id", "state").collect()) == [("a", "again"), ("b", "old"), ("c", "old")]


def test_a_board_read_twice_is_written_once(race):
    assert race.board is race.board and "FileScan parquet" in plan(race.board)
    assert sorted(r.task_id for r in race.board.collect()) == ["T1", "T2"]
