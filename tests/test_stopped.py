"""Stopped tasks: windows, the reference pilot, bonuses, and flights whose end after the stop must not count."""

import pytest
from pyspark.sql import functions as F
from test_flights import DAY, GATE, WAYPOINTS, track

from skyrank.operators import stopped as st
from skyrank.plans.scoring import Scoring
from skyrank.plans.stopping import StoppedScoring

STOP = GATE + 4500
COURSE = "task_id string, first_gate bigint, start_type string, gates array<bigint>, total_m double"
SCORES = ("task_id string, pilot_id string, start_t bigint, ess_t bigint, goal_t bigint, landing_t bigint, section_s double, "
          "time_points double, leading_points double")


def stops(spark, *tasks):
    return spark.createDataFrame([(t, STOP + 300, 300, 3600, 5.0) for t in tasks],
                                 "task_id string, announced_t bigint, score_back_s int, minimum_time_s int, glide_ratio double")


@pytest.fixture(scope="module")
def spans(spark):
    course = spark.createDataFrame([("race", GATE, "RACE", [GATE], 20000.0), ("gates", GATE, "RACE", [GATE, GATE + 900], 20000.0),
                                    ("trial", GATE, "TIME_TRIAL", [GATE], 20000.0), ("nobody", GATE, "TIME_TRIAL", [GATE], 20000.0)], COURSE)
    starts = spark.createDataFrame([("race", "a", GATE), ("race", "b", None), ("gates", "a", GATE), ("gates", "b", GATE + 900),
                                    ("trial", "a", GATE + 100), ("trial", "b", GATE + 1000), ("nobody", "a", None)],
                                   "task_id string, pilot_id string, start_t bigint")
    return starts, st.scored_spans(starts, stops(spark, "race", "gates", "trial", "nobody"), course)


def test_windows_are_common_or_of_equal_length(spans):
    starts, rows = spans
    assert {r.task_id: r.span_s for r in rows.collect()} == {"race": 4500, "gates": 3600, "trial": 3500, "nobody": None}
    found = {(r.task_id, r.pilot_id): (r.from_t - GATE, r.to_t - GATE) for r in st.scored_windows(starts, rows).collect()}
    assert found == {("race", "a"): (0, 4500), ("gates", "a"): (0, 3600), ("gates", "b"): (900, 4500),
                     ("trial", "a"): (100, 3600), ("trial", "b"): (1000, 4500)}


def test_fixes_end_with_the_window_or_the_stop(spark, spans):
    starts, rows = spans
    fixes = spark.createDataFrame([(k, p, GATE + s) for k in ("race", "gates", "other") for p in ("a", "b") for s in (3600, 3601, 4500, 4501)],
                                  "task_id string, pilot_id string, t bigint")
    kept = st.within_windows(fixes, st.scored_windows(starts, rows), stops(spark, "race", "gates")).collect()
    last = {(r.task_id, r.pilot_id): max(x.t for x in kept if x[:2] == r[:2]) - GATE for r in kept}
    assert last == {("race", "a"): 4500, ("race", "b"): 4500, ("gates", "a"): 3600, ("gates", "b"): 4500}


def points_of(spark, spans, rows, goals, down=()):
    """Stopped points of one single-gate task whose best time is 3000 s and whose time pot is 400."""
    scores = spark.createDataFrame([("race", *r) for r in rows], SCORES)
    tasks = spark.createDataFrame([("race", goals, 3000.0 if goals else None, 400.0, 500.0)],
                                  "task_id string, pilots_goal int, best_time double, available_time double, available_distance double")
    bonuses = scores.select("task_id", "pilot_id", F.when(F.col("goal_t").isNotNull(), 20000.0).otherwise(10000.0).alias("stopped_distance_m"))
    landed = spark.createDataFrame([("race", *d) for d in down], "task_id string, pilot_id string, landing_t bigint")
    return {r.pilot_id: r for r in st.stopped_points(scores, tasks, spans[1], landed, bonuses).collect()}


GOAL = ("goal", GATE, GATE + 3000, GATE + 3200, None, 3000.0, 400.0, 80.0)
SLOW = ("slow", GATE, GATE + 4300, GATE + 4400, None, 4300.0, 20.0, 10.0)
BETWEEN = ("between", GATE, GATE + 3600, None, None, 3600.0, 0.0, 50.0)


def fraction(seconds, best=3000.0):
    return max(0.0, 1 - ((seconds - best) / 3600 / (best / 3600) ** 0.5) ** (5 / 6))


def test_nobody_in_goal_means_no_time_points_and_nothing_moves(spark, spans):
    got = points_of(spark, spans, [("between", GATE, GATE + 3600, None, None, 3600.0, 90.0, 50.0)], 0)["between"]
    assert (got.reduction, got.stopped_time_points, got.stopped_distance_points, got.stopped_total) == (0.0, 0.0, 500.0, 550.0)


def test_the_best_pilot_between_ess_and_goal_is_the_reference(spark, spans):
    got = points_of(spark, spans, [GOAL, SLOW, BETWEEN, ("later", GATE, GATE + 4000, None, None, 4000.0, 0.0, 0.0)], 2)
    cut = fraction(3600) * 400
    assert got["goal"].reduction == pytest.approx(cut)
    assert got["goal"].stopped_time_points == pytest.approx(400 - cut, abs=0.051)
    assert got["slow"].stopped_time_points == 0.0
    assert got["goal"].stopped_distance_points == pytest.approx(500 + cut, abs=0.051)
    assert got["between"].stopped_distance_points == pytest.approx((500 + cut) / 2, abs=0.051)
    assert got["goal"].leading_points == 80.0


@pytest.mark.parametrize("rows, down", [([GOAL], ()), ([GOAL, BETWEEN], [("between", GATE + 4000)]),
                                        ([GOAL, (*BETWEEN[:4], GATE + 4000, *BETWEEN[5:])], ())])
def test_with_nobody_between_the_reference_reaches_ess_at_the_stop(spark, spans, rows, down):
    assert points_of(spark, spans, rows, 1, down)["goal"].reduction == pytest.approx(fraction(4500) * 400)


def test_a_landing_after_the_stop_leaves_the_pilot_between(spark, spans):
    got = points_of(spark, spans, [GOAL, BETWEEN], 1, [("between", STOP + 60)])
    assert got["goal"].reduction == pytest.approx(fraction(3600) * 400)


@pytest.fixture(scope="module")
def stopped_run(spark):
    """One task, stopped 4500 s after its gate; every flight goes on after that."""
    flights = {
        "goal": [(GATE - 600, 42.0), (GATE + 60, 42.0), (GATE + 3000, 42.2), (GATE + 3060, 42.203), (GATE + 7000, 42.203)],
        "far": [(GATE - 600, 42.0), (GATE + 60, 42.0), (GATE + 4500, 42.15), (GATE + 6000, 42.2), (GATE + 6060, 42.203)],
        "short": [(GATE - 600, 42.0), (GATE + 60, 42.0), (GATE + 4500, 42.12), (GATE + 7000, 42.19)],
        "down": [(GATE - 600, 42.0), (GATE + 60, 42.0), (GATE + 4000, 42.13), (GATE + 7000, 42.13)],
        "late": [(GATE - 600, 42.0), (GATE + 5000, 42.0), (GATE + 7000, 42.1)],
    }
    rows = [("one", n, t, lat, 1.0, 1000, 1000) for n, pts in flights.items() for t, lat in track(pts)]
    tasks = spark.createDataFrame([("one", DAY, [GATE], GATE + 14400, "RACE"), ("open", DAY, [GATE], GATE + 14400, "RACE")],
                                  "task_id string, midnight bigint, gates array<bigint>, deadline bigint, start_type string").withColumns({
        "progress_curve": F.lit("WEIGHTED"), "goal_elevated": F.lit(False), "goal_elevation": F.lit(300.0),
        "nominal_distance": F.lit(20000.0), "minimum_distance": F.lit(1000.0), "nominal_time": F.lit(3600.0),
        "nominal_goal": F.lit(0.3), "nominal_launch": F.lit(0.96), "leading_time_ratio": F.lit(0.26),
        "ess_no_goal_time_factor": F.lit(0.0), "pilots_present": F.lit(None).cast("int"), "earth_model": F.lit("WGS84")})
    wps = spark.createDataFrame([(k, ix, n, d, lat, 1.0, rad, 500.0) for k in ("one", "open") for ix, n, d, lat, rad in WAYPOINTS],
                                "task_id string, wp_ix int, name string, declared string, lat double, lon double, radius double, alt double")
    fixes = spark.createDataFrame(rows, "task_id string, pilot_id string, t bigint, lat double, lon double, alt_baro int, alt_gps int")
    run = StoppedScoring(Scoring(fixes, tasks, wps, ellipsoid=True), stops(spark, "one"), ellipsoid=True)
    return run, {r.pilot_id: r for r in run.board.collect()}


def test_nothing_after_the_stop_counts(stopped_run):
    run, board = stopped_run
    assert {n: r.state for n, r in board.items()} == {"goal": "GOAL", "far": "STARTED", "short": "STARTED", "down": "STARTED", "late": "WAITING"}
    bonus = {r.pilot_id: r for r in run.bonuses.collect()}
    total = run.course.where("task_id = 'one'").first().total_m
    # 500 m above goal at 5 : 1 are worth 2.5 km to who still flies
    assert {n for n, r in bonus.items() if r.bonus_m == 2500.0} == {"far", "short"}
    assert bonus["far"].bonus_distance_m == pytest.approx(bonus["short"].bonus_distance_m + 0.03 * 111080, abs=60)
    assert bonus["down"].stopped_distance_m < bonus["far"].stopped_distance_m - 2500
    assert bonus["goal"].stopped_distance_m == pytest.approx(total)
    assert board["late"].distance_m == 0.0 and board["late"].total_points == 0.0


def test_the_stop_enters_validity_and_reduction(stopped_run):
    run, board = stopped_run
    (valid,) = run.validity.collect()
    assert (valid.reached_ess, valid.landed, valid.launched, valid.stopped_validity) == (1, 1, 4, 1.0)
    rows = {r.pilot_id: r for r in run.points.collect()}
    assert rows["goal"].reduction == pytest.approx(fraction(4500, rows["goal"].section_s) * rows["goal"].available_time)
    assert [board[n]["rank"] for n in ("goal", "far", "short", "down", "late")] == [1, 2, 3, 4, 5]
