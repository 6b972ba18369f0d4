"""Synthetic flights with a known answer, all in one run."""

import pytest
from pyspark.sql import functions as F

from skyrank.operators.field import score_field
from skyrank.plans.scoring import Scoring

DAY = 1749945600
GATE = DAY + 43200


def track(points):
    """Straight legs between (time, latitude) points, a fix every five seconds."""
    out = []
    for (t0, a), (t1, b) in zip(points, points[1:]):
        for t in range(t0, t1, 5):
            out.append((t, a + (b - a) * (t - t0) / (t1 - t0)))
    out.append(points[-1])
    return out


NORTH = [(GATE + 60, 42.0), (GATE + 3000, 42.2), (GATE + 3060, 42.203)]
FLIGHTS = {
    # name: (task, latitude against time, expected start, in goal, early)
    "normal": ("one", [(GATE - 1200, 42.003), (GATE - 600, 42.0), *NORTH], GATE, True, False),
    "never_in": ("one", [(GATE - 600, 42.03), (GATE + 2400, 42.2)], None, False, False),
    "too_early": ("one", [(GATE - 1200, 42.0), (GATE - 300, 42.05), (GATE + 2400, 42.2)], None, False, True),
    "outside_in": ("one", [(GATE - 600, 41.97), (GATE + 100, 41.97), (GATE + 3000, 42.2), (GATE + 3060, 42.203)], GATE, True, False),
    "restart": ("two", [(GATE - 600, 42.0), (GATE + 60, 42.0), (GATE + 400, 42.03), (GATE + 1500, 42.0),
                        (GATE + 1900, 42.0), (GATE + 4900, 42.2), (GATE + 4960, 42.203)], GATE + 1800, True, False),
    "leaves_returns": ("one", [(GATE - 600, 42.0), (GATE + 60, 42.0), (GATE + 300, 42.02), (GATE + 540, 42.0),
                               (GATE + 3540, 42.2), (GATE + 3600, 42.203)], GATE, True, False),
}
WAYPOINTS = [(0, "D01", "TAKEOFF", 42.0, 400.0), (1, "D01", "SSS", 42.0, 1000.0), (2, "B10", None, 42.1, 400.0),
             (3, "G01", "ESS", 42.2, 1000.0), (4, "G01", None, 42.2, 400.0)]


@pytest.fixture(scope="module")
def scored(spark):
    fixes = [(task, name, t, lat, 1.0, 1000, 1000) for name, (task, pts, *_) in FLIGHTS.items() for t, lat in track(pts)]
    wps = [(task, ix, n, k, lat, 1.0, rad, 500.0) for task in ("one", "two") for ix, n, k, lat, rad in WAYPOINTS]
    tasks = spark.createDataFrame(
        [("one", DAY, [GATE], GATE + 14400, "RACE"), ("two", DAY, [GATE + 1800, GATE], GATE + 14400, "RACE")],
        "task_id string, midnight bigint, gates array<bigint>, deadline bigint, start_type string").withColumns({
            "progress_curve": F.lit("WEIGHTED"), "goal_elevated": F.lit(False), "goal_elevation": F.lit(300.0),
            "nominal_distance": F.lit(20000.0), "minimum_distance": F.lit(1000.0), "nominal_time": F.lit(3600.0),
            "nominal_goal": F.lit(0.3), "nominal_launch": F.lit(0.96), "leading_time_ratio": F.lit(0.26),
            "ess_no_goal_time_factor": F.lit(0.0), "pilots_present": F.lit(None).cast("int"), "earth_model": F.lit("WGS84")})
    run = Scoring(
        spark.createDataFrame(fixes, "task_id string, pilot_id string, t bigint, lat double, lon double, alt_baro int, alt_gps int"),
        tasks, spark.createDataFrame(wps, "task_id string, wp_ix int, name string, declared string, lat double, lon double, radius double, alt double"),
        ellipsoid=True)
    return run, {r.pilot_id: r for r in run.board.collect()}


@pytest.mark.parametrize("name", FLIGHTS)
def test_known_answer(scored, name):
    _, board = scored
    _, _, start, goal, early = FLIGHTS[name]
    row = board[name]
    assert row.start_t == start
    assert (row.goal_t is not None) == goal
    assert row.early_start == early


def test_last_crossing_before_the_next_zone_is_the_start(scored):
    _, board = scored
    assert board["leaves_returns"].start_cross_t > GATE + 540


def test_goal_scores_the_whole_task_and_early_start_the_first_leg(scored):
    run, board = scored
    course = {r.task_id: r for r in run.course.collect()}
    assert board["normal"].distance_m == pytest.approx(course["one"].total_m)
    assert board["too_early"].distance_m == pytest.approx(max(1000.0, course["one"].launch_to_sss_m))
    assert board["never_in"].state == "AIRBORNE"


def test_ranks_follow_points(scored):
    _, board = scored
    one = sorted((r for r in board.values() if r.task_id == "one"), key=lambda r: r["rank"])
    assert [r["rank"] for r in one] == list(range(1, len(one) + 1))
    keys = [(-r.total_points, -r.distance_m, r.pilot_id) for r in one]
    assert keys == sorted(keys)


def test_scoring_an_empty_field_is_zero(scored):
    run, _ = scored
    nobody = run.staged_state.withColumns({"takeoff_t": F.lit(None).cast("long"), "start_t": F.lit(None).cast("long"),
                                           "ess_t": F.lit(None).cast("long"), "goal_t": F.lit(None).cast("long"),
                                           "distance_m": F.lit(0.0), "section_s": F.lit(None).cast("double")})
    pilots, tasks = score_field(nobody, run.course)
    assert {r.task_validity for r in tasks.collect()} == {0.0}
    assert {r.total_points for r in pilots.collect()} == {0.0}
