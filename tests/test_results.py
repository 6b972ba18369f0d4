"""Saving results: what a save replaces and what it leaves alone."""

from skyrank.sinks.results import ResultTables

STATE = "task_id string, latest_epoch bigint, point_count bigint, dirty boolean"
SCORED = "task_id string, processed_epoch bigint, point_count bigint, status string, summary string, error string"
BOARD = "task_id string, pilot_id string, rank int, state string, score double, distance_m double"


def test_a_save_replaces_the_scored_tasks_only(spark, tmp_path):
    tables = ResultTables(spark, str(tmp_path))
    assert tables.pilots().count() == tables.summaries().count() == tables.state().count() == 0
    tables.put_state(spark.createDataFrame([(t, 100, 5, True) for t in "ABCD"], STATE))
    row = lambda t, p, s: (t, p, 1, "GOAL", s, 10.0)
    tables.save(spark.createDataFrame([(t, 90, 4, "ok", "first", "") for t in "ABCD"], SCORED),
                spark.createDataFrame([row(t, p, 1.0) for t in "ABCD" for p in "xy"], BOARD))
    assert all(r.dirty for r in tables.state().collect())    # points have come since
    # A is scored anew, B has a point more than was scored, C fails, D has no pilot left
    tables.save(spark.createDataFrame([("A", 100, 5, "ok", "second", "x"), ("B", 100, 4, "ok", "second", ""), ("C", 100, 5, "error", "lost", "no track"),
                                       ("D", 100, 5, "ok", "second", "")], SCORED),
                spark.createDataFrame([row("A", "x", 2.0), row("B", "z", 3.0), row("C", "x", 9.0)], BOARD))
    assert sorted((r.task_id, r.pilot_id, r.score) for r in tables.pilots().collect()) == [
        ("A", "x", 2.0), ("B", "z", 3.0), ("C", "x", 1.0), ("C", "y", 1.0)]
    assert sorted(tuple(r) for r in tables.summaries().collect()) == [
        ("A", 100, 5, "ok", "second", ""), ("B", 100, 4, "ok", "second", ""), ("C", 100, 5, "error", "{}", "no track"), ("D", 100, 5, "ok", "second", "")]
    assert {r.task_id: r.dirty for r in tables.state().collect()} == {"A": False, "B": True, "C": True, "D": False}
    tables.save(spark.createDataFrame([("C", 100, 5, "ok", "third", "")], SCORED), spark.createDataFrame([row("C", "y", 4.0)], BOARD))
    assert sorted((r.task_id, r.pilot_id) for r in tables.pilots().collect()) == [("A", "x"), ("B", "z"), ("C", "y")]
    assert {r.task_id: r.status for r in tables.summaries().collect()}["C"] == "ok"
