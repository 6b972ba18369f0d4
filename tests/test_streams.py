"""The stream runner: micro-batches, repeats, timers, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from skyrank.sinks import exports
from skyrank.streaming import events as ev
from skyrank.streaming import live, silence


def line(n, kind, data, comp="C", schema=ev.SCHEMA, eid=None):
    return json.dumps({"schema": schema, "event_id": eid or f"{comp}{n}", "competition_id": comp, "sequence": n,
                       "observed_at": "2025-06-15T12:00:00Z", "type": kind, "data": data})


@pytest.fixture()
def log(tmp_path):
    pos = lambda n, p, t: line(n, "position", {"pilot_id": p, "timestamp": t, "lat": 42.0, "lon": 1.0, "alt_gps": 900})
    first = [line(1, "competition.upsert", {"config": {}}), line(2, "task.upsert", {"name": "T"}),
             line(3, "pilot.upsert", {"pilot_id": "a"}), pos(5, "a", 101), pos(4, "a", 100), "not json",
             line(6, "position", "text")]
    second = [pos(5, "a", 101), pos(7, "b", 102), pos(8, "a", 103), line(9, "competition.status", {"status": "final"})]
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "1.txt").write_text("\n".join(first) + "\n")
    (folder / "2.txt").write_text("\n".join(second) + "\n")
    return folder, first + second


def test_micro_batches_store_what_one_batch_stores(spark, log, tmp_path):
    folder, lines = log
    tables = live.LiveTables(spark, str(tmp_path / "tables"))
    live.run_available(ev.read_log(spark, str(folder)), tables, str(tmp_path / "checkpoint"))
    stored = tables.read("fixes", live.FIXES)
    assert sorted(r.t for r in stored.collect()) == [100, 101, 103]
    reasons = {r.reason for r in tables.read("dead_letters", "value string, reason string").collect()}
    assert {"not an object", "data is not an object", "event id already seen", "unknown pilot"} <= reasons
    batch = live.batch_tables(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert batch.exceptAll(stored.select(*batch.columns)).count() == 0
    assert stored.select(*batch.columns).exceptAll(batch).count() == 0
    live.run_available(ev.read_log(spark, str(folder)), tables, str(tmp_path / "checkpoint"))
    assert tables.read("fixes", live.FIXES).count() == 3


def test_late_rows_and_late_setup_arrive_in_the_end(spark, tmp_path):
    pos = lambda n, p, t: line(n, "position", {"pilot_id": p, "timestamp": t, "lat": 42.0, "lon": 1.0, "alt_gps": 900})
    batches = [[line(1, "competition.upsert", {}), line(2, "task.upsert", {}), pos(9, "a", 109), pos(12, "a", 112)],
               [pos(10, "a", 110), pos(9, "a", 109)], [line(3, "pilot.upsert", {"pilot_id": "a"})],
               [pos(11, "a", 111), pos(4, "z", 104), pos(10, "a", 110)], [pos(12, "a", 112), pos(13, "a", 113)]]
    folder = tmp_path / "log"
    folder.mkdir()
    tables, touched = live.LiveTables(spark, str(tmp_path / "tables")), {}
    for i, rows in enumerate(batches):
        (folder / f"{i}.txt").write_text("\n".join(rows) + "\n")
        live.run_available(ev.read_log(spark, str(folder)), tables, str(tmp_path / "checkpoint"),
                           lambda who, n: touched.update({n: [tuple(r) for r in who.collect()]}))
    assert tables.batches("events", live.EVENTS) == 5
    assert sorted(r.t for r in tables.read("fixes", live.FIXES).collect()) == [109, 110, 111, 112, 113]
    assert touched == {0: [], 1: [], 2: [("C", "a")], 3: [("C", "a")], 4: [("C", "a")]}
    assert [r.t for r in tables.last("waiting", live.FIXES, 5).collect()] == [104]
    assert sorted((r.low, r.high) for r in tables.last("taken", ev.TAKEN, 5).collect()) == [(1, 4), (9, 13)]
    letters = tables.read("dead_letters", "value string, reason string").where("reason = 'event id already seen'").collect()
    assert sorted(json.loads(r.value)["sequence"] for r in letters) == [9, 10, 12]


def test_a_stream_publishes_on_cadence_and_on_status(spark, tmp_path):
    """Documents on disk at the last 25th sequence of a batch and at the final status, equal to a batch run's board."""
    from skyrank.fixtures import Views
    from skyrank.operators.ranking import final_ranking
    from skyrank.operators.tracks import first_reports
    from skyrank.plans.scoring import Scoring
    v = Views(spark, "/root/testdata/sf0.001")
    task = v.task_rows().orderBy("task_id").first()["task_id"]
    mine = lambda d: d.where(F.col("task_id") == task)
    tasks, waypoints = mine(v.task_rows()), mine(v.waypoint_rows())
    some = [r.pilot_id for r in mine(v.pilots()).orderBy("pilot_id").limit(4).collect()]
    fixes = first_reports(mine(v.raw_fixes())).where(F.col("pilot_id").isin(some) & (F.col("t") % 7 == 0)).withColumns(
        {c: F.col(c).cast("int") for c in ("alt_gps", "alt_baro")}).checkpoint()
    pilots = mine(v.pilots()).where(F.col("pilot_id").isin(some)).join(tasks.select("task_id", "midnight"), "task_id")
    lines = ev.envelope(ev.export_log(tasks, pilots, fixes)).select(F.col("sequence").alias("arrival"), "value").checkpoint()
    n = lines.count()
    cut = n // 2
    tables = live.LiveTables(spark, str(tmp_path / "tables"))
    publish = live.publish_due(tables, tasks, waypoints, str(tmp_path / "out"))
    for part in (lines.where(F.col("arrival") <= cut), lines.where(F.col("arrival") > cut)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        live.run_available(ev.read_offset_log(spark, str(tmp_path / "log")), tables, str(tmp_path / "checkpoint"), on_due=publish)
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "versions")).collect()]
    assert sorted((d["source_sequence"], d["status"], d["provisional"]) for d in docs) == [
        (cut // 25 * 25, "open", True), (n, "final", False)]
    run = Scoring(fixes, tasks, waypoints)
    want = sorted((r.rank, r.pilot_id, r.state, r.total_points) for r in final_ranking(run.scores).collect())
    (last,) = [d for d in docs if d["status"] == "final"]
    assert sorted((r["rank"], r["pilot"], r["state"], r["total_points"]) for r in last["results"]) == want and want
    (latest,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "latest")).collect()]
    assert latest == last


def test_ids_and_sequences_are_remembered_over_batches_and_restarts(spark, tmp_path):
    """The first arrival decides, inside a batch and between batches, however the log is cut."""
    pos = lambda n, eid, alt: line(n, "position", {"pilot_id": "a", "timestamp": 100 + n, "lat": 42.0, "lon": 1.0, "alt_gps": alt}, eid=eid)
    rows = [line(1, "competition.upsert", {}), line(2, "task.upsert", {}), line(3, "pilot.upsert", {"pilot_id": "a"}),
            pos(10, "x", 900), pos(10, "x", 777), pos(11, "y", 888), pos(11, "y", 111), pos(20, "x", 905), pos(11, "z", 100),
            pos(21, "z", 906), pos(12, "w", 907), "no json", "no json", pos(12, "w", 1)]
    want = [(10, 900), (11, 888), (12, 907)]
    for size in (4, len(rows)):
        root = tmp_path / f"by{size}"
        schema = "arrival bigint, value string"
        for i in range(0, len(rows), size):
            spark.createDataFrame(list(enumerate(rows))[i:i + size], schema).coalesce(1).write.mode("append").parquet(str(root / "log"))
            if size == 4:    # each batch is a restart from the checkpoint
                live.run_available(ev.read_offset_log(spark, str(root / "log")), live.LiveTables(spark, str(root)), str(root / "checkpoint"))
        tables = live.LiveTables(spark, str(root))
        live.run_available(ev.read_offset_log(spark, str(root / "log")), tables, str(root / "checkpoint"))
        assert sorted((r.sequence, r.alt_gps) for r in tables.read("fixes", live.FIXES).collect()) == want
        reasons = sorted(r.reason for r in tables.read("dead_letters", "value string, reason string").collect())
        assert reasons == ["event id already seen"] * 5 + ["not an object"] * 2 + ["sequence already taken"]
        batch = live.batch_tables(spark.createDataFrame(list(enumerate(rows)), schema))
        assert sorted((r.sequence, r.alt_gps) for r in batch.collect()) == want


def test_stream_watches_silence(spark, tmp_path):
    data = tmp_path / "fixes"
    schema = "task_id string, pilot_id string, t bigint"
    for i, rows in enumerate([[("T", "a", 1000), ("T", "b", 1000)], [("T", "a", 1060)], [("T", "a", 1500)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(data))
        import os
        for f in data.glob("*.json"):
            os.utime(f, (1700000000 + i, 1700000000 + i)) if i == 0 else None
    fixes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(data))
    q = silence.watch_silence(fixes).writeStream.format("memory").queryName("silence").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = {(r.pilot_id, r.tracking) for r in spark.table("silence").collect()}
    assert ("a", "ONLINE") in seen and ("b", "ONLINE") in seen
    assert ("b", "LOST") in seen


def test_exported_log_reads_back_as_canonical_events(spark):
    tasks = spark.createDataFrame([("T", 0, 1.0, 2.0, 3.0)], "task_id string, midnight bigint, nominal_distance double, minimum_distance double, nominal_time double")
    pilots = spark.createDataFrame([("T", "a", "A", 0)], "task_id string, pilot_id string, name string, midnight bigint")
    fixes = spark.createDataFrame([("T", "a", 60, 42.0, 1.0, 9, 8), ("T", "a", 50, 42.0, 1.0, 9, 8)],
                                  "task_id string, pilot_id string, t bigint, lat double, lon double, alt_gps int, alt_baro int")
    lines = ev.envelope(ev.export_log(tasks, pilots, fixes, 10))
    rows = ev.checked(lines.select("value")).collect()
    assert {r.reason for r in rows} == {None}
    assert sorted(r.sequence for r in rows) == list(range(11, 17))
    assert [r.t for r in ev.positions(ev.split_log(lines.select("value"))[0]).orderBy("sequence").collect()] == [50, 60]


def test_partitioned_writers_replace_only_their_tasks(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = lambda task, n: spark.createDataFrame([(task, f"p{i}", i) for i in range(n)], "task_id string, pilot_id string, t bigint")
    exports.write_task_partitions(rows("A", 5).unionByName(rows("B", 3)), path)
    exports.write_task_partitions(rows("A", 2), path)
    got = {r.task_id: r["count"] for r in spark.read.parquet(path).groupBy("task_id").count().collect()}
    assert got == {"A": 2, "B": 3}


def test_ids_are_marked_by_groups_and_forgotten_after_their_last_arrival():
    """One Python call marks all lines of a group; what lies in its state is an id with its last arrival."""
    import pandas as pd

    class State:
        hasTimedOut, get, until = False, None, None
        exists = property(lambda self: self.get is not None)
        update = lambda self, value: setattr(self, "get", value)
        setTimeoutTimestamp = lambda self, ms: setattr(self, "until", ms)
        getCurrentWatermarkMs = lambda self: 0

    columns = [c.split()[0] for c in ev.REMEMBERED.split(", ") if not c.startswith("repeated")]
    step, state = ev._remember(60), State()

    def feed(now, *rows):
        d = pd.DataFrame([{**dict.fromkeys(columns), "value": f"{i}/{a}", "arrival": a, "sequence": 2 ** 60 + a, "id": i, "heard": pd.Timestamp(now, unit="s", tz="UTC")}
                          for i, a in rows])
        (out,) = step((0,), [d], state)
        assert (out["sequence"] == 2 ** 60 + out["arrival"]).all()
        return dict(zip(out["value"], out["repeated"].tolist()))

    assert feed(1000, ("x", 2), ("y", 3), ("x", 1), (None, 4), (None, 5)) == {
        "x/1": False, "x/2": True, "y/3": False, "None/4": False, "None/5": False}
    assert feed(1050, ("x", 6), ("z", 7)) == {"x/6": True, "z/7": False}
    assert feed(1070, ("x", 8), ("y", 9)) == {"x/8": True, "y/9": False}
    assert sorted(state.get[0]) == ["x", "y", "z"] and state.until == 1_130_000


def test_the_batch_side_parses_lines_once(spark, log):
    """What is left of the plan after the events are kept no longer holds the envelope of a line."""
    batch = live.batch_tables(spark.createDataFrame([(x,) for x in log[1]], "value string"))
    assert "json_object_keys" not in batch._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.t for r in batch.collect()) == [100, 101, 103]


def test_surplus_counts_what_except_all_leaves(spark):
    rows = [("a", 1, 1.0), ("a", 1, 1.0), ("a", 1, 1.0), (None, 2, None), (None, 2, None), ("b", None, 0.5)]
    others = [("a", 1, 1.0), (None, 2, None), (None, 2, None), (None, 2, None), ("c", 3, 2.0), ("c", 3, 2.0)]
    frame = lambda some: spark.createDataFrame(some, "k string, n int, x double")
    for left, right in ((rows, others), (others, rows), (rows, rows), (rows, []), ([], [])):
        a, b = frame(left), frame(right)
        assert tuple(live.surplus(a, b).first()) == (a.exceptAll(b).count(), b.exceptAll(a).count())
