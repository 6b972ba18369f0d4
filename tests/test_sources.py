"""Readers on real files: logger files, zips, encodings, task, official and parameter files."""

import json
import zipfile

from pyspark.sql import functions as F

from skyrank.sources import igc, official, penalties_json, tasks_json
from skyrank.operators.ranking import spread_row_number, spread_running_max

IGC = (b"AXXX\r\nHFDTE150625\r\nHFPLTPILOT: Jos\xe9 \r\nB2359504200000N00100000WA0010000110\r\n"
       b"B0000104200000S00100000EA0010000110\r\nB0000114200000N00100000EV0010000110\r\nB00001\r\n"
       b"B000012420X000N00100000EA0010000110\r\nB0000134230000N00130000EA-010000110\r\n")


def test_igc_files_and_zips(spark, tmp_path):
    (tmp_path / "a_b.igc").write_bytes(IGC)
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.writestr("0157.IGC", IGC.replace(b"HFPLTPILOT: Jos\xe9 ", b"HFPLTPILOT:"))
        z.writestr("notes.txt", b"x")
    rows = igc.read_igc(spark, str(tmp_path)).orderBy("path", "line_no").collect()
    first = [r for r in rows if not r.path.endswith("IGC")]
    day = 1749945600
    assert [r.t for r in first] == [day + 86390, day + 86410, day + 86413]
    assert [(r.lat, r.lon) for r in first] == [(42.0, -1.0), (-42.0, 1.0), (42.5, 1.5)]
    assert [r.alt_baro for r in first] == [100, 100, -100]
    assert {r.pilot for r in first} == {"José"}
    assert {r.pilot for r in rows if r.path.endswith("IGC")} == {"0157"}
    heads = igc.scan_headers(igc.header_lines(igc.igc_files(spark, str(tmp_path)))).collect()
    assert {(h.day, h.pilot_key) for h in heads} == {(day, "josé"), (day, "0157")}


def test_task_files(spark, tmp_path):
    doc = {"radius_tolerance": 0.5, "turnpoints": [
        {"radius": 400, "waypoint": {"name": "A", "lat": 42.0, "lon": 1.0}},
        {"radius": 1000, "type": "SSS", "waypoint": {"name": "B", "lat": 42.1, "lon": 1.0, "altSmoothed": 900}}],
        "sss": {"type": "RACE", "timeGates": ["12:30:00Z", "12:00:00Z"]}, "goal": {"deadline": "17:00:00Z"}}
    (tmp_path / "Task.xctsk").write_text(json.dumps(doc))
    days = spark.createDataFrame([("Task", 1000)], "task_id string, date_epoch bigint")
    tasks, wps = tasks_json.read_tasks(spark, str(tmp_path), days)
    t = tasks.first()
    assert (t.gates, t.deadline, t.radius_tolerance, t.goal_elevation) == ([44200, 46000], 62200, 0.005, 300.0)
    assert [(w.name, w.declared, w.alt) for w in wps.orderBy("wp_ix").collect()] == [("A", None, 0.0), ("B", "SSS", 900.0)]


def test_official_and_penalty_files(spark, tmp_path):
    (tmp_path / "T.tsv").write_text("# note\n1\t0157\tA. B\t13:30:00\t-\t1:48:06\t150\t30.6\t59.9\t361.7\t168.0\t(-)\t-1.5\t998.5\nshort\trow\n")
    row = official.read_official(spark, str(tmp_path / "T.tsv")).first()
    assert (row.rank, row.pid, row.start_s, row.finish_s, row.time_s, row.spd_p, row.score) == (1, "0157", 48600, None, 6486, None, 998.5)
    (tmp_path / "p.json").write_text(json.dumps({"T": [{"pilot": "157", "reason": "x", "points": 5}, {"pilot": "1"}, {"pilot": "1", "reason": "y", "poinst": 1}]}))
    good, bad = penalties_json.read_penalties(spark, str(tmp_path / "p.json"))
    assert [(g.pilot_key, g.points) for g in good.collect()] == [("157", 5.0)]
    assert sorted(b.error for b in bad.collect()) == ["no reason", "unknown keys poinst"]


def test_spread_windows_equal_plain_ones(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 500).alias("v"), "id")
    got = spread_row_number(df, ["g"], [F.floor(-F.col("v") / 40)], [F.col("v").desc(), F.col("id")], "n")
    plain = {}
    for r in sorted(df.collect(), key=lambda r: (r.g, -r.v, r.id)):
        plain.setdefault(r.g, []).append(r.id)
    assert all(plain[r.g][r.n - 1] == r.id for r in got.collect())
    maxima = spread_running_max(df, ["g"], F.floor(F.col("id") / 100), [F.col("id")], F.col("v"), "m").orderBy("id").collect()
    top = {}
    for r in maxima:
        assert r.m == top.get(r.g)
        top[r.g] = max(top.get(r.g, -1), r.v)
