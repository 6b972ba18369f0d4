"""Nothing is dropped beyond the sizes that used to be limits, and exact distances are exact."""

import itertools
import json
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from skyrank.functions import route
from skyrank.operators import audit, exact, ingest, landing, matching, ranking, starts, tracks
from skyrank.session import ensure_checkpoint_dir
from skyrank.sources import igc, pages


@pytest.mark.parametrize("radius", [400.0, 2005.0, 8005.0, 24000.0])
def test_exact_distance_against_a_grid_of_one_metre(spark, radius):
    xs, ys, rs = np.array([0.0, radius + 30000]), np.array([0.0, 5000.0]), np.array([radius, 400.0])
    _, points = route._layers(xs, ys, rs)
    value, _, _ = route._values(points, xs, ys, rs)
    k, p, v = len(points[0]), points[0], value[0]
    left, right = np.roll(v, 1), np.roll(v, -1)
    fine = 2 * np.pi * np.arange(int(2 * np.pi * radius)) / int(2 * np.pi * radius)
    fx, fy = radius * np.cos(fine), radius * np.sin(fine)
    onward = np.hypot(fx - xs[1], fy - ys[1]) - 400
    rows, want = [], []
    for step in (0.5, 3.5, k / 4 + 0.5, k / 2 + 0.25):
        for off in (1.0, 10.0, 50.0, 3000.0):
            angle = 2 * np.pi * step / k
            x, y = (radius + off) * np.cos(angle), (radius + off) * np.sin(angle)
            way = np.hypot(x - p[:, 0], y - p[:, 1]) + v
            q = int(way.argmin())
            rows.append((float(x), float(y), float(way[q]), q, float(v[q]), float(left[q]), float(right[q]), k, 0.0, 0.0, radius))
            want.append((np.hypot(x - fx, y - fy) + onward).min())
    df = spark.createDataFrame(rows, "x double, y double, d double, q int, v double, v_left double, v_right double, k int, zx double, zy double, zr double")
    point = F.struct("q", "v", "v_left", "v_right", "k", "zx", "zy", "zr")
    got = [r[0] for r in df.withColumn("p", point).select(
        F.least("d", exact.refined(F.col("x"), F.col("y"), F.col("p")))).collect()]
    assert np.abs(np.array(got) - want).max() < 0.1


def test_twelve_crossings_are_twelve_candidates(spark):
    crossings = [(i, 1000 + i, True) for i in range(12)]
    df = spark.createDataFrame(
        [("T", "p", crossings, None, None, ("RACE", [900, 1800]))],
        "task_id string, pilot_id string, crossings array<struct<fix_ix:int,t:bigint,after_gate:boolean>>, cut_ix int, next_ix int,"
        " c struct<start_type:string,gates:array<bigint>>")
    assert len(starts.start_candidates(df).first()["candidates"]) == 12
    assert len(starts.start_candidates(df, most=3).first()["candidates"]) == 3


def test_a_long_header_keeps_pilot_and_date(spark, tmp_path):
    body = "AXXX\n" + "LNOTE filler line of a chatty logger\n" * 600 + "HFDTEDATE:010625\nHFPLTPILOT:Ann Lee\nB1200004200000N00100000EA0100001000\nHFPLTPILOT:Late\n"
    assert len(body) > 20_000
    (tmp_path / "long.igc").write_text(body)
    r = igc.scan_headers(igc.header_lines(igc.igc_files(spark, str(tmp_path)))).first()
    assert r["pilot"] == "Ann Lee" and r["day"] == 1748736000


def test_every_gap_is_listed(spark):
    rows = [("T", "p", 10 * i, 5, 5) for i in range(27)]
    df = spark.createDataFrame(rows, "task_id string, pilot_id string, t bigint, alt_gps int, alt_baro int")
    assert len(tracks.track_integrity(df).first()["gaps_over_5s"]) == 26
    assert len(tracks.track_integrity(df, listed_gaps=20).first()["gaps_over_5s"]) == 20


def test_equal_order_never_mixes_rows(spark):
    rows = [("T", "p", 1, 1.0, 9.0, 1, 9, 7), ("T", "p", 1, 2.0, 8.0, 2, 8, 7)]
    df = spark.createDataFrame(rows, "task_id string, pilot_id string, t bigint, lat double, lon double, alt_baro int, alt_gps int, ord int")
    assert tuple(tracks.first_reports(df).select("lat", "lon", "alt_baro", "alt_gps").first()) in {(1.0, 9.0, 1, 9), (2.0, 8.0, 2, 8)}


def test_merged_documents_keep_their_types(spark):
    old, new = {"a": {"b": 1}, "n": 2, "l": [1, 2], "k": "x"}, {"k": 3.5, "t": True, "z": None}
    df = spark.createDataFrame([(json.dumps(old), json.dumps(new)), (None, json.dumps(new)), (json.dumps(old), None)], "o string, n string")
    got = [json.loads(r[0]) for r in df.select(ingest.merge_raw(F.col("o"), F.col("n"))).collect()]
    assert got == [{**old, **new}, new, old]


def test_an_inversion_inside_a_hundred_metres_is_seen(spark):
    rows = [("T", 1000.0, 10.0), ("T", 1030.0, 5.0), ("T", 1060.0, 20.0), ("T", 1030.0, 11.0)]
    df = spark.createDataFrame(rows, "task_id string, k double, hi double")
    tops = df.groupBy("task_id", "k").agg(F.max("hi").alias("hi"))
    got = ranking.spread_running_max(tops, ["task_id"], F.floor(F.col("k") / 1000), [F.col("k")], F.col("hi"), "prev")
    prev = {r["k"]: r["prev"] for r in got.collect()}
    assert prev == {1000.0: None, 1030.0: 10.0, 1060.0: 11.0}
    assert sum(prev[k] is not None and v < prev[k] for _, k, v in rows) == 1


def test_percentiles_by_counts(spark):
    values = [0.25, 0.5, 0.5, 0.75, 1.5, 7.0, 7.0, 7.25, 9.0, 11.0, 11.0]
    r = audit.sorted_index_percentiles(spark.createDataFrame([("a", v) for v in values], "kind string, v double"), "kind", "v").first()
    assert (r["p50"], r["p95"], r["max"], r["size"]) == (7.0, 11.0, 11.0, 11)


def test_a_clock_far_from_its_label_and_a_missing_one(spark):
    row = lambda kind: f'<tr><td>{kind}</td><td>1</td><td>N</td><td>0.4</td><td>42.5</td><td class="x">1.25</td></tr>'
    html = (f"<h3>2025-06-12</h3><p>StartGates <i>{'long note ' * 60}</i> 12:45</p><table>{row('TOFF')}{row('GOAL')}</table>")
    tasks, points = pages.task_config(spark.createDataFrame([(1, html)], "page_id long, html string"), "Europe/Madrid")
    t = tasks.first()
    assert (t["gate"], t["gate_given"], t["deadline"], t["deadline_given"]) == ("12:45", True, "17:00", False)
    assert points.count() == 2


class _Elsewhere:
    """A session whose executors are other machines."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Elsewhere())


def _tries_every_subset(orders, weights, least):
    """(length, pilots, zones) by trying all; among equals the earliest zones."""
    goal, best = len(orders[0]) - 1, None
    for used in itertools.product((1, 0), repeat=goal):
        picked = [i for i in range(goal) if used[i]] + [goal]
        n = sum(w for o, w in zip(orders, weights) if all(o[i] for i in picked) and [o[i] for i in picked] == sorted(o[i] for i in picked))
        if n >= least and (best is None or (len(picked), n) > best[:2]):
            best = (len(picked), n, picked)
    return best


def test_longest_chain_against_every_subset():
    rng = random.Random(5)
    for _ in range(150):
        zones, rows = rng.randrange(1, 8), rng.randrange(1, 25)
        orders = [[rng.choice([0, *range(1, zones + 1)]) if rng.random() < 0.5 else i + 1 for i in range(zones)] for _ in range(rows)]
        weights = [rng.randrange(1, 4) for _ in range(rows)]
        got = matching.longest_chain(np.array(orders), np.array(weights), 3)
        assert got == _tries_every_subset(orders, weights, 3)


def test_a_task_of_more_than_fifteen_zones_is_matched(spark):
    """24 zones; all fly them in order, but each of 30 pilots misses zone 5 and enters zone 9 late."""
    zones, rng = 24, random.Random(6)
    rows = [("T", p, z, 10 * z if z != 9 else 10 * zones - 5) for p in range(30) for z in range(zones) if z != 5]
    rows += [("T", 30 + p, z, rng.randrange(10 * zones)) for p in range(40) for z in range(zones) if rng.random() < 0.8]
    entries = spark.createDataFrame(rows, "task_id string, pilot_id int, wp_ix int, entry_t bigint")
    route = spark.createDataFrame([("T", list(range(zones)))], "task_id string, ixs array<int>")
    sizes = spark.createDataFrame([("T", 70)], "task_id string, pilots bigint")
    got = [tuple(r) for r in matching.longest_subroute(entries, route, sizes).collect()]
    assert got == [("T", zones - 2, 30, [z for z in range(zones) if z not in (5, 9)])]


def test_a_task_too_few_pilots_finished_has_no_subroute(spark):
    """Two of ten in goal are fewer than three: no row, beside a task that has one."""
    rows = [(task, p, z, 10 * z) for task, pilots in (("A", 2), ("B", 5)) for p in range(pilots) for z in range(3)]
    entries = spark.createDataFrame(rows, "task_id string, pilot_id int, wp_ix int, entry_t bigint")
    route = spark.createDataFrame([("A", [0, 1, 2]), ("B", [0, 1, 2])], "task_id string, ixs array<int>")
    sizes = spark.createDataFrame([("A", 10), ("B", 10)], "task_id string, pilots bigint")
    assert [tuple(r) for r in matching.longest_subroute(entries, route, sizes).collect()] == [("B", 3, 5, [0, 1, 2])]


def test_a_landing_is_found_without_a_pilots_anchors_on_every_fix(spark):
    """Fixes every 3 s, anchors from 30 s on: the walk of at least 5 s meets every second fix, 30 s first."""
    rows = [("T", p, i, 3 * i, 42.0 + i, 1.0, 500 + i) for p in ("a", "b") for i in range(40)]
    track = spark.createDataFrame(rows, "task_id string, pilot_id string, fix_ix int, t bigint, lat double, lon double, alt_gps int")
    anchors = spark.createDataFrame([("T", p, 3 * i, 3 * i + 180) for p, first in (("a", 10), ("b", 11)) for i in range(first, 40)],
                                    "task_id string, pilot_id string, t bigint, close_t bigint")
    search = spark.createDataFrame([("T", p, 6, 1000, None) for p in ("a", "b", "c")],
                                   "task_id string, pilot_id string, after_t bigint, before_t bigint, goal_fix int")
    found = landing.landings(track, search, anchors)
    got = {r["pilot_id"]: (r["landing_t"], r["landing_ix"], tuple(r["landing_at"]), r["goal_fix"]) for r in found.collect()}
    assert got == {"a": (30, 10, (52.0, 1.0, 510), None), "b": (36, 12, (54.0, 1.0, 512), None)}
    assert "first(held" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rims_of_tasks_leave_one_task_at_a_time_on_all_reducers(spark):
    import pyarrow as pa
    from skyrank.operators.tasks import route_values
    one = ([0.0, 9000.0, 30000.0], [0.0, 500.0 , 2000.0], [0.0, 2005.0, 405.0], 2)
    rows = [(f"T{i}", *one) for i in range(40)]
    names = ["task_id", "x", "y", "rr", "goal_ix"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    out = list(route.value_rows(iter([batch])))
    assert [set(b.column(0).to_pylist()) for b in out] == [{f"T{i}"} for i in range(40)]
    value, _, _ = route._values(route._layers(*one[:3])[1], *(np.asarray(v) for v in one[:3]))
    assert out[0].to_pandas().query("wp_ix == 1")["v"].tolist() == value[1].tolist()
    course = spark.createDataFrame(rows, "task_id string, x array<double>, y array<double>, rr array<double>, goal_ix int").select(
        "task_id", F.arrays_zip("x", "y").alias("wps"), "rr", "goal_ix").coalesce(1)
    got = route_values(course)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.groupBy("task_id").count().where(F.col("count") == sum(b.num_rows for b in out) // 40).count() == 40
