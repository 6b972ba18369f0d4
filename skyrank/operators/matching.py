"""Does a task describe the flights?  Zone reach, start behaviour, flown sub-routes, reconstruction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import table
from .ranking import spread_row_number
from .tracks import KEY

MIN_REACH = 0.08
#: Bytes of search states that are remembered; beyond, a state may be met twice.
REMEMBERED = 64_000_000


def field_sizes(track: DataFrame) -> DataFrame:
    return track.groupBy("task_id", "pilot_id").agg(F.lit(1).alias("one")).groupBy("task_id").agg(
        F.count("*").alias("pilots"))


def _by_zone(track: DataFrame, course: DataFrame) -> DataFrame:
    rows = track.select(*KEY, "fix_ix", "t", "x", "y").join(course.select("task_id", "wps"), "task_id")
    return rows.select(*KEY, "fix_ix", "t", F.explode("wps").alias("z"), "x", "y").withColumn(
        "d", geo.distance(F.col("x"), F.col("y"), F.col("z.x"), F.col("z.y")))


def zone_reach(track: DataFrame, course: DataFrame) -> DataFrame:
    """Per waypoint: pilots whose closest fix lies inside, their share, the upper median distance."""
    nearest = _by_zone(track, course).groupBy(
        *KEY, F.col("z.wp_ix").alias("wp_ix"), F.col("z.kind").alias("kind"), F.col("z.radius").alias("radius")
    ).agg(F.min("d").alias("d"))
    ranked = spread_row_number(nearest, ["task_id", "wp_ix"], [F.floor(F.col("d") / 100)],
                               [F.col("d"), F.col("pilot_id")], "n")
    facts = nearest.groupBy("task_id", "wp_ix", "kind").agg(
        F.count_if(F.col("d") <= F.col("radius")).alias("reached"), F.count("*").alias("pilots"))
    joined = facts.join(ranked.select("task_id", "wp_ix", "n", "d"), ["task_id", "wp_ix"]).where(
        F.col("n") - 1 == F.floor(F.col("pilots") / 2))
    share = F.col("reached") / F.col("pilots")
    ground = F.col("kind").isin("SSS", "TAKEOFF")
    return joined.select("task_id", "wp_ix", "reached", "pilots", share.alias("share"),
                         F.col("d").alias("median_closest_m"),
                         F.when(ground & (share < 0.5), True).otherwise(share <= 0.05).alias("suspect"))


def start_analysis(events: DataFrame, course: DataFrame, sizes: DataFrame) -> DataFrame:
    """When the field really crossed the start: busiest minute inward and outward, suggested gate."""
    cross = events.where("is_sss and transition").select(*KEY, "t", "outward")
    enter = cross.where(~F.col("outward")).groupBy(*KEY).agg(F.min("t").alias("enter_t"))
    leave = cross.where("outward").join(enter, KEY).where(F.col("t") > F.col("enter_t")).groupBy(*KEY).agg(
        F.min("t").alias("t")).withColumn("way", F.lit("exit"))
    both = enter.select(*KEY, F.col("enter_t").alias("t"), F.lit("enter").alias("way")).unionByName(leave)
    minutes = both.join(course.select("task_id", "midnight", "first_gate"), "task_id").withColumn(
        "minute", F.floor((F.col("t") - F.col("midnight")) / 60))
    counts = minutes.groupBy("task_id", "way", "minute", "midnight", "first_gate").agg(F.count("*").alias("n"))
    peak = counts.groupBy("task_id", "midnight", "first_gate").agg(*[
        e for way in ("enter", "exit") for e in (
            F.coalesce(F.sum(F.when(F.col("way") == way, F.col("n"))), F.lit(0)).alias(f"{way}_total"),
            F.max(F.when(F.col("way") == way, F.struct("n", (-F.col("minute")).alias("m")))).alias(way))])
    rows = peak.join(sizes, "task_id").select(
        "task_id", "pilots", "enter_total", "exit_total",
        *[e for w in ("enter", "exit") for e in ((-F.col(f"{w}.m")).alias(f"{w}_minute"),
                                                 F.coalesce(f"{w}.n", F.lit(0)).alias(f"{w}_busiest"))],
        F.floor((F.col("first_gate") - F.col("midnight")) / 60).alias("declared_minute"))
    first = F.col("enter_busiest") >= F.col("exit_busiest")
    minute = F.when(first, F.col("enter_minute")).otherwise(F.col("exit_minute"))
    busiest = F.greatest("enter_busiest", "exit_busiest")
    return rows.withColumn("suggested_minute", F.when(
        (busiest >= 0.5 * F.col("pilots")) & (F.abs(minute - F.col("declared_minute")) > 2), minute))


def unique_zones(course: DataFrame, smallest: bool = False) -> DataFrame:
    """One zone per place (and radius); ``smallest`` keeps the tightest circle of a place instead."""
    z = course.select("task_id", "start_ix", "goal_ix", F.explode("wps").alias("z")).withColumns({
        "la": F.round("z.lat", 5), "lo": F.round("z.lon", 5)})
    keys = ["task_id", "la", "lo"] + ([] if smallest else ["z.radius"])
    order = F.struct("z.radius", "z.wp_ix") if smallest else F.struct(F.col("z.wp_ix").alias("i"))
    return z.groupBy(*keys).agg(F.min_by("z", order).alias("z"), F.first("start_ix").alias("start_ix"),
                                F.first("goal_ix").alias("goal_ix"))


def first_entries(track: DataFrame, zones: DataFrame) -> DataFrame:
    """First time each pilot is inside each zone (an inward crossing ends inside it)."""
    lists = zones.groupBy("task_id").agg(F.collect_list(F.struct("z.wp_ix", "z.x", "z.y", "z.outer")).alias("zs"))
    inside = F.filter("zs", lambda z: geo.in_zone(F.col("x"), F.col("y"), z["x"], z["y"], z["outer"]))
    rows = track.where("fix_ix > 0").select(*KEY, "t", "x", "y").join(lists, "task_id").select(
        *KEY, "t", F.explode(inside).alias("z"))
    return rows.groupBy(*KEY, F.col("z.wp_ix").alias("wp_ix")).agg(F.min("t").alias("entry_t"))


def _in_order(times: Column) -> Column:
    """All present and never decreasing."""
    return ~F.exists(times, lambda t: t.isNull()) & (times == F.array_sort(times))


def entry_times(entries: DataFrame, route: DataFrame) -> DataFrame:
    """Each pilot's entry times along ``route`` (task_id, ixs): null where a zone was not entered."""
    maps = entries.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("wp_ix", "entry_t"))).alias("m"))
    return maps.join(route, "task_id").select(*KEY, "ixs", F.transform("ixs", lambda i: F.try_element_at("m", i)).alias("times"))


def completers(entries: DataFrame, route: DataFrame) -> DataFrame:
    return entry_times(entries, route).groupBy("task_id").agg(F.count_if(_in_order(F.col("times"))).alias("completed"))


def longest_chain(orders: np.ndarray, weights: np.ndarray, least: int) -> tuple[int, int, list[int]] | None:
    """Length, pilots and zones of the longest part of a route that ``least`` pilots flew in order.

    ``orders`` has a row per signature: the rank of each zone's entry time, 0 where it was not entered, the
    goal last.  Zones are taken or left in route order, taken first.  What is left is given up where no part
    of enough signatures' own longest chains can be longer, or as long with more pilots.
    """
    goal = orders[:, -1:]
    alive = goal[:, 0] > 0
    orders, weights = np.where(orders[alive] <= goal[alive], orders[alive], 0), weights[alive]
    rows, zones = len(orders), orders.shape[1] - 1
    if weights.sum() < least:
        return None
    ranks = np.arange(orders.max() + 1)
    longest = np.zeros((zones + 1, rows, len(ranks)), np.int16)    # zones from i on, entered at rank v or later
    for i in range(zones - 1, -1, -1):
        rank = orders[:, i]
        taken = 1 + longest[i + 1][np.arange(rows), rank]
        fits = (rank > 0)[:, None] & (ranks <= rank[:, None])
        longest[i] = np.where(fits, np.maximum(longest[i + 1], taken[:, None]), longest[i + 1])
    best, route, seen, held = (0, 0), None, {}, 0
    stack = [(0, np.arange(rows), np.zeros(rows, np.int64), ())]
    while stack:
        i, mine, last, picked = stack.pop()
        reach = np.bincount(longest[i][mine, last], weights[mine])[::-1].cumsum()[::-1]
        more = int(np.flatnonzero(reach >= least)[-1])
        if (len(picked) + 1 + more, int(reach[more])) <= best:
            continue
        if i == zones:
            best, route = (len(picked) + 1, int(reach[0])), picked
            continue
        state = i, mine.tobytes(), last.tobytes()
        if seen.get(state, -1) >= len(picked):
            continue
        if held < REMEMBERED:
            held += len(state[1]) + len(state[2])
            seen[state] = len(picked)
        stack.append((i + 1, mine, last, picked))
        rank = orders[mine, i]
        fits = (rank > 0) & (rank >= last)
        if weights[mine[fits]].sum() >= least:
            stack.append((i + 1, mine[fits], rank[fits], (*picked, i)))
    return *best, [*route, zones]


def longest_subroute(entries: DataFrame, route: DataFrame, sizes: DataFrame) -> DataFrame:
    """The longest part of the route, goal included, that enough pilots flew in order.

    Pilots who entered the zones in the same order are one signature, counted by Spark; the search
    over a task's signatures has no limit of zones.  Among equals the most flown, then the earliest
    zones win.
    """
    times = entry_times(entries, route).where("size(ixs) > 0")
    rank_of = F.transform("times", lambda t: F.coalesce(F.array_position(
        F.array_sort(F.array_distinct(F.array_compact("times"))), t), F.lit(0)))
    kinds = times.groupBy("task_id", "ixs", rank_of.alias("order")).agg(F.count("*").alias("n")).where(
        F.element_at("order", -1) > 0)
    least = F.greatest(F.lit(3), F.bround(F.col("pilots") * 0.05, 0)).cast("long")
    schema = f"task_id {route.schema['task_id'].dataType.simpleString()}, length int, completed long, ixs array<int>"

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = longest_chain(np.stack(rows["order"].to_numpy()).astype(np.int64), rows["n"].to_numpy(), int(rows["least"].iloc[0]))
        if found is None:
            # objects: an empty column of numbers cannot become one of arrays
            return pd.DataFrame(columns=["task_id", "length", "completed", "ixs"], dtype=object)
        length, completed, picked = found
        return pd.DataFrame({"task_id": rows["task_id"].iloc[:1].tolist(), "length": [length], "completed": [completed],
                             "ixs": [[int(rows["ixs"].iloc[0][i]) for i in picked]]})

    return kinds.join(sizes.select("task_id", least.alias("least")), "task_id").groupBy("task_id").applyInPandas(search, schema)


def last_exits(events: DataFrame, before: DataFrame) -> DataFrame:
    """Last leaving of the start zone no later than ``before`` (task, pilot, before_t or null)."""
    out = events.where(F.col("is_sss") & (F.col("d_prev") <= F.col("outer")) & (F.col("d_fix") > F.col("outer")))
    return out.join(before, KEY, "left").where(F.col("before_t").isNull() | (F.col("t") <= F.col("before_t"))).groupBy(
        *KEY).agg(F.max("t").alias("exit_t"))


def reconstruct(track: DataFrame, course: DataFrame, sizes: DataFrame) -> DataFrame:
    """A task document inferred from the tracks: zones enough pilots entered, in flown order."""
    zones = unique_zones(course, smallest=True)
    entries = table(first_entries(track, zones))    # read three times below
    # entry times are whole seconds of one day, so the median's state is bounded
    reach = entries.groupBy("task_id", "wp_ix").agg(F.count("*").alias("n"), F.median("entry_t").alias("mid_t")).join(
        sizes, "task_id").where(F.col("n") / F.col("pilots") >= MIN_REACH)
    goal = zones.select("task_id", F.col("z.wp_ix").alias("wp_ix"), "la", "lo").join(
        course.select("task_id", F.round(F.get("wps", F.col("goal_ix"))["lat"], 5).alias("la"),
                      F.round(F.get("wps", F.col("goal_ix"))["lon"], 5).alias("lo")), ["task_id", "la", "lo"]).select(
        "task_id", F.col("wp_ix").alias("goal_wp"))
    order = reach.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("mid_t", "wp_ix"))).alias("o")).join(
        goal, "task_id").withColumn("seq", F.transform("o", lambda e: e["wp_ix"]))
    route = order.where(F.array_contains(F.slice("seq", F.lit(2), F.size("seq")), F.col("goal_wp"))).select(
        "task_id", F.concat(F.filter(F.slice("seq", F.lit(2), F.size("seq")), lambda i: i != F.col("goal_wp")), F.array("goal_wp")).alias("ixs"),
        F.col("seq")[0].alias("takeoff_wp"))
    best = table(longest_subroute(entries, route.select("task_id", "ixs"), sizes).join(
        route.select("task_id", "takeoff_wp"), "task_id"))
    wps = course.select("task_id", "wps", "midnight")
    enter = entries.join(best.select("task_id", F.col("ixs")[0].alias("mid_wp"), "takeoff_wp"), "task_id")
    before = enter.where(F.col("wp_ix") == F.col("mid_wp")).select(*KEY, F.col("entry_t").alias("before_t"))
    tz = best.join(wps, "task_id").select("task_id", F.get("wps", F.col("takeoff_wp")).alias("z"))
    seg = track.where("px is not null").join(tz, "task_id")
    was = geo.in_zone(F.col("px"), F.col("py"), F.col("z.x"), F.col("z.y"), F.col("z.outer"))
    now = geo.in_zone(F.col("x"), F.col("y"), F.col("z.x"), F.col("z.y"), F.col("z.outer"))
    gates = seg.where(was & ~now).select(*KEY, "t").join(before, KEY, "left").where(
        F.col("before_t").isNull() | (F.col("t") <= F.col("before_t"))).groupBy(*KEY).agg(
        F.max("t").alias("t")).groupBy("task_id").agg(F.min("t").alias("gate_t"))
    doc = best.join(wps, "task_id").join(gates, "task_id", "left").join(sizes, "task_id")
    point = lambda i, radius=None, kind=None: F.struct(
        F.coalesce(F.lit(kind), F.lit(None).cast("string")).alias("type"),
        (F.lit(radius) if radius else F.get("wps", i)["radius"].cast("int")).alias("radius"),
        F.struct(F.get("wps", i)["name"].alias("name"), F.get("wps", i)["lat"].alias("lat"),
                 F.get("wps", i)["lon"].alias("lon"), F.lit(0).alias("altSmoothed")).alias("waypoint"))
    t, g = F.col("takeoff_wp"), F.element_at("ixs", -1)
    points = F.concat(F.array(point(t, None, "TAKEOFF"), point(t, None, "SSS")),
                      F.transform(F.slice("ixs", 1, F.size("ixs") - 1), lambda i: point(i)),
                      F.array(point(g, 1000, "ESS"), point(g, 400)))
    gate = F.date_format(F.timestamp_seconds(F.coalesce("gate_t", "midnight")), "HH:mm:ss'Z'")
    body = F.to_json(F.struct(
        F.lit(1).alias("version"), F.lit("CLASSIC").alias("taskType"), F.lit("WGS84").alias("earthModel"),
        F.lit(True).alias("_reconstructed"), F.concat_ws("/", "completed", "pilots").alias("_completed_by"),
        points.alias("turnpoints"),
        F.struct(F.lit("RACE").alias("type"), F.lit("EXIT").alias("direction"), F.array(gate).alias("timeGates")).alias("sss"),
        F.struct(F.lit("CYLINDER").alias("type"), F.lit("16:00:00Z").alias("deadline")).alias("goal")))
    return doc.select("task_id", "length", "completed", "pilots", body.alias("document"))
