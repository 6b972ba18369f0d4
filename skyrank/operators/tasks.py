"""Task compilation: waypoint kinds, zone radii, the optimised route and its distances.

The result is one ``course`` row per task.  Its ``wps`` array holds the handful of
waypoints of that task, so every later step reaches a zone by ``explode`` on its own
row instead of by another join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geodesic import ellipsoid_xy
from ..functions.route import VALUE_COLUMNS, route_points, value_rows
from ..session import spread

TOLERANCE_DEFAULTS = {"radius_tolerance": geo.RADIUS_TOLERANCE,
                      "absolute_tolerance": geo.ABSOLUTE_TOLERANCE_M,
                      "measure_policy": geo.MEASURE_POLICY,
                      "earth_model": "FAI_SPHERE"}


def waypoint_kinds(waypoints: DataFrame) -> DataFrame:
    """Infer ``kind`` from the declared type and the position in the task."""
    n = F.col("n_wps")
    kind = (F.when(F.col("declared").isin("TAKEOFF", "SSS", "ESS"), F.col("declared"))
            .when(F.col("wp_ix") == n - 1, F.lit("GOAL"))
            .when((F.col("wp_ix") == 0) & ~F.col("has_takeoff")
                  & F.coalesce(F.col("sss_at") > 0, F.lit(True)), F.lit("TAKEOFF"))
            .otherwise(F.lit("TURNPOINT")))
    facts = waypoints.groupBy("task_id").agg(
        F.count("*").cast("int").alias("n_wps"),
        F.max(F.coalesce(F.col("declared") == "TAKEOFF", F.lit(False))).alias("has_takeoff"),
        F.min(F.when(F.col("declared") == "SSS", F.col("wp_ix"))).alias("sss_at"))
    return (waypoints.join(facts, "task_id").withColumn("kind", kind)
            .drop("n_wps", "has_takeoff", "sss_at"))


def task_centres(waypoints: DataFrame) -> DataFrame:
    return waypoints.groupBy("task_id").agg(
        F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))


def with_defaults(tasks: DataFrame) -> DataFrame:
    for name, value in TOLERANCE_DEFAULTS.items():
        have = F.col(name) if name in tasks.columns else F.lit(None)
        tasks = tasks.withColumn(name, F.coalesce(have, F.lit(value)))
    return tasks


def zone_columns(df: DataFrame) -> DataFrame:
    """inner / outer / measure radius of each waypoint under its task's policy."""
    rt, at = F.col("radius_tolerance"), F.col("absolute_tolerance")
    return df.withColumns({
        "inner": geo.inner_radius(F.col("radius"), rt, at),
        "outer": geo.outer_radius(F.col("radius"), rt, at),
        "measure": geo.measure_radius(F.col("radius"), F.col("measure_policy"), rt, at)})


def with_xy(df: DataFrame, ellipsoid: bool = False) -> DataFrame:
    """Task-plane x, y for rows carrying lat, lon, clat, clon (and earth_model).

    ``ellipsoid`` admits tasks declared WGS84; their rows take the geodesic UDF,
    the others stay on the closed-form sphere columns.
    """
    here = (F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    x, y = geo.plane_xy(*here)
    if not ellipsoid:
        return df.withColumns({"x": x, "y": y})
    is_wgs = F.col("earth_model") == "WGS84"
    gx, gy = ellipsoid_xy(*here)
    return (df.where(~is_wgs).withColumns({"x": x, "y": y})
            .unionByName(df.where(is_wgs).withColumns({"x": gx, "y": gy})))


def _suffix_sums(legs: Column) -> Column:
    """remaining[i] = sum of legs[i:], for a short array."""
    return F.reverse(F.aggregate(
        F.reverse(legs), F.struct(F.lit(0.0).alias("acc"), F.array().cast("array<double>").alias("out")),
        lambda a, leg: F.struct((a["acc"] + leg).alias("acc"),
                                F.concat(a["out"], F.array(a["acc"] + leg)).alias("out")),
        lambda a: a["out"]))


def compile_courses(tasks: DataFrame, waypoints: DataFrame, ellipsoid: bool = False) -> DataFrame:
    """One row per task: scalars, gates and the ``wps`` array with route distances."""
    tasks = with_defaults(tasks)
    policy = tasks.select("task_id", *TOLERANCE_DEFAULTS)
    rows = with_xy(zone_columns(
        waypoint_kinds(waypoints).join(task_centres(waypoints), "task_id").join(policy, "task_id")),
        ellipsoid)
    fields = ["wp_ix", "name", "kind", "lat", "lon", "radius", "alt",
              "inner", "outer", "measure", "x", "y"]
    grouped = spread(rows.groupBy("task_id", "clat", "clon").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("w")), "task_id")
    radii = F.transform("w", lambda w: F.when(w["kind"] == "TAKEOFF", F.lit(0.0)).otherwise(w["measure"]))
    routed = grouped.withColumn("rr", radii).withColumn(
        "opt", route_points(F.col("w.x"), F.col("w.y"), F.col("rr")))
    ox, oy = F.col("opt.ox"), F.col("opt.oy")
    legs = F.transform("w", lambda w, i: F.when(
        i < F.size("w") - 1, geo.distance(ox[i], oy[i], ox[i + 1], oy[i + 1])).otherwise(F.lit(0.0)))
    routed = (routed.withColumn("legs", legs).withColumn("rem", _suffix_sums(F.col("legs")))
              .withColumn("wps", F.transform("w", lambda w, i: F.struct(
                  *[w[f].alias(f) for f in fields], ox[i].alias("opt_x"), oy[i].alias("opt_y"),
                  F.col("legs")[i].alias("leg_m"), F.col("rem")[i].alias("remaining")))))
    first_of = lambda kind, default: F.coalesce(
        F.get(F.filter("wps", lambda w: w["kind"] == kind), F.lit(0))["wp_ix"], default)
    goal_ix = F.size("wps") - 1
    course = (routed.withColumns({
        "start_ix": first_of("SSS", F.lit(1)), "ess_ix": first_of("ESS", goal_ix),
        "goal_ix": goal_ix})
        .withColumns({
            "total_m": F.col("wps")[0]["remaining"],
            "speed_m": F.col("wps")[F.col("start_ix")]["remaining"]
            - F.col("wps")[F.col("ess_ix")]["remaining"],
            "launch_to_sss_m": F.when(
                F.col("start_ix") > 0, F.col("wps")[0]["remaining"]
                - F.col("wps")[F.col("start_ix")]["remaining"]).otherwise(F.lit(0.0)),
            "ess_remaining": F.col("wps")[F.col("ess_ix")]["remaining"]})
        .drop("w", "opt", "legs", "rem"))
    clocks = tasks.withColumn("gates", F.array_sort("gates")).withColumn(
        "gates", F.when(F.size("gates") > 0, F.col("gates")).otherwise(
            F.array(F.col("midnight")))).withColumn("first_gate", F.col("gates")[0])
    return clocks.join(course, "task_id")


def clock_epoch(clock: Column, midnight: Column) -> Column:
    """HH:MM:SSZ on a task day as epoch seconds."""
    part = lambda i: F.try_element_at(F.split(F.rtrim(clock, F.lit("Z")), ":"), F.lit(i)).cast("long")
    return midnight + part(1) * 3600 + part(2) * 60 + part(3)


def clock_gates(clocks: Column, midnight: Column) -> Column:
    """Sorted gate epochs; a task without gates starts at midnight."""
    gates = F.array_sort(F.transform(clocks, lambda g: clock_epoch(g, midnight)))
    return F.when(F.size(gates) > 0, gates).otherwise(F.array(midnight))


def waypoints_of(course: DataFrame) -> DataFrame:
    """The compiled waypoints as rows."""
    return course.select("task_id", F.inline("wps"))


def task_warnings(course: DataFrame) -> DataFrame:
    """Internal contradictions of a task definition."""
    sss, nxt = F.col("wps")[F.col("start_ix")], F.get("wps", F.col("start_ix") + 1)
    inside = geo.distance(sss["x"], sss["y"], nxt["x"], nxt["y"]) + nxt["radius"] <= sss["radius"]
    return course.select("task_id", F.array_compact(F.array(
        F.when(F.col("first_gate") >= F.col("deadline"), F.lit("gate at or after deadline")),
        F.when(inside, F.concat(F.lit("zone "), nxt["name"], F.lit(" lies inside "), sss["name"]))
    )).alias("warnings"))


def rim_points(course: DataFrame) -> DataFrame:
    """Candidate route points: the rim of every zone, at most 100 m apart."""
    from ..functions.route import RIM_MIN_POINTS, RIM_SPACING_M
    k = F.when(F.col("r") <= 0, F.lit(1)).otherwise(F.greatest(
        F.lit(RIM_MIN_POINTS), F.ceil(2 * F.pi() * F.col("r") / RIM_SPACING_M)).cast("int"))
    zones = waypoints_of(course).withColumn(
        "r", F.when(F.col("kind") == "TAKEOFF", F.lit(0.0)).otherwise(F.col("measure")))
    angle = 2 * F.pi() * F.col("q") / F.col("k")
    return zones.withColumn("k", k).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "task_id", "wp_ix", "q", "k",
        (F.col("x") + F.cos(angle) * F.col("r")).alias("qx"),
        (F.col("y") + F.sin(angle) * F.col("r")).alias("qy"))


def route_values(course: DataFrame, stop: str = "goal_ix") -> DataFrame:
    """Shortest distance onward from every rim point, to the goal or to the ESS."""
    kind = course.schema["task_id"].dataType.simpleString()
    return spread(course.select("task_id", F.col("wps.x"), F.col("wps.y"), "rr", stop), "task_id").mapInArrow(
        value_rows, f"task_id {kind}, {VALUE_COLUMNS}")
