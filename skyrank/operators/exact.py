"""Exact progress: the shortest remaining route from a pilot's own position.

A fix needs an equi-join with its zone's rim and a minimum; the onward distances come
from the task's value table.  Exact bounds decide first whether the fix can improve on
what the pilot already reached, then which blocks of the rim can hold the minimum, so
most of both is never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, leading
from ..functions.route import MAX_BEND, RIM_SPACING_M, arc_minimum
from .landing import DISTANCE_STABILIZE_S
from .starts import chain_legs, on_legs
from .tasks import route_values
from .tracks import KEY, by_time

BLOCK_POINTS = 12
ZONE = ["k", "zx", "zy", "zr"]
#: A refined onward distance is at most this much below that of a rim point.
BEND_SLACK_M = MAX_BEND * RIM_SPACING_M / 8


def rim_blocks(course: DataFrame) -> DataFrame:
    """Rim points with their onward distance, in blocks of neighbours, per task, target and zone.

    A block knows its middle point, how far its points lie from it and their least onward
    distance: together they bound what the block can offer a fix.
    """
    rim = (route_values(course, "goal_ix").withColumn("target", F.lit("goal"))
           .unionByName(route_values(course, "ess_ix").withColumn("target", F.lit("ess"))))
    block = rim.groupBy("task_id", "target", "wp_ix", F.floor(F.col("q") / BLOCK_POINTS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("q", "qx", "qy", "v", "v_left", "v_right"))).alias("pts"),
        *[F.max(c).alias(c) for c in ZONE])
    mid = F.get("pts", F.floor(F.size("pts") / 2).cast("int"))
    return block.withColumns({
        "cx": mid["qx"], "cy": mid["qy"], "v_min": F.array_min(F.transform("pts", lambda p: p["v"]))}).withColumn(
        # a refined point lies up to one step beyond the block's own
        "reach", F.array_max(F.transform("pts", lambda p: geo.distance(p["qx"], p["qy"], F.col("cx"), F.col("cy"))))
        + 2 * F.pi() * F.col("zr") / F.col("k"))


def refined(x: Column, y: Column, p: Column) -> Column:
    """Distance to fly by the best point of the arc around rim point ``p``, or null where it is not smooth."""
    return arc_minimum(x, y, *[p[c].cast("double") for c in ("q", "k", "zx", "zy", "zr", "v", "v_left", "v_right")])


def sampled_fixes(track: DataFrame, state: DataFrame) -> DataFrame:
    """The fixes that are measured: every one from the start on.

    ``state`` carries start_fix, tags, dist_ix, landing_t, landing_ix, ess_t, goal_t, last_t and c.
    """
    deadline = F.col("c.deadline")
    limits = state.withColumns({
        "state_until": F.least(F.coalesce("landing_t", "last_t"), deadline),
        "dist_until": F.least(F.coalesce(F.col("landing_t") + DISTANCE_STABILIZE_S, F.col("last_t")),
                              F.col("last_seen_t"), deadline)})
    chains = limits.select(
        *KEY, F.lit(None).cast("int").alias("cut_ix"), F.col("start_fix").alias("cand_ix"),
        F.col("start_cross_t").alias("cand_t"), "tags", "c", "dist_ix", "landing_ix", "goal_t",
        "state_until", "dist_until", F.coalesce("ess_t", "state_until").alias("lead_until"))
    legs = chain_legs(chains, "c", "dist_ix", "landing_ix", "goal_t", "state_until", "dist_until",
                      "lead_until")
    rows = on_legs(track.select(*KEY, "fix_ix", "t", "x", "y"), legs)
    return rows.where(F.col("t") <= F.greatest("dist_until", "state_until")).select(
        *KEY, "fix_ix", "t", "x", "y", "wp_ix", "c",
        (F.col("goal_t").isNull() & (F.col("t") <= F.col("dist_until"))).alias("for_goal"),
        (F.col("t") <= F.col("lead_until")).alias("for_lead"))


def exact_distances(samples: DataFrame, rims: DataFrame) -> DataFrame:
    """(task, pilot, fix, target, d): exact remaining metres to goal and to ESS.

    Rows that cannot lower the pilot's running minimum are left out; the minima and
    the leading samples are those of the full table.
    """
    floors = rims.groupBy("task_id", "wp_ix", "target").agg(F.min("v_min").alias("v_min"))
    rows = samples
    here = lambda z: geo.distance(F.col("x"), F.col("y"), z["x"], z["y"])
    z = F.get("c.wps", F.col("wp_ix"))
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    stops = {"goal": ("for_goal", "c.goal_ix"), "ess": ("for_lead", "c.ess_ix")}
    rows = rows.withColumn("edge", here(z) - z["measure"])
    for target, (wanted, stop) in stops.items():
        stop_rem = F.get("c.wps", F.col(stop))["remaining"]
        rows = rows.withColumn(f"upper_{target}", F.when(F.col(wanted), F.when(
            F.col("wp_ix") > F.col(stop), F.lit(0.0)).otherwise(
            geo.distance(F.col("x"), F.col("y"), z["opt_x"], z["opt_y"]) + z["remaining"] - stop_rem)))
    rows = rows.withColumns({f"reached_{t}": F.min(f"upper_{t}").over(before) for t in stops})
    rows = rows.withColumn("g", F.explode(F.array_compact(F.array(*[
        F.when(F.col(wanted), F.struct(F.lit(t).alias("target"), F.col(stop).alias("stop"),
                                       F.col(f"reached_{t}").alias("reached"),
                                       F.col(f"upper_{t}").alias("upper")))
        for t, (wanted, stop) in stops.items()]))))
    ahead = F.filter("c.wps", lambda w: (w["wp_ix"] >= F.col("wp_ix")) & (w["wp_ix"] <= F.col("g.stop"))
                     & (here(w) > w["measure"]))
    rows = rows.select(
        *KEY, "fix_ix", "t", "x", "y", "wp_ix", "edge", (F.col("c.speed_m") / 1000).alias("section_km"),
        (F.col("t") - F.col("c.first_gate")).alias("task_time"),
        (F.col("c.progress_curve") == "HUMP_V2A").alias("hump"), F.col("g.target").alias("target"),
        F.col("g.reached").alias("reached"), F.col("g.upper").alias("upper"),
        F.when(F.col("wp_ix") <= F.col("g.stop"), F.when(F.col("edge") > 0, F.col("wp_ix"))
               .otherwise(F.get(ahead, F.lit(0))["wp_ix"])).alias("aim"))
    lower = F.when(F.col("aim") == F.col("wp_ix"), F.col("edge") + F.coalesce("v_min", F.lit(0.0)) - BEND_SLACK_M
                   ).otherwise(F.lit(0.0))
    kept = rows.join(floors, ["task_id", "wp_ix", "target"], "left").where(
        F.col("reached").isNull() | (F.least(lower, F.col("upper")) <= F.col("reached")))
    base = [*KEY, "target", "fix_ix", "t", "task_time", "section_km", "hump"]
    arrived = kept.where(F.col("aim").isNull()).select(*base, F.lit(0.0).alias("d"))
    near = rims.select(F.col("task_id").alias("n_task"), F.col("target").alias("n_target"), F.col("wp_ix").alias("n_aim"),
                       "cx", "cy", "reach", F.col("v_min").alias("onward"), "pts")
    offers = geo.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) - F.col("reach") + F.col("onward")
    # ``upper`` is a way that can be flown, so a block that offers less has nothing to add
    useful = ((F.col("task_id") == F.col("n_task")) & (F.col("target") == F.col("n_target")) & (F.col("aim") == F.col("n_aim"))
              & (offers - BEND_SLACK_M <= F.col("upper")))
    points = (kept.where(F.col("aim").isNotNull()).select(*base, "aim", "x", "y", "upper").join(near, useful, "left")
              .select(*base, "aim", "x", "y", "upper", F.explode_outer("pts").alias("p")))
    way = geo.distance(F.col("x"), F.col("y"), F.col("p.qx"), F.col("p.qy")) + F.col("p.v")
    best = points.select(*base, "aim", "x", "y", "upper", F.col("p.q").alias("q"), way.alias("way")).groupBy(
        *base, "aim", "x", "y", "upper").agg(F.min("way").alias("way"), F.min_by("q", "way").alias("q"))
    # what the arc needs comes from the one rim point that was best
    rim = rims.select(F.col("task_id").alias("n_task"), F.col("target").alias("n_target"), F.col("wp_ix").alias("n_aim"), *ZONE,
                      F.explode("pts").alias("p")).select("n_task", "n_target", "n_aim", *ZONE, F.col("p.q").alias("n_q"),
                                                          "p.v", "p.v_left", "p.v_right")
    same = ((F.col("task_id") == F.col("n_task")) & (F.col("target") == F.col("n_target")) & (F.col("aim") == F.col("n_aim"))
            & (F.col("q") == F.col("n_q")))
    flown = best.join(rim, same, "left").withColumn("arc", refined(
        F.col("x"), F.col("y"), F.struct("q", *ZONE, "v", "v_left", "v_right"))).select(
        *base, F.least("upper", "way", "arc").alias("d"))
    return arrived.unionByName(flown)


def falling_minima(distances: DataFrame) -> DataFrame:
    """Every distance in km with the least one before it, from the section length on."""
    w = Window.partitionBy(*KEY, "target").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    section = F.col("section_km")
    return distances.withColumn("d_km", F.col("d") / 1000).withColumn(
        "prev_km", F.least(section, F.coalesce(F.min("d_km").over(w), section)))


def lead_samples(distances: DataFrame) -> DataFrame:
    """(task time, km to ESS) wherever the running minimum strictly falls."""
    return falling_minima(distances.where(F.col("target") == "ess")).where(
        F.col("d_km") < F.col("prev_km")).select(
        *KEY, "fix_ix", "task_time", "d_km", "prev_km", "section_km", "hump")


def lead_term() -> Column:
    args = [F.col(c) for c in ("task_time", "d_km", "prev_km", "section_km")]
    return F.when(F.col("hump"), leading.hump_term(*args)).otherwise(leading.weighted_term(*args))


def exact_progress(distances: DataFrame) -> DataFrame:
    """Per pilot: least exact distance to goal with its fix, leading area and nearest approach to ESS."""
    rows = falling_minima(distances)
    falls = (F.col("target") == "ess") & (F.col("d_km") < F.col("prev_km"))
    return rows.groupBy(*KEY).agg(
        F.min(F.when(F.col("target") == "goal", F.struct("d", "fix_ix"))).alias("m"),
        F.sum(F.when(falls, lead_term())).alias("lead_area"),
        F.min(F.when(falls, F.col("d_km"))).alias("lead_min_km")).select(
        *KEY, F.col("m.d").alias("exact_remaining"), F.col("m.fix_ix").alias("exact_ix"),
        "lead_area", "lead_min_km")
