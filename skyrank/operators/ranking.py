"""Ranks and boards.

Ranks inside a task are computed in two steps, a count per coarse score bucket and a
row number inside the bucket, so that one very large field is never sorted in a
single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def spread_row_number(df: DataFrame, by: list[str], buckets: list[Column], order: list[Column],
                      name: str) -> DataFrame:
    """``row_number() over (partition by by order by buckets, order)``, without one task per group.

    ``buckets`` are coarse, order-preserving views of the leading sort keys: the
    offsets window sees one row per bucket, the row numbers one bucket at a time.
    """
    cols = [f"_b{i}" for i in range(len(buckets))]
    keyed = df.withColumns(dict(zip(cols, buckets)))
    sizes = keyed.groupBy(*by, *cols).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*by).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, *cols]])
    joined = keyed.alias("l").join(offsets.alias("r"), same).select("l.*", "r._off")
    within = Window.partitionBy(*by, *cols).orderBy(*order)
    return joined.withColumn(name, (F.row_number().over(within) + F.col("_off")).cast("long")).drop(*cols, "_off")


def spread_running_max(df: DataFrame, by: list[str], bucket: Column, order: list[Column], value: Column,
                       name: str) -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the group, without one task per group.

    ``bucket`` is a coarse, order-preserving view of the sort key: the maxima of earlier
    buckets come from one small window, the rest from a window inside the bucket.
    """
    keyed = df.withColumns({"_b": bucket, "_v": value})
    tops = keyed.groupBy(*by, "_b").agg(F.max("_v").alias("_top"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.max("_top").over(earlier)).drop("_top")
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(tops, [*by, "_b"]).withColumn(
        name, F.greatest("_before", F.max("_v").over(inside))).drop("_b", "_v", "_before")


def final_ranking(scores: DataFrame) -> DataFrame:
    """Order by total, then distance, then pilot; ranks 1..n without ties."""
    return spread_row_number(
        scores, ["task_id"],
        [F.floor(-F.col("total_points")), F.floor(-F.col("distance_m") / 1000)],
        [F.col("total_points").desc(), F.col("distance_m").desc(), F.col("pilot_id")], "rank")


def progress_keys(df: DataFrame) -> DataFrame:
    """Sort keys before points exist: goal by time, ESS by time, else distance."""
    group = (F.when(F.col("goal_t").isNotNull(), 0).when(F.col("ess_t").isNotNull(), 1).otherwise(2))
    at = F.when(F.col("goal_t").isNotNull(), F.col("goal_t")).when(
        F.col("ess_t").isNotNull(), F.col("ess_t")).otherwise(F.lit(0)).cast("double")
    far = F.when(F.coalesce("goal_t", "ess_t").isNull(), -F.col("distance_m")).otherwise(F.lit(0.0))
    return df.withColumns({"pk_group": group, "pk_at": at, "pk_far": far})


def progress_ranking(scores: DataFrame) -> DataFrame:
    """The live order, used while nobody has points; otherwise the final order."""
    scored = scores.groupBy("task_id").agg((F.max("total_points") > 0).alias("has_points"))
    rows = progress_keys(scores.join(scored, "task_id"))
    has = F.col("has_points")
    keys = [F.when(has, -F.col("total_points")).otherwise(F.col("pk_group").cast("double")),
            F.when(has, -F.col("distance_m")).otherwise(F.col("pk_at")),
            F.when(has, F.lit(0.0)).otherwise(F.col("pk_far"))]
    return spread_row_number(
        rows, ["task_id"], [F.floor(keys[0]), F.floor(keys[1] / 1000), F.floor(keys[2] / 1000)],
        [*keys, F.col("pilot_id")], "rank").drop("pk_group", "pk_at", "pk_far", "has_points")


def top_n(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def classification(ranked: DataFrame, course: DataFrame) -> DataFrame:
    """Ranked rows with the next waypoint, the way to it, the way to goal and progress."""
    rows = ranked.join(course.select("task_id", "wps", "total_m"), "task_id")
    nxt = F.get("wps", F.col("next_wp"))
    known = nxt.isNotNull() & (F.col("last_lat") != 0) & (F.col("last_lon") != 0)
    progress = F.when(F.col("total_m") != 0, F.least(F.lit(100.0), F.greatest(
        F.lit(0.0), F.col("distance_m") / F.col("total_m") * 100)))
    return rows.withColumns({
        "next_waypoint_index": nxt["wp_ix"], "next_waypoint": nxt["name"],
        "distance_to_next_m": F.when(known, geo.haversine_m(
            F.col("last_lat"), F.col("last_lon"), nxt["lat"], nxt["lon"])),
        "distance_to_goal_m": F.greatest(F.lit(0.0), F.col("total_m") - F.col("distance_m")),
        "progress_percent": progress}).drop("wps")


def tracking_status(state: DataFrame, final: bool = False) -> DataFrame:
    """Display status of each pilot at ``now`` (a column of the input)."""
    age = F.col("now") - F.col("last_t")
    dns = F.col("takeoff_t").isNotNull() & F.col("start_t").isNull()
    status = (F.when(F.col("goal_t").isNotNull(), "GOAL").when(F.col("ess_t").isNotNull(), "ESS")
              .when(dns & F.col("early_start"), "EARLY")
              .when(dns & (F.col("now") < F.col("first_gate")), "WAITING")
              .when(dns & (F.lit(final) | (age > 900)), "NO START").when(dns, "PRE-START")
              .when(F.col("takeoff_t").isNull(), "WAITING")
              .when(age > 900, "LANDED").when(age > 120, "NO SIG")
              .otherwise(F.concat(F.lit("TP"), F.col("tp_count").cast("string"))))
    return state.withColumns({"status": status, "age_s": age,
                              "tracking": F.when(age > 120, "LOST").otherwise("ONLINE")})


def board_counts(state: DataFrame) -> DataFrame:
    """Mutually exclusive buckets that sum to the field, plus started and launched."""
    goal, ess = F.col("goal_t").isNotNull(), F.col("ess_t").isNotNull()
    dns = F.col("takeoff_t").isNotNull() & F.col("start_t").isNull()
    age = F.col("now") - F.col("last_t")
    rest = ~goal & ~ess & ~dns
    return state.groupBy("task_id").agg(
        F.count_if(goal).alias("n_goal"), F.count_if(ess & ~goal).alias("n_ess"),
        F.count_if(dns & ~goal & ~ess).alias("n_no_start"),
        F.count_if(rest & (age > 900)).alias("n_landed"),
        F.count_if(rest & (age > 120) & (age <= 900)).alias("n_lost"),
        F.count_if(rest & (age <= 120)).alias("n_flying"),
        F.count_if(F.col("start_t").isNotNull()).alias("n_started"),
        F.count_if(F.col("takeoff_t").isNotNull()).alias("n_launched"))
