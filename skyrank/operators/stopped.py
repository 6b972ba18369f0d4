"""Stopped tasks: the scored window, the extra validity factor and the point transfers.

Driven by a ``stops`` table (task_id, announced_t, score_back_s, minimum_time_s,
glide_ratio); a task without a row is not affected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gap
from .tracks import KEY


def stop_times(stops: DataFrame) -> DataFrame:
    return stops.withColumn("stop_t", F.col("announced_t") - F.col("score_back_s"))


def is_single_gate() -> Column:
    return (F.size("gates") == 1) & F.upper("start_type").startswith("RACE")


def scored_spans(starts: DataFrame, stops: DataFrame, course: DataFrame) -> DataFrame:
    """Per stopped task the seconds everybody is scored over, and from when if that is one moment for all.

    ``starts`` (task_id, pilot_id, start_t) knows nothing after the stop, so the last start is one that
    somebody took by then.  With nobody started a task without a common start has no span.
    """
    last = starts.groupBy("task_id").agg(F.max("start_t").alias("last_start_t"))
    rows = stop_times(stops).join(course.select("task_id", "first_gate", "start_type", "gates"), "task_id").join(
        last, "task_id", "left")
    return rows.select(
        "task_id", "stop_t", "minimum_time_s", "glide_ratio",
        F.when(is_single_gate(), F.col("first_gate")).alias("common_from_t"),
        (F.col("stop_t") - F.when(is_single_gate(), F.col("first_gate")).otherwise(F.col("last_start_t"))).alias("span_s"))


def scored_windows(starts: DataFrame, spans: DataFrame) -> DataFrame:
    """(from_t, to_t) each started pilot is scored over: one common window for a single-gate
    race, otherwise the length left to the last starter for everybody."""
    begin = F.coalesce("common_from_t", "start_t")
    return starts.where("start_t is not null").select(*KEY, "start_t").join(spans, "task_id").select(
        *KEY, begin.alias("from_t"), (begin + F.col("span_s")).alias("to_t"))


def within_windows(fixes: DataFrame, windows: DataFrame, stops: DataFrame) -> DataFrame:
    """The fixes that count: up to the end of the pilot's window, or to the stop for who has not started."""
    bounds = stop_times(stops).select("task_id", "stop_t")
    rows = fixes.join(bounds, "task_id").where(F.col("t") <= F.col("stop_t"))
    return rows.join(windows.select(*KEY, "to_t"), KEY, "left").where(
        F.col("to_t").isNull() | (F.col("t") <= F.col("to_t"))).drop("stop_t", "to_t")


def with_down(flown: DataFrame, down: DataFrame) -> DataFrame:
    """Add ``down_t``: the landing inside the window, or else that of the whole flight (``down``)."""
    rows = flown.join(down.select(*KEY, F.col("landing_t").alias("whole_t")), KEY, "left")
    return rows.withColumn("down_t", F.least("landing_t", "whole_t")).drop("whole_t")


def stopped_validity(flown: DataFrame, down: DataFrame, spans: DataFrame, course: DataFrame) -> DataFrame:
    """The validity factor of a stopped task, one row per stopped task.

    ``flown`` is the state inside the windows: distances and ESS count up to there.  ``down`` (task_id,
    pilot_id, landing_t) are the landings of whole flights, since one just before the stop shows only after it.
    """
    launched = F.col("takeoff_t").isNotNull()
    rows = with_down(flown.select(*KEY, "takeoff_t", "ess_t", "distance_m", "landing_t"), down).join(spans, "task_id")
    facts = rows.groupBy("task_id", "stop_t", "minimum_time_s", "span_s").agg(
        F.count("ess_t").alias("reached_ess"),
        F.max(F.when(launched, F.col("distance_m"))).alias("best_m"),
        F.avg(F.when(launched, F.col("distance_m"))).alias("mean_m"),
        F.count_if(launched & (F.col("down_t") <= F.col("stop_t"))).alias("landed"),
        F.count_if(launched).alias("launched"))
    rows = facts.join(course.select("task_id", "total_m", F.get("wps", F.col("ess_ix"))["remaining"].alias("ess_rem")),
                      "task_id")
    factor = gap.stopped_validity(
        F.col("reached_ess"), F.col("span_s"), F.col("minimum_time_s"), F.col("best_m"), F.col("mean_m"),
        F.col("total_m") - F.col("ess_rem"), F.col("landed"), F.col("launched"))
    return rows.select("task_id", "stop_t", F.col("span_s").alias("duration_s"), "reached_ess", "landed",
                       "launched", "best_m", "mean_m", F.coalesce(factor, F.lit(0.0)).alias("stopped_validity"))


def altitude_bonuses(flown: DataFrame, last_remaining: DataFrame, down: DataFrame, spans: DataFrame,
                     course: DataFrame) -> DataFrame:
    """Distance the height above goal was worth to pilots still flying at the stop; the larger value counts.

    ``last_remaining`` (task_id, pilot_id, d) is the distance to goal from the last point of the window.  Who is in
    goal, down by the stop, or has not started has no bonus.
    """
    rows = with_down(flown.select(*KEY, "distance_m", "goal_t", "last_alt", "landing_t"), down).join(
        last_remaining, KEY, "left").join(spans.select("task_id", "stop_t", "glide_ratio"), "task_id").join(
        course.select("task_id", "total_m", F.get("wps", F.col("goal_ix"))["alt"].alias("goal_alt")), "task_id")
    flying = F.col("goal_t").isNull() & F.col("d").isNotNull() & ~F.coalesce(F.col("down_t") <= F.col("stop_t"), F.lit(False))
    bonus = F.when(flying, gap.altitude_bonus(F.col("last_alt"), F.col("goal_alt"), F.col("glide_ratio"))).otherwise(F.lit(0.0))
    with_bonus = F.when(flying, F.least(F.col("total_m"), F.col("total_m") - F.col("d") + bonus))
    rows = rows.withColumns({"bonus_m": bonus, "bonus_distance_m": with_bonus})
    return rows.select(*KEY, "bonus_m", "bonus_distance_m",
                       F.greatest("distance_m", "bonus_distance_m").alias("stopped_distance_m"))


def stopped_points(scores: DataFrame, tasks: DataFrame, spans: DataFrame, down: DataFrame, bonuses: DataFrame) -> DataFrame:
    """Points of a stopped task; time points nobody still flying could have kept move into the distance pot.

    ``scores`` and ``tasks`` score the flights inside their windows.  With nobody in goal there are no time points
    and nothing moves.  Otherwise the reference is the fastest of those between ESS and goal at the stop (not who
    landed there), or a notional pilot who needs the whole span to ESS; pilots in goal lose the reduction, never
    below zero.  Distance points are shares of the best distance with bonus; leading points stay.
    """
    t = tasks.select("task_id", "pilots_goal", "best_time", "available_time", "available_distance")
    rows = with_down(scores, down).join(t, "task_id").join(
        spans.select("task_id", "stop_t", "span_s"), "task_id").join(bonuses, KEY)
    in_goal, any_goal = F.col("goal_t").isNotNull(), F.col("pilots_goal") > 0
    between = F.col("ess_t").isNotNull() & ~in_goal & ~F.coalesce(F.col("down_t") <= F.col("stop_t"), F.lit(False))
    field = rows.groupBy("task_id").agg(F.min(F.when(between, F.col("section_s"))).alias("between_s"),
                                        F.max("stopped_distance_m").alias("best_stopped_m"))
    rows = rows.join(field, "task_id")
    reference = F.coalesce("between_s", "span_s").cast("double")
    rows = rows.withColumn("reduction", gap.time_points_reduction(
        any_goal, F.col("best_time"), reference, F.col("available_time")))
    rows = rows.withColumns({
        "stopped_time_points": F.when(~any_goal, F.lit(0.0)).when(in_goal, gap.round1(
            F.greatest(F.lit(0.0), F.col("time_points") - F.col("reduction")))).otherwise(F.col("time_points")),
        "stopped_distance_points": gap.distance_points(
            F.col("stopped_distance_m"), F.col("best_stopped_m"), F.col("available_distance") + F.col("reduction"))})
    return rows.withColumn("stopped_total", gap.round1(
        F.col("stopped_distance_points") + F.col("stopped_time_points") + F.col("leading_points")))
