"""Field-wide scoring: every quantity of a task is one aggregate keyed by task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gap, leading
from .tracks import course_struct

PARAMS = ["nominal_distance", "minimum_distance", "nominal_time", "nominal_goal", "nominal_launch",
          "leading_time_ratio", "pilots_present"]
TASK_FACTS = ["first_gate", "deadline", "speed_m", "total_m", "progress_curve"]


def is_flying():
    return F.col("takeoff_t").isNotNull() | (F.col("distance_m") > 0)


def with_course(rows: DataFrame, course: DataFrame) -> DataFrame:
    """Rows that carry their task's course in column ``c``."""
    return rows if "c" in rows.columns else rows.join(course_struct(course), "task_id")


def field_totals(state: DataFrame, course: DataFrame) -> DataFrame:
    """Counts, best distance and times, distance above the minimum and the leading clock."""
    flying = is_flying()
    goal, ess = F.col("goal_t").isNotNull(), F.col("ess_t").isNotNull()
    timed = flying & (F.col("section_s") != 0)
    return with_course(state, course).groupBy("task_id").agg(
        F.count("*").alias("pilots_rows"), F.count_if(flying).alias("pilots_flying"),
        F.count_if(flying & ess).alias("pilots_ess"), F.count_if(flying & goal).alias("pilots_goal"),
        F.coalesce(F.max(F.when(flying, F.col("distance_m"))), F.lit(0.0)).alias("best_distance"),
        F.min(F.when(timed & goal, F.col("section_s"))).alias("best_time"),
        F.min(F.when(timed & ess, F.col("section_s"))).alias("best_ess_time"),
        F.coalesce(F.sum(F.when(flying, F.greatest(
            F.lit(0.0), F.col("distance_m") - F.col("c.minimum_distance")))), F.lit(0.0)).alias("over_minimum"),
        F.coalesce(F.max(F.when(flying & F.col("start_t").isNotNull(), F.col("last_task_time"))),
                   F.lit(0.0)).alias("last_out"),
        F.coalesce(F.max(F.when(flying & ess, F.col("ess_t") - F.col("c.first_gate"))).cast("double"),
                   F.lit(0.0)).alias("last_ess"),
        *[F.first(f"c.{x}").alias(x) for x in [*PARAMS, *TASK_FACTS]])


def task_validity(totals: DataFrame, integer_pots: bool = False, roster: DataFrame | None = None,
                  factor: DataFrame | None = None) -> DataFrame:
    """Validity, weights, pots and the leading clock of each task.

    ``factor`` (task_id, factor), where given, scales the validity of the tasks it names.
    """
    rows = totals
    if roster is not None:
        rows = rows.join(roster.groupBy("task_id").agg(F.count("*").alias("roster_size")), "task_id", "left")
    else:
        rows = rows.withColumn("roster_size", F.lit(None).cast("long"))
    c = F.col
    rows = rows.withColumn("present", F.coalesce("pilots_present", "roster_size", "pilots_rows"))
    nobody = c("pilots_flying") == 0
    zero = lambda e: F.when(nobody, F.lit(0.0)).otherwise(e)
    rows = rows.withColumns({
        "launch_validity": zero(gap.launch_validity(c("pilots_flying"), c("present"), c("nominal_launch"))),
        "distance_validity": zero(gap.distance_validity(
            c("over_minimum"), c("pilots_flying"), c("best_distance"), c("nominal_goal"),
            c("nominal_distance"), c("minimum_distance"))),
        "time_validity": zero(gap.time_validity(
            c("best_ess_time"), c("best_distance"), c("nominal_time"), c("nominal_distance"))),
        "goal_ratio": F.when(nobody, F.lit(0.0)).otherwise(c("pilots_goal") / c("pilots_flying")),
        "deadline_time": (c("deadline") - c("first_gate")).cast("double")})
    rows = rows.withColumn("task_validity",
                           c("launch_validity") * c("distance_validity") * c("time_validity"))
    if factor is not None:
        rows = rows.join(factor, "task_id", "left").withColumn(
            "task_validity", c("task_validity") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    rows = rows.withColumn("distance_weight", gap.distance_weight(c("goal_ratio")))
    rows = rows.withColumn("leading_weight", gap.leading_weight(
        c("distance_weight"), c("leading_time_ratio"), c("goal_ratio")))
    rows = rows.withColumns({"arrival_weight": F.lit(0.0),
                             "time_weight": 1 - c("distance_weight") - c("leading_weight")})
    rows = rows.withColumns({f"available_{k}": gap.available_points(
        c("task_validity"), c(f"{k}_weight"), integer_pots) for k in ("distance", "time", "leading", "arrival")})
    both = c("available_leading") + c("available_time")
    return rows.withColumns({
        "implied_leading_ratio": F.when(both != 0, c("available_leading") / both).otherwise(F.lit(0.0)),
        "max_time": F.least(F.greatest("last_out", "last_ess"), F.col("deadline_time")),
        "last_ess": F.least("last_ess", "deadline_time")})


FIELD_FACTS = ["max_time", "last_ess", "best_time", "best_distance", "pilots_ess", "task_validity",
               "available_distance", "available_time", "available_leading", "available_arrival"]


def leading_coefficients(state: DataFrame, tasks: DataFrame, rule: str = "field") -> DataFrame:
    """Give each pilot the field's facts (column ``f``) and finish the leading coefficient."""
    if rule not in ("field", "code"):
        raise ValueError(f"unknown max-time rule {rule!r}")
    c = F.col
    rows = state.join(tasks.select("task_id", F.struct(*FIELD_FACTS).alias("f")), "task_id")
    section = c("c.speed_m") / 1000
    area, nearest = F.coalesce("lead_area", F.lit(0.0)), F.coalesce(c("lead_min_km"), section)
    clock = c("f.max_time") if rule == "field" else F.greatest("f.last_ess", "last_task_time")
    lc = F.when(c("c.progress_curve") == "HUMP_V2A", leading.finish_hump(
        area, nearest, section, clock, c("last_task_time"), c("f.best_time"))).otherwise(
        leading.finish_weighted(area, nearest, section, clock))
    return rows.withColumn("lc", F.when(c("start_t").isNotNull() & is_flying(), lc).otherwise(F.lit(0.0)))


def least_coefficients(pilots: DataFrame) -> DataFrame:
    """LCmin per task: over started pilots, or over ESS pilots for the hump curve."""
    counts = (F.col("lc") > 0) & ((F.col("c.progress_curve") != "HUMP_V2A") | (F.col("f.pilots_ess") == 0)
                                  | F.col("ess_t").isNotNull())
    return pilots.groupBy("task_id").agg(
        F.coalesce(F.min(F.when(counts, F.col("lc"))), F.lit(0.0)).alias("lc_min"))


def pilot_points(pilots: DataFrame, least: DataFrame) -> DataFrame:
    """Distance, time and leading points and their rounded total for every pilot."""
    c = F.col
    rows = pilots.join(least, "task_id")
    in_goal, at_ess = c("goal_t").isNotNull(), c("ess_t").isNotNull()
    goal_wp_alt = F.get("c.wps", c("c.goal_ix"))["alt"]
    rows = rows.withColumns({
        "goal_altitude_factor": F.when(
            c("c.goal_elevated") & in_goal & c("goal_alt").isNotNull(),
            gap.goal_altitude_factor(c("goal_alt"), goal_wp_alt, c("c.goal_elevation"))).otherwise(F.lit(1.0)),
        "ess_factor": gap.ess_no_goal_factor(in_goal, at_ess, c("c.ess_no_goal_time_factor"))})
    rows = rows.withColumns({
        "distance_points": gap.distance_points(c("distance_m"), c("f.best_distance"), c("f.available_distance")),
        "time_points": gap.time_points(c("section_s"), c("f.best_time"), c("f.available_time"),
                                       c("goal_altitude_factor"), c("ess_factor")),
        "leading_points": gap.leading_points(c("lc"), c("lc_min"), c("f.available_leading"))})
    return rows.withColumn("total_points", gap.round1(
        c("distance_points") + c("time_points") + c("leading_points") + c("f.available_arrival"))
    ).withColumn("task_validity", c("f.task_validity")).drop("c", "f")


def score_field(state: DataFrame, course: DataFrame, max_time_rule: str = "field",
                integer_pots: bool = False, roster: DataFrame | None = None, stage=lambda df: df,
                factor: DataFrame | None = None):
    """(pilot rows with points, task rows) for a table of pilot states."""
    state = with_course(state, course)
    tasks = stage(task_validity(field_totals(state, course), integer_pots, roster, factor))
    pilots = leading_coefficients(state, tasks, max_time_rule)
    least = least_coefficients(pilots)
    return pilot_points(pilots, least), tasks.join(least, "task_id")
