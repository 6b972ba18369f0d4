"""Competition parameters and per-task overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a parameter file may contain and what the discipline implies.
KNOWN_KEYS = ["name", "discipline", "class", "pilots_present", "nominal_distance_km", "minimum_distance_km",
              "nominal_time_min", "nominal_goal", "nominal_launch", "leading_time_ratio",
              "ess_no_goal_time_factor", "score_back_min", "min_task_duration_min", "tasks", "placeholders",
              "altitude_source"]
PLACEHOLDERS = {"nominal_distance_km": 60.0, "minimum_distance_km": 5.0, "nominal_time_min": 90.0}
DISCIPLINES = {"paragliding": (0.26, 0.0, 5.0, 0.0), "hang-gliding": (0.175, 0.8, 15.0, 60.0)}
LEADING_RATIO_LIMIT, LEADING_RATIO_RULE = 0.30, 0.26
NOMINAL_GOAL, NOMINAL_LAUNCH = 0.30, 0.96

DOC = ("struct<name:string,discipline:string,class:string,pilots_present:int,nominal_distance_km:double,"
       "minimum_distance_km:double,nominal_time_min:double,nominal_goal:double,nominal_launch:double,"
       "leading_time_ratio:double,ess_no_goal_time_factor:double,score_back_min:double,"
       "min_task_duration_min:double,placeholders:array<string>,altitude_source:string>")


def parse_params(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, body): effective parameters, ``error`` or null, ``warnings``.

    Unknown keys are an error; keys that start with an underscore are comments.
    """
    keys = F.json_object_keys("body")
    rows = docs.withColumns({"keys": F.filter(F.coalesce(keys, F.array().cast("array<string>")),
                                              lambda k: ~k.startswith("_")), "p": F.from_json("body", DOC)})
    known = F.array(*[F.lit(k) for k in KNOWN_KEYS])
    rows = rows.withColumn("unknown", F.array_sort(F.array_except("keys", known)))
    disc = F.lower(F.coalesce("p.discipline", F.lit("paragliding")))
    pick = lambda i: F.when(disc == "paragliding", DISCIPLINES["paragliding"][i]).when(
        disc == "hang-gliding", DISCIPLINES["hang-gliding"][i])
    val = lambda k, d: F.coalesce(F.col(f"p.{k}"), F.lit(d) if not hasattr(d, "alias") else d)
    rows = rows.withColumns({
        "discipline": disc, "nominal_distance": val("nominal_distance_km", PLACEHOLDERS["nominal_distance_km"]) * 1000,
        "minimum_distance": val("minimum_distance_km", PLACEHOLDERS["minimum_distance_km"]) * 1000,
        "nominal_time": val("nominal_time_min", PLACEHOLDERS["nominal_time_min"]) * 60,
        "nominal_goal": val("nominal_goal", NOMINAL_GOAL), "nominal_launch": val("nominal_launch", NOMINAL_LAUNCH),
        "leading_time_ratio": val("leading_time_ratio", pick(0)),
        "ess_no_goal_time_factor": val("ess_no_goal_time_factor", pick(1)),
        "score_back_s": val("score_back_min", pick(2)) * 60,
        "altitude_source": F.lower(F.coalesce("p.altitude_source", F.lit("gps"))),
        "pilots_present": F.col("p.pilots_present")})
    ltr = F.col("leading_time_ratio")
    error = (F.when(keys.isNull(), "not a JSON object")
             .when(F.size("unknown") > 0, F.concat(F.lit("unknown key(s) "), F.array_join("unknown", ", ")))
             .when(~disc.isin(*DISCIPLINES), F.concat(F.lit("unknown discipline "), disc))
             .when(~F.col("altitude_source").isin("gps", "baro"), "altitude_source must be gps or baro")
             .when((ltr < 0) | (ltr > LEADING_RATIO_LIMIT), "leading_time_ratio out of range")
             .when(F.col("nominal_distance") <= F.col("minimum_distance"), "nominal distance must exceed minimum"))
    missing = F.array_except(F.array(*[F.lit(k) for k in PLACEHOLDERS]), F.col("keys"))
    return rows.withColumns({
        "error": error,
        "warnings": F.array_compact(F.array(
            F.when(F.col("pilots_present").isNull(), "pilots_present is not set"),
            F.when(ltr > LEADING_RATIO_RULE, "leading_time_ratio above 0.26"))),
        "placeholders": F.array_sort(F.array_union(
            F.coalesce("p.placeholders", F.array().cast("array<string>")), missing))}).drop("p", "keys", "unknown")


def task_parameters(tasks: DataFrame, overrides: DataFrame, ratio: float | None = None,
                    elevated_goal_m: float | None = None) -> DataFrame:
    """Apply per-task overrides (o_ltr, o_time_min, o_goal_m); the arguments win over both."""
    rows = tasks.join(overrides, "task_id", "left")
    goal = F.coalesce(F.lit(elevated_goal_m), F.col("o_goal_m"))
    rows = rows.withColumns({
        "leading_time_ratio": F.coalesce(F.lit(ratio), F.col("o_ltr"), F.col("leading_time_ratio")),
        "nominal_time": F.coalesce(F.col("o_time_min") * 60, F.col("nominal_time")),
        "goal_elevated": F.when(goal.isNotNull(), goal != 0).otherwise(F.col("goal_elevated")),
        "goal_elevation": F.least(F.lit(1000.0), F.coalesce(F.when(goal != 0, goal), F.col("goal_elevation")))})
    return rows.withColumn("warning", F.when(F.col("leading_time_ratio") > LEADING_RATIO_RULE,
                                             "leading_time_ratio above 0.26")).drop("o_ltr", "o_time_min", "o_goal_m")
