"""Task documents: camelCase or snake_case, fractions or percentages, to task and waypoint rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.tasks import clock_epoch, clock_gates

DOC = ("struct<earthModel:string,earth_model:string,radiusTolerance:double,radius_tolerance:double,"
       "absoluteTolerance:double,absolute_tolerance:double,measurementRadius:string,measurement_radius:string,"
       "progressCurve:string,progress_curve:string,"
       "turnpoints:array<struct<type:string,radius:double,waypoint:struct<name:string,lat:double,lon:double,altSmoothed:double>>>,"
       "sss:struct<type:string,direction:string,timeGates:array<string>>,"
       "goal:struct<type:string,deadline:string,elevated:boolean,elevation:double>>")


def parse_tasks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, waypoints) from rows of task_id, body and date_epoch (midnight UTC of the day)."""
    d = docs.withColumn("d", F.from_json("body", DOC))
    either = lambda camel, snake, default: F.coalesce(f"d.{camel}", f"d.{snake}", F.lit(default))
    rt = either("radiusTolerance", "radius_tolerance", geo.RADIUS_TOLERANCE)
    day = F.col("date_epoch")
    tasks = d.select(
        "task_id", day.alias("midnight"), F.sha2("body", 256).substr(1, 16).alias("task_hash"),
        F.upper(either("earthModel", "earth_model", "FAI_SPHERE")).alias("earth_model"),
        F.when(F.abs(rt) > 0.01, rt / 100).otherwise(rt).alias("radius_tolerance"),   # above 1 % it is a percentage
        either("absoluteTolerance", "absolute_tolerance", geo.ABSOLUTE_TOLERANCE_M).alias("absolute_tolerance"),
        F.lower(either("measurementRadius", "measurement_radius", geo.MEASURE_POLICY)).alias("measure_policy"),
        F.upper(either("progressCurve", "progress_curve", "WEIGHTED")).alias("progress_curve"),
        F.coalesce("d.sss.type", F.lit("RACE")).alias("start_type"),
        clock_gates(F.coalesce("d.sss.timeGates", F.array().cast("array<string>")), day).alias("gates"),
        clock_epoch(F.col("d.goal.deadline"), day).alias("deadline"),
        F.coalesce("d.goal.elevated", F.lit(False)).alias("goal_elevated"),
        F.least(F.lit(1000.0), F.coalesce(F.when(F.col("d.goal.elevation") != 0, F.col("d.goal.elevation")), F.lit(300.0))).alias("goal_elevation"))
    waypoints = d.select("task_id", F.posexplode("d.turnpoints").alias("wp_ix", "p")).select(
        "task_id", "wp_ix", F.col("p.waypoint.name").alias("name"), F.col("p.type").alias("declared"),
        "p.waypoint.lat", "p.waypoint.lon", "p.radius", F.coalesce("p.waypoint.altSmoothed", F.lit(0.0)).alias("alt"))
    return tasks, waypoints


def read_tasks(spark: SparkSession, path: str, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Task files below ``path``; ``days`` gives date_epoch per task name (the file stem)."""
    docs = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.xctsk").text(path)
            .select(F.regexp_extract("_metadata.file_name", r"^(.*)\.xctsk$", 1).alias("task_id"), F.col("value").alias("body")))
    return parse_tasks(docs.join(days, "task_id"))
