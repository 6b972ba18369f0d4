"""Penalty documents: {task: [entry, ...]}; bad entries are rejected with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["pilot", "reason", "percent_own", "percent_task", "points"]   # fixed: what an entry may contain


def parse_penalties(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(penalties, rejects) from rows of one JSON ``body`` each."""
    entries = docs.select(F.explode(F.from_json("body", "map<string,array<string>>")).alias("task_id", "list")).select(
        "task_id", F.posexplode("list").alias("ord", "entry"))
    keys = F.json_object_keys("entry")
    rows = entries.withColumn("e", F.from_json(
        "entry", "struct<pilot:string,reason:string,percent_own:double,percent_task:double,points:double>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS])))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = (F.when(keys.isNull(), "entry is not an object")
             .when(F.size(unknown) > 0, F.concat(F.lit("unknown keys "), F.array_join(unknown, ",")))
             .when(blank("e.pilot"), "no pilot").when(blank("e.reason"), "no reason"))
    rows = rows.withColumn("error", error)
    zero = lambda c: F.coalesce(f"e.{c}", F.lit(0.0)).alias(c)
    good = rows.where("error is null").select("task_id", F.col("ord").cast("long").alias("ord"), F.col("e.pilot").alias("pilot_key"),
                                              "e.reason", zero("percent_own"), zero("percent_task"), zero("points"))
    return good, rows.where("error is not null").select("task_id", "ord", "error")


def read_penalties(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_penalties(spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("body")))
