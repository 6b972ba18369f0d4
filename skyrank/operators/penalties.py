"""Penalties: matching the pilot a report names, and applying it to the rounded total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracks import KEY

GRAM = 3


def pilot_keys(pilots: DataFrame) -> DataFrame:
    """Every string a report may name a pilot by: file name, stem, leading digits, without zeros."""
    base = F.element_at(F.split("source_file", "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"^(\d+)", 1)
    bare = F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))
    ids = F.array_distinct(F.array_compact(F.array(
        F.lower(base), F.lower(stem), F.when(digits != "", digits), bare)))
    return pilots.select(*KEY, F.explode(ids).alias("key"))


def match_penalties(penalties: DataFrame, pilots: DataFrame) -> DataFrame:
    """Each penalty with its pilot, or with the reason it was not applied.

    Three equi-joins in order of preference: id, exact name, part of the name.  A
    fragment is looked up by its first three characters among the substrings of the
    names, so no penalty is compared with every pilot of its task.
    """
    pens = penalties.withColumn("key", F.lower(F.trim("pilot_key"))).withColumn(
        "pen_id", F.concat_ws(":", "task_id", F.col("ord").cast("string")))
    asked = pens.select("pen_id", "task_id", "key")

    def hits(found: DataFrame, rank: int) -> DataFrame:
        return found.groupBy("pen_id").agg(F.countDistinct("pilot_id").alias("n"), F.min("pilot_id").alias("pilot_id")
                                           ).withColumn("how", F.lit(rank))

    names = pilots.select(*KEY, F.lower(F.trim("name")).alias("key"))
    by_id = hits(asked.join(pilot_keys(pilots), ["task_id", "key"]), 1)
    by_name = hits(asked.join(names, ["task_id", "key"]), 2)
    open_ = asked.join(by_id.unionByName(by_name).select("pen_id"), "pen_id", "left_anti").withColumn(
        "gram", F.substring("key", 1, GRAM)).where(F.col("key") != "")
    text = F.lower("name")
    grams = pilots.select("task_id", "pilot_id", text.alias("text"), F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - k + 1)),
            lambda i: F.substring(text, i, k)))))).alias("gram"))
    by_part = hits(open_.join(grams, ["task_id", "gram"]).where(F.contains("text", "key")), 3)
    best = by_id.unionByName(by_name).unionByName(by_part).groupBy("pen_id").agg(
        F.min(F.struct("how", "n", "pilot_id")).alias("m"))
    return pens.join(best, "pen_id", "left").select(
        *penalties.columns, F.when(F.col("m.n") == 1, F.col("m.pilot_id")).alias("pilot_id"),
        F.when(F.col("m").isNull(), "no match").when(F.col("m.n") > 1, "ambiguous").otherwise("applied").alias("outcome"))


def apply_penalties(scores: DataFrame, matched: DataFrame) -> DataFrame:
    """Subtract each pilot's penalties in file order; every amount sees the running total.

    ``scores`` carries task_validity; the list per pilot is as short as the reports
    written about one pilot in one task.
    """
    lists = matched.where("pilot_id is not null").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
        "ord", "percent_own", "percent_task", "points", "reason"))).alias("pens"))
    rows = scores.join(lists, KEY, "left")
    start = F.struct(F.col("total_points").alias("total"), F.lit(0.0).alias("taken"))

    def step(acc, p):
        amount = (acc["total"] * p["percent_own"] / 100
                  + 1000 * F.col("task_validity") * p["percent_task"] / 100 + p["points"])
        return F.struct(F.round(F.greatest(F.lit(0.0), acc["total"] - amount), 1).alias("total"),
                        (acc["taken"] + amount).alias("taken"))

    done = F.aggregate(F.coalesce("pens", F.array().cast(
        "array<struct<ord:bigint,percent_own:double,percent_task:double,points:double,reason:string>>")), start, step)
    return rows.withColumn("done", done).withColumns({
        "gross_points": F.col("total_points"), "penalty_points": F.col("done.taken"),
        "penalty_reasons": F.array_join(F.transform("pens", lambda p: p["reason"]), "; "),
        "total_points": F.col("done.total")}).drop("done", "pens")
