"""Result documents and comparison tables as text rows, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_ROWS = 500
# The column titles of the published board.
HEADERS = ["pilot_id", "name", "official_rank", "server_rank", "official_score", "server_score", "score_delta",
           "official_distance_km", "server_distance_km", "official_distance_points", "server_distance_points",
           "official_time_points", "server_time_points", "official_leading_points", "server_leading_points",
           "server_lc", "official_speed_kmh", "server_speed_kmh", "server_state", "rank_match", "score_match"]


def _num(c: Column, digits: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", c), F.lit("-"))


def comparison_lines(joined: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """The 21-column comparison, one tab-separated line per published or scored pilot."""
    c = F.col
    both = c("side") == "both"
    flag = lambda e: F.when(F.coalesce(both & e, F.lit(False)), "True").otherwise("False")
    text = lambda e: F.coalesce(e.cast("string"), F.lit(""))
    cells = [c("pid"), text(c("o.name")), text(c("o.rank")), text(c("rank")), _num(c("o.score")), _num(c("total_points")),
             _num(c("total_points") - c("o.score")), _num(c("o.distance_km"), 2), _num(c("distance_m") / 1000, 2),
             _num(c("o.dist_p")), _num(c("distance_points")), _num(c("o.spd_p")), _num(c("time_points")), _num(c("o.lead_p")),
             _num(c("leading_points")), _num(c("lc"), 4), _num(c("o.speed_kmh"), 2), _num(c("speed_kmh"), 2), text(c("state")),
             flag(c("rank") == c("o.rank")), flag(F.abs(c("total_points") - c("o.score")) <= tolerance)]
    return joined.select("task_id", "pid", F.array_join(F.array(*cells), "\t").alias("line"))


def write_comparison(lines: DataFrame, path: str) -> None:
    """One folder per task; the header is the ``HEADERS`` list."""
    lines.repartition("task_id").sortWithinPartitions("task_id", "pid").select("task_id", F.col("line").alias("value")).write.mode(
        "overwrite").partitionBy("task_id").text(path)


def result_pages(board: DataFrame, tasks: DataFrame, rows_per_page: int = PAGE_ROWS) -> DataFrame:
    """The full result document of each task, its ranked rows in pages of a fixed size.

    A page is bounded, so a field of any size never becomes one value; page 0 carries
    the task's validity and pots.
    """
    c = F.col
    row = F.struct("rank", F.col("pilot_id").alias("pilot"), "state", F.round("distance_m", 1).alias("distance_m"), "start_t",
                   "ess_t", "goal_t", F.round("section_s", 1).alias("section_s"), F.round("speed_kmh", 2).alias("speed_kmh"),
                   F.round("distance_points", 1).alias("distance_points"), F.round("time_points", 1).alias("time_points"),
                   F.round("leading_points", 1).alias("leading_points"), F.round("total_points", 1).alias("total_points"))
    pages = board.withColumn("page", F.floor((c("rank") - 1) / rows_per_page)).groupBy("task_id", "page").agg(
        F.array_sort(F.collect_list(row)).alias("results"))
    head = tasks.select("task_id", F.struct(
        *[F.round(n, 6).alias(n) for n in ("launch_validity", "distance_validity", "time_validity", "task_validity")]).alias("validity"),
        F.struct(*[F.round(f"available_{n}", 3).alias(n) for n in ("distance", "time", "leading", "arrival")]).alias("allocation"),
        F.struct("present", "pilots_flying", "pilots_ess", "pilots_goal").alias("counts"))
    return pages.join(head, "task_id").select("task_id", "page", F.to_json(F.struct(
        "task_id", "page", F.when(c("page") == 0, c("validity")).alias("validity"),
        F.when(c("page") == 0, c("allocation")).alias("allocation"), F.when(c("page") == 0, c("counts")).alias("counts"), "results"
    )).alias("document"))


def write_documents(pages: DataFrame, path: str) -> None:
    pages.select("task_id", F.col("document").alias("value")).write.mode("overwrite").partitionBy("task_id").text(path)


def write_task_partitions(rows: DataFrame, path: str) -> None:
    """Replace exactly the tasks present in ``rows``; other tasks' partitions stay.

    Rows are rebalanced by task: Spark puts small tasks together and splits a large one by its measured size, so a task
    has one file for every advisory partition size it fills.
    """
    order = [c for c in ("pilot_id", "t", "epoch") if c in rows.columns]
    out = rows.hint("rebalance", "task_id").sortWithinPartitions("task_id", *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)


def snapshots(board: DataFrame, tasks: DataFrame, due: DataFrame, rows_per_page: int = PAGE_ROWS) -> DataFrame:
    """Score snapshots of the tasks in ``due`` (task_id, sequence, status, calculated_t), paged."""
    c = F.col
    row = F.struct("rank", F.col("pilot_id").alias("pilot"), "state", "distance_m", F.col("start_t").alias("start"),
                   F.col("ess_t").alias("ess"), F.col("goal_t").alias("goal"), "total_points")
    pages = board.join(due.select("task_id"), "task_id", "left_semi").withColumn(
        "page", F.floor((c("rank") - 1) / rows_per_page)).groupBy("task_id", "page").agg(F.array_sort(F.collect_list(row)).alias("results"))
    facts = tasks.join(due, "task_id").select("task_id", "sequence", "status", "calculated_t", F.struct(
        F.col("task_id").alias("name"), F.col("total_m").alias("total_distance_m"), F.col("speed_m").alias("speed_distance_m")).alias("task"),
        F.struct(*[F.col(f"{n}_validity").alias(n) for n in ("launch", "distance", "time", "task")]).alias("validity"))
    stamp = F.date_format(F.timestamp_seconds("calculated_t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.join(facts, "task_id").select("task_id", "sequence", "page", F.to_json(F.struct(
        F.lit("live-score.v1").alias("schema"), c("task_id").alias("competition_id"), c("sequence").alias("source_sequence"),
        stamp.alias("calculated_at"), (c("status") != "final").alias("provisional"), "status", "page", "task", "validity", "results"
    )).alias("document"))


def publish(documents: DataFrame, path: str) -> None:
    """Versioned documents per (task, sequence), then ``latest`` replaced for the same tasks."""
    rows = documents.select("task_id", "sequence", F.col("document").alias("value"))
    dynamic = {"partitionOverwriteMode": "dynamic"}
    rows.write.mode("overwrite").options(**dynamic).partitionBy("task_id", "sequence").text(f"{path}/versions")
    rows.drop("sequence").write.mode("overwrite").options(**dynamic).partitionBy("task_id").text(f"{path}/latest")
