"""Ingest-table queries: what an ingest service and a polling scorer do, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, quality, tracks
from ..operators.tracks import KEY
from ..session import ensure_checkpoint_dir
from ..sinks.results import ResultTables
from .race import Race, big, r


def _once(c: Race) -> DataFrame:
    return c.views.points().where("ord < 1000000000")


def _stored(c: Race) -> DataFrame:
    """The table before the batch: one point per second of the even batches."""
    return ingest.last_of_batch(_once(c).where("batch_id % 2 = 0").withColumn("event_id", F.col("event_id").cast("string")))


def _batch(c: Race) -> DataFrame:
    return c.views.points().where("batch_id % 2 = 1 or ord >= 1000000000").withColumn(
        "event_id", F.col("event_id").cast("string"))


def points_normalise(c: Race) -> DataFrame:
    e = F.col("event_id")
    body = F.to_json(F.struct(
        F.when(e % 89 != 0, F.col("pilot_id")).alias("pilot_id"),
        F.when(e % 3 != 0, F.col("epoch")).alias("epoch"),
        F.when(e % 3 == 0, F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.when(e % 97 == 0, F.lit(95.0)).otherwise(F.round("lat", 6)).alias("lat"), F.round("lon", 6).alias("lon"),
        F.when(e % 2 == 0, F.col("alt_gps")).alias("alt_gps"), F.when(e % 2 == 1, F.col("alt_gps")).alias("alt"),
        e.cast("string").alias("event_id")))
    raw = c.views.points().select("batch_id", "ord", body.alias("body"))
    return ingest.normalise_points(raw).select(
        big("ord"), "pilot_id", "epoch", r("alt_gps", 1), "source", "fingerprint", F.col("error").isNotNull().alias("bad"))


def points_batch_reject(c: Race) -> DataFrame:
    e = F.col("event_id")
    body = F.to_json(F.struct("pilot_id", "epoch", F.when(e % 3001 == 0, F.lit(95.0)).otherwise(F.col("lat")).alias("lat"), "lon"))
    rows = ingest.normalise_points(c.views.points().select("batch_id", "ord", body.alias("body")), whole_batch=True)
    return rows.groupBy("batch_id").agg(F.count("*").alias("points"), F.count_if(F.col("error").isNull()).alias("accepted"))


def points_upsert(c: Race) -> DataFrame:
    return ingest.upsert_points(_stored(c), _batch(c)).select(
        *KEY, "epoch", r("lat", 4), r("alt_gps", 1), r("alt_baro", 1), "event_id", "source", "change",
        F.get_json_object("raw", "$.k").alias("raw_k"))


def ingest_counts(c: Race) -> DataFrame:
    batch = _batch(c)
    return ingest.ingest_counts(batch, ingest.upsert_points(_stored(c), batch)).select(
        "task_id", "received", "accepted", "duplicates", "processed_epoch")


def _state0(c: Race) -> DataFrame:
    return _stored(c).groupBy("task_id").agg(F.max("epoch").alias("latest_epoch"), F.count("*").alias("point_count"),
                                             F.lit(False).alias("dirty"))


def ingest_state(c: Race) -> DataFrame:
    batch = _batch(c)
    counts = ingest.ingest_counts(batch, ingest.upsert_points(_stored(c), batch))
    return ingest.ingest_state(_state0(c), counts)


def points_dedupe_read(c: Race) -> DataFrame:
    return tracks.newest_points(c.views.points().withColumnRenamed("ord", "id")).select(
        *KEY, "t", r("lat", 4), big("alt_baro"), big("alt_gps"))


def _scoring_tables(c: Race):
    n = F.regexp_extract("task_id", r"(\d+)", 1).cast("long")
    state = _state0(c).withColumn("dirty", n % 5 == 4)
    tasks = state.select("task_id", F.concat(F.lit("ext-"), "task_id").alias("external_id"),
                         (n % 11 != 10).alias("has_geometry"), F.lit(True).alias("has_date"))
    snapshot = state.where(n % 5 != 0).select(
        "task_id", F.col("latest_epoch").alias("processed_epoch"),
        F.when(n % 5 == 2, F.col("point_count") - 1).otherwise(F.col("point_count")).alias("point_count"),
        F.when(n % 5 == 3, "error").otherwise("ok").alias("status"))
    return tasks, state, snapshot


def tasks_to_score(c: Race) -> DataFrame:
    return ingest.tasks_to_score(*_scoring_tables(c)).select("task_id", "external_id", "point_count", "latest_epoch")


def score_save(c: Race) -> DataFrame:
    """Results of an earlier run, then a save in which some tasks fail and some have got new points meanwhile."""
    _, state, snapshot = _scoring_tables(c)
    tables = ResultTables(c.spark, f"{ensure_checkpoint_dir(c.spark)}/results-{uuid.uuid4().hex}")
    tables.put_state(state.withColumn("dirty", F.lit(True)))
    board = ingest.pending_board(c.views.points().withColumnRenamed("ord", "id")).select(
        *KEY, "rank", F.lit("TRACKING").alias("state"), F.col("points_received").cast("double").alias("score"), F.lit(0.0).alias("distance_m"))
    text = lambda x: F.lit(x).cast("string")
    before = state.select("task_id", F.lit(0).cast("long").alias("processed_epoch"), F.lit(1).cast("long").alias("point_count"),
                          text("ok").alias("status"), text("old").alias("summary"), text("").alias("error"))
    tables.save(before, board.withColumn("score", F.lit(-1.0)))
    tables.save(snapshot.withColumns({"summary": text("new"), "error": text("no fix inside the task")}), board)
    wide = lambda d, kind: d.withColumn("kind", F.lit(kind))
    rows = wide(tables.pilots().select(*KEY, "rank", r("score", 1)), "pilot").unionByName(
        wide(tables.summaries(), "summary"), allowMissingColumns=True).unionByName(
        wide(tables.state().select("task_id", "dirty"), "state"), allowMissingColumns=True)
    return rows


def pending_board(c: Race) -> DataFrame:
    return ingest.pending_board(c.views.points().withColumnRenamed("ord", "id")).select(
        *KEY, "rank", "points_received", "last_epoch", r("lat", 4))


def latest_classification(c: Race) -> DataFrame:
    snaps = c.views.task_rows().where("task_no % 2 = 0").select("task_id")
    pts = c.views.raw_fixes().select(*KEY, F.col("t").alias("epoch"), F.col("ord").alias("id"), "lat", "lon", "alt_gps")
    return ingest.latest_classification(c.s.board, snaps, ingest.pending_board(pts)).select(
        *KEY, "rank", "state", r("score", 1), r("distance_m", 2), "points_received", "status")


def event_latest_task(c: Race) -> DataFrame:
    versions = c.views.task_rows().select(
        F.floor(F.col("task_no") / 3).alias("event_id"), (F.col("task_no") % 3 + 1).alias("version"), "task_id")
    latest = ingest.event_latest_task(versions)
    return latest.join(c.s.board.select(*KEY, "rank", r("total_points", 1)), "task_id").select(
        "event_id", "version", *KEY, "rank", "total_points")


def _archive_tables(c: Race):
    n = F.regexp_extract("task_id", r"(\d+)", 1).cast("long")
    pts = c.views.points().select(F.col("ord").alias("id"), *KEY, "epoch", "lat", "lon").withColumn("n", n)
    tasks = pts.groupBy("task_id", "n").agg(F.max("epoch").alias("e")).select(
        "task_id", F.date_format(F.timestamp_seconds(F.col("e") - 86400 * (F.col("n") % 7)), "yyyy-MM-dd").alias("task_date"))
    archive = pts.where("n % 4 = 3")
    return pts.drop("n"), archive.drop("n"), tasks, pts.where("n % 4 <> 3").drop("n")


def points_archive(c: Race) -> DataFrame:
    pts, archive, tasks, active = _archive_tables(c)
    left, stored, counts = ingest.archive_points(active, archive, tasks, "2024-01-29")
    sizes = left.groupBy("task_id").agg(F.count("*").alias("left_n")).join(
        stored.groupBy("task_id").agg(F.count("*").alias("archive_n")), "task_id", "full_outer")
    return sizes.join(counts, "task_id", "left").select(
        "task_id", F.coalesce("left_n", F.lit(0)).alias("active"), F.coalesce("archive_n", F.lit(0)).alias("archive"),
        F.coalesce("archived", F.lit(0)).alias("archived"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


def points_read_fallback(c: Race) -> DataFrame:
    _, archive, _, active = _archive_tables(c)
    recent = F.col("epoch") >= 1704499200
    return ingest.read_with_fallback(active, archive, recent).groupBy(*KEY).agg(
        F.count("*").alias("points"), F.min("epoch").alias("first_epoch"))


def _roster(c: Race):
    s = c.views.table("supplier")
    pilots = s.select(
        F.floor(F.col("s_suppkey") / 5).alias("event_id"), big("s_suppkey", "ord"),
        F.when(F.col("s_suppkey") % 43 != 7, F.col("s_suppkey").cast("string")).alias("pilot_id"),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("C"), F.col("s_nationkey").cast("string"))).alias("category_id"))
    cats = pilots.select("event_id").distinct().select("event_id", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("k")).select(
        "event_id", F.concat(F.lit("C"), F.col("k").cast("string")).alias("category_id"))
    return pilots, cats


def roster_sync(c: Race) -> DataFrame:
    accepted, errors = ingest.roster_sync(*_roster(c))
    return accepted.select("event_id", "pilot_id", "category_id", F.lit(None).cast("string").alias("message")).unionByName(
        errors.select("event_id", F.col("ord").cast("string").alias("pilot_id"),
                      F.lit(None).cast("string").alias("category_id"), "message"))


def task_sync(c: Race) -> DataFrame:
    docs = c.views.table("orders").select(
        big("o_custkey", "external_id"), big("o_orderkey", "seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("task_date"),
        F.col("o_orderpriority").alias("start"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("override"))).alias("settings"))
    good, bad = ingest.task_sync(docs)
    refused = bad.groupBy("external_id").agg(F.count("*").alias("refused"))
    return good.join(refused, "external_id", "left").select(
        "external_id", "version", "task_date", F.element_at("settings", F.lit("status")).alias("status"),
        F.coalesce("refused", F.lit(0)).alias("refused"))


def late_data_classify(c: Race) -> DataFrame:
    return quality.classify_arrivals(c.views.points()).groupBy(*KEY, "arrival").agg(F.count("*").alias("n"))


def tracker_priority_merge(c: Race) -> DataFrame:
    pts = c.views.raw_fixes().select(*KEY, F.col("t").alias("epoch"), "ord", F.when(F.col("ord") % 3 == 0, 2).otherwise(1).alias("priority"))
    return quality.tracker_priority(pts, 40).groupBy(*KEY, big("priority")).agg(F.count("*").alias("n"), F.max("epoch").alias("last_epoch"))


def active_task_assign(c: Race) -> DataFrame:
    competition = F.floor(F.col("task_no") / 3).alias("competition_id")
    windows = c.views.task_rows().select(
        competition, F.col("task_id").alias("active_task"), (F.col("gate") - 900).alias("open_t"), F.col("deadline").alias("close_t"))
    entered = c.views.task_rows().select("task_id", competition)
    pts = c.views.raw_fixes().join(entered, "task_id").select("competition_id", "pilot_id", F.col("t").alias("epoch"), "ord")
    stamped = quality.assign_active_task(pts, windows)
    best = stamped.groupBy("pilot_id", "ord", "epoch").agg(F.min(F.when(F.col("inside"), F.col("active_task"))).alias("active_task"))
    return best.groupBy("pilot_id", "active_task").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    points_normalise, points_batch_reject, points_upsert, ingest_counts, ingest_state, points_dedupe_read, tasks_to_score,
    score_save, pending_board, latest_classification, event_latest_task, points_archive, points_read_fallback,
    roster_sync, task_sync, late_data_classify, tracker_priority_merge, active_task_assign)}
