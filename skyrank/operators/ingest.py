"""Ingest tables: point batches, upserts, task state, snapshots, archive and synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_KEY = ["task_id", "pilot_id", "epoch"]
KEY = ["task_id", "pilot_id"]


# --- normalising ------------------------------------------------------------------

POINT_DOC = ("struct<pilot_id:string,epoch:string,timestamp:string,lat:string,lon:string,alt_gps:double,"
             "alt:double,alt_baro:double,event_id:string,source:string>")


def fingerprint(pilot: Column, epoch: Column, lat: Column, lon: Column) -> Column:
    stamp = F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.sha2(F.concat_ws("|", pilot, stamp, F.format_string("%.7f", lat), F.format_string("%.7f", lon)), 256)


def normalise_points(raw: DataFrame, whole_batch: bool = False, default_source: str = "partner") -> DataFrame:
    """Raw JSON points (batch_id, ord, body) to typed rows with ``error`` null or a reason.

    ``epoch`` or ``timestamp`` may be a number or ISO text.  With ``whole_batch`` one bad
    point rejects its batch; the flag is an aggregate joined back, not a window, so a
    batch of any size stays spread.
    """
    rows = raw.withColumn("p", F.from_json("body", POINT_DOC))
    clock = F.coalesce("p.epoch", "p.timestamp")
    epoch = F.coalesce(F.floor(F.expr("try_cast(coalesce(p.epoch, p.timestamp) as double)")),
                       F.unix_seconds(F.try_to_timestamp(clock)))
    rows = rows.withColumns({
        "pilot_id": F.col("p.pilot_id"), "epoch": epoch,
        "lat": F.expr("try_cast(p.lat as double)"), "lon": F.expr("try_cast(p.lon as double)"),
        "alt_gps": F.coalesce("p.alt_gps", "p.alt"), "alt_baro": F.col("p.alt_baro"),
        "event_id": F.coalesce("p.event_id", F.lit("")), "source": F.coalesce("p.source", F.lit(default_source))})
    good = (F.col("pilot_id").isNotNull() & F.col("epoch").isNotNull()
            & F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False)))
    placed = lambda c, most: F.coalesce(F.col(c).between(-most, most), F.lit(False))
    rows = rows.withColumn("error", F.when(F.col("pilot_id").isNull(), "no pilot_id").when(
        F.col("epoch").isNull(), "no time").when(~placed("lat", 90), "no latitude within 90 degrees").when(
        ~placed("lon", 180), "no longitude within 180 degrees"))
    rows = rows.withColumn("fingerprint", F.when(good, fingerprint(
        F.col("pilot_id"), F.col("epoch"), F.col("lat"), F.col("lon")))).drop("p")
    if whole_batch:
        bad = rows.groupBy("batch_id").agg(F.max("error").alias("batch_error"))
        rows = rows.join(bad, "batch_id").withColumn("error", F.col("batch_error")).drop("batch_error")
    return rows


# --- upsert -----------------------------------------------------------------------

POINT_FIELDS = ["lat", "lon", "alt_gps", "alt_baro", "event_id", "source", "raw"]


def last_of_batch(batch: DataFrame) -> DataFrame:
    """Latest version of each (task, pilot, second) inside a batch, by ordinal."""
    return batch.groupBy(*POINT_KEY).agg(F.max(F.struct("ord", *POINT_FIELDS)).alias("r")).select(
        *POINT_KEY, *[f"r.{c}" for c in POINT_FIELDS])


def merge_raw(old: Column, new: Column) -> Column:
    """JSON object merge: keys of the new document win, and every value keeps its type."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(as_map(old), lambda k, v: ~F.map_contains_key(as_map(new), k))
    return F.to_json(F.map_concat(kept, as_map(new)))


def upsert_points(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored points after a batch, each with ``change`` new / updated / kept.

    An existing second keeps its position; altitudes and ids are filled from the new
    version where it has them, raw documents are merged.
    """
    s = stored.select(*POINT_KEY, F.struct(*POINT_FIELDS).alias("s"))
    b = last_of_batch(batch).select(*POINT_KEY, F.struct(*POINT_FIELDS).alias("b"))
    rows = s.join(b, POINT_KEY, "full_outer")
    both = F.col("s").isNotNull() & F.col("b").isNotNull()
    keep = lambda c: F.coalesce(f"s.{c}", f"b.{c}")
    fill = lambda c: F.coalesce(f"b.{c}", f"s.{c}")
    return rows.select(
        *POINT_KEY,
        *[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("lat", "lon")],
        *[fill(c).alias(c) for c in ("alt_gps", "alt_baro", "event_id", "source")],
        F.when(both, merge_raw(F.col("s.raw"), F.col("b.raw"))).otherwise(keep("raw")).alias("raw"),
        F.when(F.col("s").isNull(), "new").when(both, "updated").otherwise("kept").alias("change"))


def ingest_counts(batch: DataFrame, merged: DataFrame) -> DataFrame:
    """accepted / duplicates / latest epoch of a batch, per task."""
    received = batch.groupBy("task_id").agg(F.count("*").alias("received"), F.max("epoch").alias("processed_epoch"))
    new = merged.groupBy("task_id").agg(F.count_if(F.col("change") == "new").alias("accepted"),
                                        F.max(F.when(F.col("change") != "kept", F.col("epoch"))).alias("batch_epoch"))
    return received.join(new, "task_id").withColumn("duplicates", F.col("received") - F.col("accepted"))


def ingest_state(state: DataFrame, counts: DataFrame) -> DataFrame:
    """Task ingest state after a batch: greatest epoch, running count, dirty when anything is new."""
    c = counts.where("accepted > 0").select("task_id", "accepted", "batch_epoch")
    return state.join(c, "task_id", "full_outer").select(
        "task_id", F.greatest("latest_epoch", "batch_epoch").alias("latest_epoch"),
        (F.coalesce("point_count", F.lit(0)) + F.coalesce("accepted", F.lit(0))).alias("point_count"),
        F.coalesce(F.when(F.col("accepted") > 0, F.lit(True)), "dirty", F.lit(False)).alias("dirty"))


# --- choosing and saving work -------------------------------------------------------

def tasks_to_score(tasks: DataFrame, state: DataFrame, snapshot: DataFrame, force: bool = False,
                   task_filter: str | None = None) -> DataFrame:
    """Tasks with geometry, date and points whose result is missing or out of date."""
    rows = (tasks.where("has_geometry and has_date").join(state.where("point_count > 0"), "task_id")
            .join(snapshot.select("task_id", F.col("processed_epoch").alias("s_epoch"),
                                  F.col("point_count").alias("s_count"), F.col("status").alias("s_status"),
                                  F.lit(True).alias("scored")), "task_id", "left"))
    if task_filter is not None:
        rows = rows.where((F.col("task_id") == task_filter) | (F.col("external_id") == task_filter))
    if force:
        return rows
    stale = (F.col("dirty") | F.col("scored").isNull() | ~F.col("s_epoch").eqNullSafe(F.col("latest_epoch"))
             | ~F.col("s_count").eqNullSafe(F.col("point_count")) | (F.col("s_status") != "ok"))
    return rows.where(stale)


# --- boards from points ---------------------------------------------------------------

def pending_board(points: DataFrame) -> DataFrame:
    """No result yet: last point and count per pilot, ranked by id."""
    from .ranking import spread_row_number
    last = points.groupBy(*KEY).agg(
        F.count("*").alias("points_received"),
        F.max(F.struct("epoch", "id", "lat", "lon", "alt_gps")).alias("p")).select(
        *KEY, "points_received", F.col("p.epoch").alias("last_epoch"), "p.lat", "p.lon",
        F.col("p.alt_gps").alias("alt_m"))
    return spread_row_number(last, ["task_id"], [F.substring("pilot_id", 1, 4)], [F.col("pilot_id")], "rank")


def latest_classification(board: DataFrame, snapshots: DataFrame, pending: DataFrame) -> DataFrame:
    """Scored rows where a task has a snapshot, otherwise its pending board."""
    scored = board.join(snapshots, "task_id", "left_semi").select(
        *KEY, "rank", "state", F.col("total_points").alias("score"), "distance_m",
        F.lit(None).cast("long").alias("points_received"), F.lit("ok").alias("status"))
    waiting = pending.join(snapshots, "task_id", "left_anti").select(
        *KEY, "rank", F.lit("TRACKING").alias("state"), F.lit(0.0).alias("score"),
        F.lit(0.0).alias("distance_m"), "points_received", F.lit("pending").alias("status"))
    return scored.unionByName(waiting)


def event_latest_task(tasks: DataFrame) -> DataFrame:
    """The newest task version of each event."""
    return tasks.groupBy("event_id").agg(F.max(F.struct("version", "task_id")).alias("m")).select(
        "event_id", "m.version", "m.task_id")


# --- archive ---------------------------------------------------------------------------

def archive_points(points: DataFrame, archive: DataFrame, tasks: DataFrame, cutoff: str,
                   limit: int | None = None, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points left, archive after, counts per task) for finished tasks older than ``cutoff``.

    Both results are whole partitions of their tables (partitioned by task), so a writer
    replaces partitions instead of deleting rows.
    """
    old = tasks.where(F.col("task_date") < F.lit(cutoff))
    if not force:
        old = old.join(archive.select("task_id").distinct(), "task_id", "left_anti")
    if limit is not None:
        old = old.orderBy("task_date", "task_id").limit(limit)
    old = old.select("task_id")
    moving = points.join(old, "task_id", "left_semi")
    fresh = moving.join(archive.select("id"), "id", "left_anti")
    counts = moving.groupBy("task_id").agg(F.count("*").alias("deleted")).join(
        fresh.groupBy("task_id").agg(F.count("*").alias("archived")), "task_id", "left").select(
        "task_id", F.coalesce("archived", F.lit(0)).alias("archived"), "deleted")
    return points.join(old, "task_id", "left_anti"), archive.unionByName(fresh), counts


def read_with_fallback(points: DataFrame, archive: DataFrame, condition: Column | None = None) -> DataFrame:
    """Active points, or the archive's for tasks that have none; filters reach both scans."""
    wanted = (lambda d: d if condition is None else d.where(condition))
    active = wanted(points)
    return active.unionByName(wanted(archive).join(active.select("task_id").distinct(), "task_id", "left_anti"))


# --- synchronisation ---------------------------------------------------------------------

def roster_sync(pilots: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted roster, errors): an event with any bad pilot row is refused whole."""
    known = pilots.join(categories.select("event_id", "category_id", F.lit(True).alias("known")),
                        ["event_id", "category_id"], "left")
    checked = known.withColumn("message", F.when(
        F.coalesce("pilot_id", F.lit("")) == "", F.lit("pilot_id is required")).when(
        F.col("category_id").isNotNull() & F.col("known").isNull(),
        F.concat(F.lit("unknown category_id "), F.col("category_id"))))
    errors = checked.where("message is not null").select("event_id", "ord", "message")
    accepted = checked.join(errors.select("event_id").distinct(), "event_id", "left_anti").select(
        "event_id", "pilot_id", "category_id")
    return accepted, errors


def task_sync(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current task rows with version, refused documents).

    Documents (external_id, seq, task_date, start, status, settings map) in any order:
    the latest valid one is current and its version counts the valid ones before it.
    Aggregates only, so a document key of any size is combined on the map side.
    """
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c))
                                        for c in ("task_date", "start", "status")]))
    rows = documents.withColumn("missing", missing)
    bad = rows.where(F.size("missing") > 0).select(
        "external_id", "seq", F.array_join("missing", ",").alias("missing"))
    good = rows.where(F.size("missing") == 0).groupBy("external_id").agg(
        F.count("*").alias("version"), *[F.max_by(c, "seq").alias(c) for c in ("task_date", "start", "status", "settings")])
    own = F.create_map(F.lit("task_date"), F.col("task_date"), F.lit("scheduled_start_time"), F.col("start"),
                       F.lit("status"), F.col("status"))
    given = F.coalesce("settings", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k)), given)
    return good.withColumn("settings", merged), bad
