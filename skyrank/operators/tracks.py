"""From position reports to indexed tracks.

A pilot's second is reported once at most after :func:`first_reports`, so a track
is bounded by the length of its flying day whatever the size of the input.  That
de-duplication is a plain aggregate keyed by second: it combines on the map side
and spreads even one pilot's reports over all reducers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tasks import with_xy

KEY = ["task_id", "pilot_id"]
PAYLOAD = ["lat", "lon", "alt_baro", "alt_gps"]
TAKEOFF_RADIUS_M = 200.0


def by_time() -> Window:
    return Window.partitionBy(*KEY).orderBy("t")


def first_reports(raw: DataFrame) -> DataFrame:
    """One fix per (task, pilot, second): the first in file order (``ord``).

    All columns compare the same keys in the same order, so they always take one row, and
    the aggregate stays hashed.
    """
    return raw.groupBy(*KEY, "t").agg(*[F.min_by(c, "ord").alias(c) for c in PAYLOAD])


def merge_sessions(reports: DataFrame) -> DataFrame:
    """Merge all files of a pilot (``pilot_key``: trimmed lower-case name); first report per second wins."""
    return _least_row(reports, ["task_id", "pilot_key", "t"])


def _least_row(rows: DataFrame, by: list[str]) -> DataFrame:
    """The row of least ``ord`` per key; rows that share it are told apart by what they hold, never mixed."""
    return rows.groupBy(*by).agg(F.min(F.struct("ord", *PAYLOAD)).alias("r")).select(*by, *[f"r.{c}" for c in PAYLOAD])


def newest_points(points: DataFrame) -> DataFrame:
    """One fix per (task, pilot, second) of a point table: the newest id wins, null altitudes are 0."""
    newest = points.groupBy(*KEY, F.col("epoch").alias("t")).agg(F.max(F.struct("id", *PAYLOAD)).alias("r"))
    return newest.select(*KEY, "t", "r.lat", "r.lon", *[
        F.coalesce(F.col(f"r.{c}").cast("int"), F.lit(0)).alias(c) for c in ("alt_baro", "alt_gps")])


def project_fixes(fixes: DataFrame, course: DataFrame, ellipsoid: bool = False) -> DataFrame:
    """Task-plane coordinates for every fix, and nothing later than the task's ``now``."""
    centre = ["task_id", "clat", "clon", "earth_model"] + (["now"] if "now" in course.columns else [])
    placed = fixes.join(course.select(*centre), "task_id")
    if "now" in course.columns:
        placed = placed.where(F.col("now").isNull() | (F.col("t") <= F.col("now")))
    return with_xy(placed, ellipsoid).select(*KEY, "t", "lat", "lon", "x", "y", "alt_baro", "alt_gps")


def indexed_track(fixes: DataFrame) -> DataFrame:
    """Number each pilot's fixes and carry the previous position: one sort serves every later pass."""
    w = by_time()
    # The projection may have joined on the task alone; cluster by pilot before any window,
    # so that a large task is spread by its pilots and the join above may split it.
    fixes = fixes.repartition(*KEY)
    dx, dy = F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w)
    return fixes.select(
        *KEY, (F.row_number().over(w) - 1).alias("fix_ix"), "t", "lat", "lon", "x", "y",
        "alt_baro", "alt_gps", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"),
        F.lag("t").over(w).alias("pt"),
        (dx * dx + dy * dy > TAKEOFF_RADIUS_M ** 2).alias("away"))


def track_facts(track: DataFrame) -> DataFrame:
    """Takeoff and last position per pilot."""
    airborne = F.col("away")
    return track.groupBy(*KEY).agg(
        F.count("*").alias("fixes_used"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.max("fix_ix").alias("last_ix"),
        F.min(F.when(airborne, F.col("t"))).alias("takeoff_t"),
        F.min(F.when(airborne, F.col("fix_ix"))).alias("takeoff_ix"),
        *[F.max_by(c, "t").alias(f"last_{n}") for c, n in (("lat", "lat"), ("lon", "lon"), ("alt_gps", "alt"))])


def course_struct(course: DataFrame) -> DataFrame:
    """(task_id, c): the whole course as one column, joined once and carried along."""
    return course.select("task_id", F.struct(*[x for x in course.columns if x != "task_id"]).alias("c"))


def drop_outliers(fixes_xy: DataFrame, limit_km: float = 200.0) -> tuple[DataFrame, DataFrame]:
    """(tracks kept, tracks whose closest fix is farther than the limit from the task centre)."""
    nearest = fixes_xy.groupBy(*KEY).agg(
        (F.min(F.hypot("x", "y")) / 1000).alias("closest_km"))
    return nearest.where(F.col("closest_km") <= limit_km), nearest.where(F.col("closest_km") > limit_km)


def track_integrity(fixes: DataFrame, listed_gaps: int | None = None) -> DataFrame:
    """What a point list looks like before scoring: span, rate, gaps and altitude ranges.

    All gaps over five seconds are listed, or the first ``listed_gaps`` of them for display.
    """
    gap = F.col("t") - F.lag("t").over(by_time())
    rows = fixes.withColumn("gap", gap).withColumn("at", F.col("t") - F.col("gap"))
    ranked = rows.withColumn("gap_no", F.sum(F.when(F.col("gap") > 5, 1).otherwise(0)).over(
        by_time().rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.col("gap") > 5
    if listed_gaps is not None:
        listed &= F.col("gap_no") <= listed_gaps
    span = F.max("t") - F.min("t")
    return ranked.groupBy(*KEY).agg(
        F.count("*").alias("fixes"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        span.alias("span_s"),
        F.when(span != 0, (F.count("*") - 1) / span).otherwise(F.lit(0.0)).alias("nominal_rate_hz"),
        F.coalesce(F.max(F.when(F.col("gap") > 1, F.col("gap"))), F.lit(0)).alias("biggest_gap_s"),
        F.max(F.when(F.col("gap") > 1, F.struct("gap", (-F.col("at")).alias("neg")))).alias("big"),
        F.coalesce(F.sum(F.when(F.col("gap") > 1, F.col("gap") - 1)), F.lit(0)).alias("seconds_missing"),
        F.count_if(F.col("gap") > 5).alias("n_gaps_over_5s"),
        F.array_sort(F.collect_list(F.when(listed, F.struct("at", "gap")))).alias("gaps_over_5s"),
        F.min("alt_gps").alias("alt_gps_min"), F.max("alt_gps").alias("alt_gps_max"),
        F.min("alt_baro").alias("alt_baro_min"), F.max("alt_baro").alias("alt_baro_max"),
    ).withColumn("biggest_gap_at", -F.col("big.neg")).drop("big")
