"""Checks on arriving positions: plausibility and lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .ranking import spread_running_max
from .tracks import KEY, by_time

# Fixed values of the plausibility rule.
MAX_SPEED_KMH = 120.0
MAX_CLIMB_MS = 20.0
ALTITUDE_M = (-500, 12000)
GAP_SKIP_S = 60
FUTURE_S = 60
EARLY_S = 3600
RECENT_POINTS = 5


def plausibility(fixes: DataFrame, window: DataFrame) -> DataFrame:
    """Every fix with the reason it is quarantined, or null.

    ``window`` gives open_t and now_t per task.  Speed and climb compare with the
    median of the last few points no more than a minute old, so one wild fix does
    not condemn the good ones after it; across longer gaps they are not checked.
    """
    rows = fixes.join(window, "task_id")
    bad_range = ~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180)
    bad_alt = ~F.col("alt_gps").between(*ALTITUDE_M)
    bad_time = (F.col("t") < F.col("open_t") - EARLY_S) | (F.col("t") > F.col("now_t") + FUTURE_S)
    rows = rows.withColumn("static", F.when(bad_range, "range").when(bad_alt, "altitude").when(bad_time, "time"))
    usable = lambda c: F.when(F.col("static").isNull(), F.col(c))
    w = by_time()
    recent = w.rowsBetween(-RECENT_POINTS, -1)
    rows = rows.repartition(*KEY).withColumns({
        "prev_t": F.lag("t").over(w),
        **{f"m_{c}": F.percentile(usable(c), 0.5).over(recent) for c in ("t", "lat", "lon", "alt_gps")}})
    dt = F.col("t") - F.col("m_t")
    checked = F.col("static").isNull() & (F.col("t") - F.col("prev_t") <= GAP_SKIP_S) & (dt > 0)
    speed = geo.haversine_m(F.col("m_lat"), F.col("m_lon"), F.col("lat"), F.col("lon")) / dt * 3.6
    climb = F.abs(F.col("alt_gps") - F.col("m_alt_gps")) / dt
    reason = (F.when(F.col("static").isNotNull(), F.col("static"))
              .when(checked & (F.when(dt > 0, speed) > MAX_SPEED_KMH), "speed")
              .when(checked & (F.when(dt > 0, climb) > MAX_CLIMB_MS), "climb"))
    return rows.withColumn("reason", reason).drop(
        "static", "prev_t", "m_t", "m_lat", "m_lon", "m_alt_gps", "open_t", "now_t")


ARRIVALS_PER_BUCKET = 1_000_000


def classify_arrivals(points: DataFrame, order: str = "ord") -> DataFrame:
    """in_order / duplicate / conflict / late for points in order of arrival.

    The time already reached is a running maximum taken bucket by bucket of arrivals;
    repeats of a second are found by that second's first arrival, a keyed aggregate.
    Neither needs all points of one pilot in one place.
    """
    first = points.groupBy(*KEY, "epoch").agg(
        F.min(F.struct(F.col(order).alias("o"), "lat", "lon")).alias("first"))
    rows = spread_running_max(points, KEY, F.floor(F.col(order) / ARRIVALS_PER_BUCKET),
                              [F.col(order)], F.col("epoch"), "reached").join(first, [*KEY, "epoch"])
    again = F.col(order) > F.col("first.o")
    same = (F.col("lat") == F.col("first.lat")) & (F.col("lon") == F.col("first.lon"))
    kind = (F.when(again & same, "duplicate").when(again, "conflict")
            .when(F.col("reached") > F.col("epoch"), "late").otherwise("in_order"))
    return rows.withColumn("arrival", kind).drop("reached", "first")


def tracker_priority(points: DataFrame, silence_s: int = 120, slot_s: int = 3600) -> DataFrame:
    """Keep a lower-priority tracker's points only while the best one is silent.

    Priority 1 is the best.  The last time it spoke is a running maximum, taken hour by
    hour so that a talkative pilot is not one task.
    """
    order = [F.col("epoch"), F.col("priority"), F.col("ord")]
    spoke = F.when(F.col("priority") == 1, F.col("epoch"))
    rows = spread_running_max(points, KEY, F.floor(F.col("epoch") / slot_s), order, spoke, "best_t")
    return rows.where((F.col("priority") == 1) | F.col("best_t").isNull()
                      | (F.col("epoch") - F.col("best_t") > silence_s)).drop("best_t")


def assign_active_task(points: DataFrame, windows: DataFrame, slot_s: int = 3600) -> DataFrame:
    """Stamp points with the task whose window contains them; others keep a null task.

    The range condition is reached through an equi-join on hour slots: a window is
    listed under every hour it touches, a point under its own.
    """
    slots = windows.withColumn("slot", F.explode(F.sequence(
        F.floor(F.col("open_t") / slot_s), F.floor(F.col("close_t") / slot_s))))
    keyed = points.withColumn("slot", F.floor(F.col("epoch") / slot_s))
    return keyed.join(slots, ["competition_id", "slot"], "left").withColumn(
        "inside", F.col("epoch").between(F.col("open_t"), F.col("close_t")))
