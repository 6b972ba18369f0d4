"""Landing detection: the first anchor whose next three minutes stay in a small box."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from .tracks import KEY, by_time

# Fixed values of the landing rule.
WINDOW_S = 180
RADIUS_M = 100.0
ALTITUDE_RANGE_M = 80.0
SCAN_STEP_S = 5
AFTER_START_DELAY_S = 60
DISTANCE_STABILIZE_S = 15

#: A fix this many places ahead, when it falls inside the window, must already be
#: in the box: three cheap offsets discard nearly every fix in flight.
PROBES = (1, 4, 20, 120)


def stationary_anchors(track: DataFrame) -> DataFrame:
    """Fixes that open a stationary window, with the time of the fix that closes it.

    All windows share the track's own clustering and order.  The sliding frame runs
    only near fixes that pass the probes.
    """
    w = by_time()
    near = F.lit(True)
    here = F.struct("t", "x", "y", F.col("alt_gps").alias("alt"))
    rows = track.select(*KEY, "fix_ix", "t", "x", "y", F.col("alt_gps").alias("alt"), here.alias("here"))
    rows = rows.select("*", *[F.lead("here", k).over(w).alias(f"p{k}") for k in PROBES])
    for k in PROBES:
        p = F.col(f"p{k}")
        dx, dy = p["x"] - F.col("x"), p["y"] - F.col("y")
        inside = (dx * dx + dy * dy <= RADIUS_M ** 2) & (F.abs(p["alt"] - F.col("alt")) <= ALTITUDE_RANGE_M)
        in_window = F.lit(True) if k == 1 else p["t"] <= F.col("t") + WINDOW_S
        near = near & F.when(p.isNull(), k != 1).when(in_window, inside).otherwise(True)
    rows = rows.withColumn("probe", near).select(
        *KEY, "fix_ix", "t", "x", "y", "alt", F.col("p1").alias("next"), "probe")
    last_probe = F.max(F.when(F.col("probe"), F.col("t"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("last_probe", last_probe).where(
        F.col("t") < F.col("last_probe") + WINDOW_S)
    ahead = w.rangeBetween(0, WINDOW_S - 1)
    closing = F.last("next").over(ahead)
    rows = rows.withColumns({
        "closing": closing,
        "hi": F.max("alt").over(ahead), "lo": F.min("alt").over(ahead),
        "box": F.greatest(F.max("x").over(ahead) - F.min("x").over(ahead),
                          F.max("y").over(ahead) - F.min("y").over(ahead)),
        "path": F.collect_list(F.struct("x", "y")).over(ahead)})
    x, y = F.col("x"), F.col("y")
    close = lambda px, py: (px - x) * (px - x) + (py - y) * (py - y) <= RADIUS_M ** 2
    return rows.where(
        F.col("probe") & F.col("closing.t").isNotNull() & (F.col("box") <= 2 * RADIUS_M)
        & (F.greatest("hi", F.col("closing.alt")) - F.least("lo", F.col("closing.alt"))
           <= ALTITUDE_RANGE_M)
        & close(F.col("closing.x"), F.col("closing.y"))
        & F.forall("path", lambda p: close(p["x"], p["y"]))
    ).select(*KEY, "fix_ix", "t", F.col("closing.t").alias("close_t"))


def landings(track: DataFrame, search: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """First stationary anchor met when stepping at least five seconds from ``after``.

    ``search`` holds (task, pilot, after_t, before_t) and columns to pass on.  The steps depend on every
    fix on the way, so they are folded over the pilot's own times: a long per
    second of one flying day, and only for pilots who have an anchor at all.
    """
    anchors = stationary_anchors(track) if anchors is None else anchors
    extra = [c for c in search.columns if c not in (*KEY, "before_t")]
    passed = [c for c in extra if c != "after_t"]
    # a row per pilot, written: its arrays meet the times of a flight once, not every fix of it
    held = table(anchors.join(search, KEY).where(
        (F.col("t") >= F.col("after_t")) & (F.col("close_t") <= F.col("before_t"))
    ).groupBy(*KEY).agg(F.array_sort(F.collect_list("t")).alias("held"),
                        F.max("t").alias("last_held"),
                        *[F.first(c).alias(c) for c in extra]))
    times = (track.select(*KEY, "t").join(held.select(*KEY, "after_t", "last_held"), KEY)
             .where((F.col("t") >= F.col("after_t")) & (F.col("t") <= F.col("last_held")))
             .groupBy(*KEY).agg(F.array_sort(F.collect_list("t")).alias("times"))
             .join(held.select(*KEY, "held", *passed), KEY))
    start = F.struct(F.lit(-1).cast("bigint").alias("next_t"), F.lit(None).cast("bigint").alias("t"))

    def step(acc, t):
        on_grid = acc["t"].isNull() & (t >= acc["next_t"])
        hit = on_grid & (t >= F.col("held")[0]) & F.array_contains("held", t)
        return F.struct(
            F.when(on_grid, t + SCAN_STEP_S).otherwise(acc["next_t"]).alias("next_t"),
            F.when(hit, t).otherwise(acc["t"]).alias("t"))

    found = (times.withColumn("hit", F.aggregate("times", start, step))
             .where(F.col("hit.t").isNotNull()).select(*KEY, F.col("hit.t").alias("t"), *passed))
    where = F.struct("fix_ix", F.struct("lat", "lon", F.col("alt_gps").alias("alt")).alias("at"))
    return (track.select(*KEY, "t", where.alias("f")).join(found, [*KEY, "t"])
            .groupBy(*KEY, F.col("t").alias("landing_t")).agg(F.min("f").alias("f"), *[F.first(c).alias(c) for c in passed])
            .select(*KEY, "landing_t", F.col("f.fix_ix").alias("landing_ix"), F.col("f.at").alias("landing_at"), *passed))
