"""Audit tables: why a result is what it is, and checks that must always hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gap, geo
from .tracks import KEY

REPLAY_FIELDS = ["start_t", "start_cross_t", "ess_t", "goal_t", "distance_m", "raw_distance_m", "state",
                 "lead_area", "lead_min_km"]
# The fields of a published field summary.
FIELD_SUMMARY = [
    "present", "pilots_flying", "pilots_goal", "pilots_ess", "nominal_distance", "minimum_distance", "nominal_time",
    "nominal_goal", "nominal_launch", "leading_time_ratio", "launch_validity", "distance_validity", "time_validity",
    "task_validity", "goal_ratio", "distance_weight", "leading_weight", "time_weight", "arrival_weight",
    "available_distance", "available_time", "available_leading", "available_total", "best_distance", "best_time",
    "lc_min", "max_time", "speed_m", "total_m"]
EPS = 1e-6


def replay_agreement(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Fields on which a stored result and its recomputation differ, null-safely.

    Numbers may differ by rounding only: sums over fixes have no fixed order.
    """
    s = stored.select(*KEY, *[F.col(c).alias(f"s_{c}") for c in REPLAY_FIELDS])
    rows = replayed.select(*KEY, *REPLAY_FIELDS).join(s, KEY)
    kinds = dict(replayed.dtypes)

    def same(c: str) -> Column:
        a, b = F.col(c), F.col(f"s_{c}")
        equal = a.eqNullSafe(b)
        if kinds[c] == "double":
            equal |= F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), F.lit(False))
        return equal

    differs = F.array_compact(F.array(*[F.when(~same(c), F.lit(c)) for c in REPLAY_FIELDS]))
    return rows.select(*KEY, (F.size(differs) == 0).alias("agrees"), F.array_join(differs, ",").alias("mismatches"))


def _line(part: str, ref: str, formula: str, shown: Column, value: Column, when: Column | None = None) -> Column:
    row = F.struct(F.lit(part).alias("part"), F.lit(ref).alias("rule"), F.lit(formula).alias("formula"),
                   shown.alias("substituted"), value.cast("double").alias("value"))
    return row if when is None else F.when(when, row)


def points_derivation(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every points line of every pilot with its rule, its formula and the numbers put in."""
    c = F.col
    facts = tasks.select("task_id", "best_distance", "best_time", "available_distance", "available_time", "available_leading")
    rows = scores.join(facts, "task_id")
    ratio = F.when(c("best_distance") > 0, F.least(c("distance_m") / c("best_distance"), F.lit(1.0))).otherwise(F.lit(0.0))
    timed = c("goal_t").isNotNull() & (c("best_time") > 0) & (c("section_s") != 0)
    led = (c("lc") > 0) & (c("lc_min") > 0)
    sf, lf = gap.speed_fraction(c("section_s"), c("best_time")), gap.leading_factor(c("lc"), c("lc_min"))
    f = F.format_string
    lines = [
        _line("distance", "12.1", "min(flown / best, 1) x available",
              f("min(%.1f / %.1f, 1) x %.1f", c("distance_m"), c("best_distance"), c("available_distance")), c("distance_points")),
        _line("speed fraction", "12.2", "1 - ((T - best) / sqrt(best))^(5/6) in hours",
              f("T %.6f best %.6f", c("section_s") / 3600, c("best_time") / 3600), F.round(sf, 6), timed),
        _line("time", "12.2", "fraction x available x altitude factor",
              f("%.6f x %.1f x %.4f", sf, c("available_time"), c("goal_altitude_factor")), c("time_points"), timed),
        _line("time", "13.2", "end of section without goal: configured factor",
              f("factor %.2f", c("ess_factor")), c("time_points"), ~F.coalesce(timed, F.lit(False)) & c("ess_t").isNotNull()),
        _line("time", "12.2", "no time points without goal", F.lit("goal not reached"), F.lit(0.0),
              ~F.coalesce(timed, F.lit(False)) & c("ess_t").isNull()),
        _line("leading factor", "12.3", "1 - cbrt((LC - LCmin)^2 / LCmin)",
              f("LC %.6f LCmin %.6f", c("lc"), c("lc_min")), F.round(lf, 6), led),
        _line("leading", "12.3.1", "factor x available", f("%.6f x %.1f", lf, c("available_leading")), c("leading_points"), led),
        _line("leading", "12.3", "no leading points without a start", F.lit("no valid start"), F.lit(0.0), ~led),
        _line("arrival", "12.4", "never awarded", F.lit("0"), F.lit(0.0)),
        _line("total", "12", "sum of the rounded parts",
              f("%.1f + %.1f + %.1f", c("distance_points"), c("time_points"), c("leading_points")), c("total_points"))]
    return rows.select(*KEY, F.posexplode(F.array_compact(F.array(*lines))).alias("line_no", "l")).select(
        *KEY, "line_no", "l.part", "l.rule", "l.formula", "l.substituted", "l.value")


def field_summary(tasks: DataFrame) -> DataFrame:
    """The half of the score that is not about one pilot, one row per task and field."""
    rows = tasks.withColumn("available_total", F.col("available_distance") + F.col("available_time")
                            + F.col("available_leading") + F.col("available_arrival"))
    return rows.select("task_id", F.explode(F.array(*[F.struct(
        F.lit(n).alias("field"), F.col(n).cast("double").alias("value")) for n in FIELD_SUMMARY])).alias("e")
    ).select("task_id", "e.field", "e.value")


def decision_trace(events: DataFrame, candidates: DataFrame, scored: DataFrame, landings: DataFrame,
                   evidence: DataFrame) -> DataFrame:
    """What happened to a pilot in order: takeoff, crossings, the scored start, zones, landing."""
    line = lambda kind, ix, t, detail: [*KEY, F.lit(kind).alias("kind"), F.expr(ix).cast("long").alias("fix_ix"),
                                        F.expr(t).cast("long").alias("t"), detail.alias("detail")]
    none = F.lit(None).cast("string")
    parts = [
        evidence.where("takeoff_ix is not null").select(*line("takeoff", "takeoff_ix", "takeoff_t", none)),
        events.where("is_sss").select(*line("sss crossing", "fix_ix", "t", F.concat_ws(
            " ", F.when(F.col("outward"), "out").otherwise("in"), F.when(F.col("after_gate"), "after gate").otherwise("before gate"),
            F.format_string("%.0f to %.0f m", "d_prev", "d_fix")))),
        candidates.select(*KEY, F.explode("candidates").alias("s")).select(*line("candidate", "s.fix_ix", "s.t", none)),
        scored.select(*line("start", "start_fix", "start_cross_t", none)),
        scored.select(*KEY, F.posexplode(F.arrays_zip("tags", "tag_t")).alias("i", "g")).where("g.tags is not null").select(
            *line("zone", "g.tags", "g.tag_t", F.concat(F.lit("zone "), (F.col("i") + 1).cast("string")))),
        landings.select(*line("landing", "landing_ix", "landing_t", none))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def invariants(scores: DataFrame, tasks: DataFrame, course: DataFrame, track: DataFrame) -> DataFrame:
    """Relational checks on a scored field: one row per task and check with its violations.

    Orderings are compared through the least and greatest value per equal key, so no
    pair of pilots is ever formed.
    """
    c = F.col
    t = tasks.select("task_id", "task_validity", "available_distance", "available_time", "available_leading",
                     "available_arrival", "best_distance", "best_time", "distance_weight", "leading_weight", "time_weight")
    rows = scores.drop("task_validity").join(t, "task_id").join(course.select("task_id", "total_m"), "task_id")
    near = lambda a, b, e=EPS: F.abs(a - b) <= e
    per_pilot = {
        "total is the sum of parts": ~near(c("total_points"), F.round(
            c("distance_points") + c("time_points") + c("leading_points"), 1)),
        "parts within their pots": (c("distance_points") > c("available_distance") + 0.05 + EPS) | (
            c("time_points") > c("available_time") + 0.05 + EPS) | (c("leading_points") > c("available_leading") + 0.05 + EPS),
        "total within 1000 x validity": (c("total_points") > 1000 * c("task_validity") + 0.15 + EPS) | (c("total_points") < 0),
        "best distance takes the pot": near(c("distance_m"), c("best_distance")) & ~near(
            c("distance_points"), F.round("available_distance", 1)),
        "best time takes the pot": c("goal_t").isNotNull() & near(c("section_s"), c("best_time")) & ~near(
            c("time_points"), F.round(c("available_time") * c("goal_altitude_factor"), 1)),
        "least coefficient takes the pot": (c("lc") > 0) & near(c("lc"), c("lc_min"), 1e-12) & ~near(
            c("leading_points"), F.round("available_leading", 1)),
        "times in task order": (c("goal_t") < c("ess_t")) | (c("ess_t") < c("start_cross_t")) | (c("start_cross_t") < c("takeoff_t")),
        "distance within the task": (c("raw_distance_m") > c("total_m") + EPS) | (
            c("goal_t").isNotNull() & ~near(c("raw_distance_m"), c("total_m"))),
    }
    pilots = rows.groupBy("task_id").agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in per_pilot.items()])
    unpivot = lambda d, names: d.select("task_id", F.explode(F.array(*[F.struct(
        F.lit(k).alias("check"), F.col(f"`{k}`").cast("long").alias("violations")) for k in names])).alias("e")).select("task_id", "e.check", "e.violations")
    out = unpivot(pilots, per_pilot)
    sums = t.withColumn("weights sum to 1, pots to the task", F.when(
        near(c("distance_weight") + c("leading_weight") + c("time_weight"), F.lit(1.0), 1e-9)
        & (F.abs(c("available_distance") + c("available_time") + c("available_leading") + c("available_arrival")
                 - F.round(1000 * c("task_validity"), 0)) <= 0.5), 0).otherwise(1))
    out = out.unionByName(unpivot(sums, ["weights sum to 1, pots to the task"]))
    # monotone: pilots against the best value of all with a strictly lower key
    mono = {"farther never scores less": (c("distance_m"), 1000, c("distance_points"), F.lit(True)),
            "faster never scores less": (-c("section_s"), 60, c("time_points") / c("goal_altitude_factor"), c("goal_t").isNotNull())}
    from .ranking import spread_running_max
    for name, (key, width, value, population) in mono.items():
        some = rows.where(population & key.isNotNull()).select("task_id", key.cast("double").alias("k"), value.alias("v"))
        tops = some.groupBy("task_id", "k").agg(F.max("v").alias("hi"))
        before = spread_running_max(tops, ["task_id"], F.floor(c("k") / width), [c("k")], c("hi"), "prev").select("task_id", "k", "prev")
        bad = some.join(before, ["task_id", "k"]).groupBy("task_id").agg(
            F.count_if(F.coalesce(c("v") < c("prev") - 0.05 - EPS, F.lit(False))).alias(name))
        out = out.unionByName(unpivot(bad, [name]))
    stamps = rows.select(*KEY, F.explode(F.array_compact(F.array_append(F.coalesce(
        "tag_t", F.array().cast("array<bigint>")), c("start_cross_t")))).alias("t"))
    invented = stamps.join(track.select(*KEY, "t"), [*KEY, "t"], "left_anti").groupBy("task_id").agg(
        F.count("*").alias("times are fixes"))
    ref = t.select("task_id").join(invented, "task_id", "left").withColumn(
        "times are fixes", F.coalesce("times are fixes", F.lit(0)))
    return out.unionByName(unpivot(ref, ["times are fixes"]))


def as_of_monotone(ladder: DataFrame) -> DataFrame:
    """Per task and moment step: pilots whose distance fell, early-start re-scores apart.

    ``ladder`` has task_id, pilot_id, moment, distance_m, early_start, start_t.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*KEY).orderBy("moment")
    rows = ladder.withColumns({"d0": F.lag("distance_m").over(w), "e0": F.lag("early_start").over(w),
                               "s0": F.lag("start_t").over(w)})
    fell = F.col("distance_m") < F.col("d0") - EPS
    allowed = F.col("e0") & F.col("s0").isNull() & F.col("start_t").isNotNull()
    return rows.where("d0 is not null").groupBy("task_id", "moment").agg(
        F.count("*").alias("pilots"), F.count_if(fell & ~allowed).alias("regressions"),
        F.count_if(fell & allowed).alias("early_rescores"))


def geometry_assertions(course: DataFrame) -> DataFrame:
    """Zone widths, and the plane against the sphere for every pair of a task's few waypoints."""
    w = F.col("wps")
    pairs = F.flatten(F.transform(w, lambda a: F.transform(w, lambda b: F.abs(
        geo.distance(a["x"], a["y"], b["x"], b["y"]) - geo.haversine_m(a["lat"], a["lon"], b["lat"], b["lon"])))))
    width = F.forall(w, lambda a: (F.abs(a["outer"] - a["radius"] - 5) < 1e-9) & (F.abs(a["radius"] - a["inner"] - 5) < 1e-9))
    return course.select("task_id", width.alias("zones_are_5m_wide"), F.size(w).alias("waypoints"),
                         F.array_max(pairs).alias("worst_pair_m"))


def sorted_index_percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """p50 and p95 as elements n//2 and floor(0.95 n) of the sorted values, and the maximum.

    Equal values are counted first; counts then run up over whole numbers and, inside the one
    that holds an element, over its different values.
    """
    from pyspark.sql import Window
    counts = df.groupBy(by, value).agg(F.count("*").alias("k")).withColumn("whole", F.floor(value))
    coarse = counts.groupBy(by, "whole").agg(F.sum("k").alias("c"))
    up = lambda *keys: Window.partitionBy(by, *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("below", F.coalesce(F.sum("c").over(up("whole")), F.lit(0)))
    sizes = df.groupBy(by).agg(F.count("*").alias("size"), F.max(value).alias("max"))
    rows = counts.join(coarse.drop("c"), [by, "whole"]).withColumn(
        "first", F.col("below") + F.coalesce(F.sum("k").over(up("whole", value)), F.lit(0))).join(sizes, by)
    at = lambda ix: F.max(F.when((F.col("first") <= ix) & (ix < F.col("first") + F.col("k")), F.col(value)))
    return rows.groupBy(by, "size", "max").agg(
        at(F.floor(F.col("size") / 2)).alias("p50"),
        at(F.least(F.col("size") - 1, F.floor(F.col("size") * 0.95))).alias("p95"))
