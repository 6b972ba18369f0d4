"""Zone events of a track, start candidates and the ordered zone chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .tracks import KEY, course_struct, track_facts

NO_CUT = 2147483647


def zone_events(track: DataFrame, course: DataFrame) -> DataFrame:
    """Per segment and zone from the SSS on: SSS crossings and contacts with later zones.

    Each segment meets the zones of its own task only, by ``explode`` of the course
    array; what is neither a crossing nor a contact is dropped in the same stage.
    """
    zones = course.select(
        "task_id", "first_gate", "deadline", "start_ix",
        F.slice("wps", F.col("start_ix") + 1, F.col("goal_ix") - F.col("start_ix") + 1).alias("zones"))
    seg = (track.where(F.col("px").isNotNull())
           .select(*KEY, "fix_ix", "t", "px", "py", "x", "y")
           .join(zones, "task_id")
           .select(*KEY, "fix_ix", "t", "px", "py", "x", "y", "first_gate", "deadline", "start_ix",
                   F.explode("zones").alias("z"))
           .withColumn("d_prev", geo.distance(F.col("px"), F.col("py"), F.col("z.x"), F.col("z.y")))
           .withColumn("d_fix", geo.distance(F.col("x"), F.col("y"), F.col("z.x"), F.col("z.y"))))
    d0, d1, outer = F.col("d_prev"), F.col("d_fix"), F.col("z.outer")
    moved = geo.boundary_transition(d0, d1, F.col("z.inner"), outer)
    chord = (d0 > outer) & (d1 > outer) & geo.chord_hits(
        F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("z.x"), F.col("z.y"), outer)
    touched = (d1 <= outer) | (d0 <= outer)
    is_sss = F.col("z.wp_ix") == F.col("start_ix")
    return (seg.withColumns({"transition": moved, "segment_only": chord & ~moved})
            .where(F.col("segment_only") | F.when(is_sss, F.col("transition")).otherwise(touched))
            .select(*KEY, F.col("z.wp_ix").alias("wp_ix"), "fix_ix", "t", is_sss.alias("is_sss"),
                    (F.col("t") >= F.col("first_gate")).alias("after_gate"),
                    F.coalesce(F.col("t") > F.col("deadline"), F.lit(False)).alias("late"),
                    (F.col("wp_ix") == F.col("start_ix") + 1).alias("is_next"),
                    "transition", "segment_only", (d1 > d0).alias("outward"), "d_prev", "d_fix", outer.alias("outer"))
            .repartition(*KEY))


def event_runs(events: DataFrame) -> DataFrame:
    """SSS crossings one by one, and consecutive contacts with a zone compressed to [lo, hi].

    Contacts after the deadline form runs of their own, so the chain can leave them out.
    """
    w = Window.partitionBy(*KEY, "wp_ix", "late").orderBy("fix_ix")
    island = F.when(F.col("is_sss"), F.col("fix_ix")).otherwise(F.col("fix_ix") - F.row_number().over(w))
    return events.withColumn("island", island).groupBy(*KEY, "wp_ix", "late", "is_sss", "is_next", "island").agg(
        F.min("fix_ix").alias("lo"), F.max("fix_ix").alias("hi"), F.min("t").alias("t"),
        F.max("after_gate").alias("after_gate"))


def start_evidence(track: DataFrame, events: DataFrame, course: DataFrame) -> DataFrame:
    """One row per pilot with everything the start and the chain depend on.

    Both arrays are bounded by the seconds of a flying day and are short in practice:
    one entry per crossing, and one per stay in a zone.
    """
    found = event_runs(events).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_sss"), F.struct(
            F.col("lo").alias("fix_ix"), "t", "after_gate")))).alias("crossings"),
        F.array_sort(F.collect_list(F.when(~F.col("is_sss") & ~F.col("late"), F.struct("wp_ix", "lo", "hi")))
                     ).alias("runs"),
        F.min(F.when(F.col("is_next"), F.col("lo"))).alias("next_ix"),
        F.min(F.when(F.col("is_next"), F.col("t"))).alias("next_t"))
    return (track_facts(track).join(found, KEY, "left")
            .join(course_struct(course), "task_id"))


def is_multi_start(start_type: Column, gates: Column) -> Column:
    return (F.size(gates) > 1) | ~F.upper(start_type).startswith("RACE")


def gate_as_of(start_type: Column, gates: Column, cross_t: Column) -> Column:
    """Start clock of a crossing: in a race the latest gate at or before it, else the first gate;
    the crossing itself otherwise."""
    passed = F.array_max(F.filter(gates, lambda g: g <= cross_t))
    return F.when(F.upper(start_type).startswith("RACE"), F.coalesce(passed, gates[0])).otherwise(cross_t)


def start_candidates(evidence: DataFrame, most: int | None = None) -> DataFrame:
    """Narrow the crossings after the gate to those worth playing forward.

    ``cut_ix`` (the landing fix, or null) ends the evidence early.  ``most`` limits the crossings that
    are played; by default all are, since the last start that reaches goal may be any of them.
    """
    cut = F.coalesce(F.col("cut_ix"), F.lit(NO_CUT))
    usable = F.coalesce(F.filter("crossings", lambda c: c["fix_ix"] <= cut), F.array().cast(
        "array<struct<fix_ix:int,t:bigint,after_gate:boolean>>"))
    rows = evidence.withColumn("usable", usable).withColumns({
        "after": F.filter("usable", lambda c: c["after_gate"]),
        "next_ix": F.when(F.col("next_ix") <= cut, F.col("next_ix"))})
    before = F.filter("after", lambda c: c["fix_ix"] <= F.col("next_ix"))
    earliest = F.col("after") if most is None else F.slice("after", 1, most)
    picked = (F.when(is_multi_start(F.col("c.start_type"), F.col("c.gates")), earliest)
              .when(F.col("next_ix").isNotNull() & (F.size("before") > 0), F.slice("before", -1, 1))
              .otherwise(earliest))
    return rows.withColumn("before", before).withColumn("candidates", picked).drop("usable", "before")


def zone_chain(candidates: DataFrame) -> DataFrame:
    """Validate the zones in order after each candidate start.

    Tag k is the first contact with zone k at a later fix than tag k-1: the first
    run that ends after it, entered no earlier than the next fix.
    """
    rows = candidates.select(*KEY, "cut_ix", "runs", "c", F.explode("candidates").alias("s"))
    cut = F.coalesce(F.col("cut_ix"), F.lit(NO_CUT))

    def step(acc, zone):
        run = F.get(F.filter("runs", lambda r: (r["wp_ix"] == zone) & (r["hi"] > acc["ix"])), F.lit(0))
        at = F.greatest(run["lo"], acc["ix"] + 1)
        ix = F.when(run.isNotNull() & (at <= cut), at)
        return F.struct(ix.alias("ix"), F.concat(acc["tags"], F.array(ix)).alias("tags"))

    chain = F.aggregate(
        F.sequence(F.col("c.start_ix") + 1, F.col("c.goal_ix")),
        F.struct(F.col("s.fix_ix").alias("ix"), F.array().cast("array<int>").alias("tags")),
        step, lambda acc: acc["tags"])
    return rows.select(*KEY, "cut_ix", F.col("s.fix_ix").alias("cand_ix"), F.col("s.t").alias("cand_t"),
                       chain.alias("tags"), "c")


def chain_legs(chains: DataFrame, *carry: str) -> DataFrame:
    """Which fixes are measured to which zone: one row per (candidate, zone still wanted).

    The fix that tags a zone is already measured to the next one; one last row
    after the goal carries the goal fix itself.
    """
    rows = chains.withColumn("leg", F.explode(F.sequence(F.lit(0), F.size("tags"))))
    entered = F.when(F.col("leg") == 0, F.col("cand_ix")).otherwise(F.get("tags", F.col("leg") - 1))
    left = F.when(F.col("leg") == F.size("tags"), F.col("from_ix")).otherwise(
        F.coalesce(F.get("tags", F.col("leg")) - 1, F.col("cut_ix"), F.lit(NO_CUT)))
    z = F.get("c.wps", F.col("wp_ix"))
    return (rows.withColumn("from_ix", entered).where(F.col("from_ix").isNotNull())
            .withColumn("to_ix", left).withColumn("wp_ix", F.col("c.start_ix") + 1 + F.col("leg"))
            .select(*KEY, "cand_ix", "cand_t", "tags", "leg", "wp_ix", "from_ix", "to_ix",
                    F.col("c.goal_ix").alias("goal_ix"), F.col("c.deadline").alias("deadline"),
                    F.col("c.total_m").alias("total_m"), z["x"].alias("wx"), z["y"].alias("wy"),
                    z["measure"].alias("wm"), z["remaining"].alias("w_rem"), *carry))


def remaining_column() -> Column:
    """Distance still to fly on a leg row joined with a fix (zero after the goal)."""
    return F.when(F.col("wp_ix") > F.col("goal_ix"), F.lit(0.0)).otherwise(
        geo.edge_distance(F.col("x"), F.col("y"), F.col("wx"), F.col("wy"), F.col("wm")) + F.col("w_rem"))


def on_legs(track: DataFrame, legs: DataFrame) -> DataFrame:
    """Each fix joined with the leg it is flown on; both sides are clustered by pilot."""
    return track.join(legs, KEY).where(
        (F.col("fix_ix") >= F.col("from_ix")) & (F.col("fix_ix") <= F.col("to_ix"))
        & (F.col("deadline").isNull() | (F.col("t") <= F.col("deadline"))
           | (F.col("fix_ix") == F.col("cand_ix"))))


def replay(track: DataFrame, chains: DataFrame) -> DataFrame:
    """Result of playing each candidate forward: tag times, least remaining distance, last time.

    Distance counts from the fix after the start; the start fix stands for a pilot
    who still has the whole task to fly.
    """
    legs = chain_legs(chains, *[F.col(f"c.{x}").alias(x) for x in ("start_ix", "ess_ix")])
    rows = on_legs(track.select(*KEY, "fix_ix", "t", "x", "y", "alt_gps", "alt_baro"), legs)
    at_start = F.col("fix_ix") == F.col("cand_ix")
    rem = F.when(at_start, F.col("total_m")).otherwise(remaining_column())
    per_leg = rows.groupBy(*KEY, "cand_ix", "leg").agg(
        F.min(F.struct(rem.alias("rem"), "fix_ix")).alias("best"),
        F.min("t").alias("entered_t"), F.max(F.when(~at_start, F.col("t"))).alias("last_t"),
        F.min_by("alt_gps", "t").alias("entered_gps"), F.min_by("alt_baro", "t").alias("entered_baro"),
        *[F.first(x).alias(x) for x in ("cand_t", "tags", "total_m", "start_ix", "ess_ix", "goal_ix")])
    return per_leg.groupBy(*KEY, "cand_ix").agg(
        F.min("best").alias("best"), F.max("last_t").alias("last_play_t"),
        F.array_sort(F.collect_list(F.struct("leg", "entered_t", "entered_gps", "entered_baro"))
                     ).alias("entries"),
        *[F.first(x).alias(x) for x in ("cand_t", "tags", "total_m", "start_ix", "ess_ix", "goal_ix")])


def best_start(replayed: DataFrame) -> DataFrame:
    """The start that scores: goal beats none, the latest among goals, else the longest, earliest."""
    entry = lambda leg, field: F.get(F.filter("entries", lambda e: e["leg"] == leg), F.lit(0))[field]
    n = F.size("tags")
    goal = F.get("tags", n - 1).isNotNull()
    least = F.least(F.col("total_m"), F.col("best.rem"))
    ess_leg = F.col("ess_ix") - F.col("start_ix")
    rows = replayed.withColumns({
        "in_goal": goal,
        "raw_m": F.when(goal, F.col("total_m")).otherwise(
            F.greatest(F.lit(0.0), F.col("total_m") - least)),
        "min_remaining": least,
        "dist_ix": F.when(F.col("best.rem") < F.col("total_m"), F.col("best.fix_ix")
                          ).otherwise(F.col("cand_ix")),
        "ess_t": F.when(F.get("tags", ess_leg - 1).isNotNull(), entry(ess_leg, "entered_t")),
        "goal_t": F.when(goal, entry(n, "entered_t")),
        "goal_gps": F.when(goal, entry(n, "entered_gps")),
        "goal_baro": F.when(goal, entry(n, "entered_baro")),
        "tag_t": F.transform(F.col("tags"), lambda ix, i: F.when(
            ix.isNotNull(), entry(i + 1, "entered_t")))})
    payload = ["cand_t", "tags", "tag_t", "raw_m", "min_remaining", "dist_ix", "ess_t", "goal_t",
               "goal_gps", "goal_baro", "last_play_t"]
    order = F.struct(
        F.col("in_goal").cast("int").alias("goal"),
        F.when(F.col("in_goal"), F.lit(0.0)).otherwise(F.col("raw_m")).alias("far"),
        F.when(F.col("in_goal"), F.col("cand_ix")).otherwise(-F.col("cand_ix")).alias("tie"))
    return (rows.groupBy(*KEY).agg(F.max(F.struct(order.alias("o"), "cand_ix", *payload)).alias("b"))
            .select(*KEY, F.col("b.cand_ix").alias("start_fix"), *[F.col(f"b.{p}") for p in payload])
            .withColumnRenamed("cand_t", "start_cross_t"))


def remaining_by_fix(track: DataFrame, scored: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distance still to fly at every fix of the scored run, with the zone it is measured to."""
    chains = scored.select(*KEY, F.col("start_fix").alias("cand_ix"), F.col("start_cross_t").alias("cand_t"), "tags").join(
        evidence.select(*KEY, "cut_ix", "c"), KEY)
    rows = on_legs(track.select(*KEY, "fix_ix", "t", "x", "y"), chain_legs(chains))
    return rows.where(F.col("fix_ix") > F.col("cand_ix")).select(
        *KEY, "fix_ix", "t", "wp_ix", remaining_column().alias("remaining"))
