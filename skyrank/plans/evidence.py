"""Comparison and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, compare
from ..operators.tracks import KEY
from ..sources import official as off
from .race import MOMENTS_S, Race, big, r

TZ_S = 7200


def official_lines(c: Race) -> DataFrame:
    """Published tables derived from the boards: some rows shifted, some missing, one stranger per task."""
    n = F.col("pilot_id").cast("long")
    b = c.board.join(c.views.task_rows().select("task_id", "midnight"), "task_id").where(n % 25 != 9)
    dash = lambda e: F.coalesce(e, F.lit("-"))
    clock = lambda s: F.date_format(F.timestamp_seconds(s), "HH:mm:ss")
    num = lambda e, d: F.format_string(f"%.{d}f", e)
    shift = F.when(n % 10 == 6, F.lit(0.3)).otherwise(F.lit(0.0))
    cells = [F.col("rank").cast("string"), F.col("pilot_id"), F.concat(F.lit("P. "), n.cast("string")),
             dash(clock(F.col("start_t") + TZ_S)), dash(F.when(F.col("goal_t").isNotNull(), clock(F.col("ess_t") + TZ_S))),
             dash(F.when(F.col("goal_t").isNotNull(), clock(F.col("section_s").cast("long")))),
             dash(num(F.col("goal_alt"), 0)), dash(F.when(F.col("goal_t").isNotNull(), num(F.col("speed_kmh"), 1))),
             num(F.col("distance_m") / 1000, 1), num(F.col("distance_points"), 1), num(F.col("leading_points"), 1),
             F.when(F.col("goal_t").isNotNull(), num(F.col("time_points") + 1.5, 1)).otherwise("(-)"),
             F.when(F.col("goal_t").isNotNull(), F.lit("-1.5")).otherwise("-"), num(F.col("total_points") + shift, 1)]
    rows = b.select("task_id", F.array_join(F.array(*cells), "\t").alias("value"))
    extra = c.views.task_rows().select("task_id", F.concat(F.lit("999\tX"), "task_id", F.lit("\tA. Stranger" + "\t-" * 10 + "\t0.0")).alias("value"))
    comment = c.views.task_rows().select("task_id", F.lit("# published result").alias("value"))
    return rows.unionByName(extra).unionByName(comment)


def _official(c: Race) -> DataFrame:
    return off.parse_lines(official_lines(c))


def _scored(c: Race) -> DataFrame:
    files = c.views.pilots().select("pilot_id", compare.file_pilot_id(F.col("source_file")).alias("pid"))
    return c.board.join(files, "pilot_id").join(
        c.views.task_rows().select("task_id", "midnight", F.lit(TZ_S).alias("tz_s")), "task_id")


def _joined(c: Race) -> DataFrame:
    return compare.join_official(_scored(c), _official(c))


def official_tsv(c: Race) -> DataFrame:
    return _official(c).select("task_id", "rank", "pid", "name", "start_s", "finish_s", "time_s", *[
        r(n, 1) for n in ("height_m", "speed_kmh", "distance_km", "dist_p", "lead_p", "spd_p", "low_p", "score")])


def official_join(c: Race) -> DataFrame:
    return _joined(c).select("task_id", "pid", "side", "rank", F.col("o.rank").alias("official_rank"))


def id_set_differences(c: Race) -> DataFrame:
    """Published without a track, scored but unpublished, tracked but missing from the results."""
    ids = lambda d: d.select("task_id", "pid")
    published, scored = ids(_official(c)), ids(_scored(c))
    tracked = c.views.pilots().select("task_id", compare.file_pilot_id(F.col("source_file")).alias("pid"))
    tag = lambda d, n: d.withColumn("difference", F.lit(n))
    return tag(published.subtract(tracked), "published without track").unionByName(
        tag(scored.subtract(published), "scored but unpublished")).unionByName(tag(tracked.subtract(scored), "missing from results"))


def pilot_ids_from_tracks(c: Race) -> DataFrame:
    n = F.col("pilot_id").cast("long")
    file = F.when(n % 3 == 0, F.concat(F.lit("tracks/Ñandú-"), "pilot_id", F.lit(".igc"))).otherwise(F.col("source_file"))
    name = F.concat(F.lit("  José Müller "), n.cast("string"), F.lit("! "))
    return c.views.pilots().select("task_id", "pilot_id", F.coalesce(compare.file_pilot_id(file), compare.slug_id(name)).alias("derived_id"))


def compare_task(c: Race) -> DataFrame:
    return compare.compare_tasks(c.s.task_scores, _official(c))


def compare_pilots(c: Race) -> DataFrame:
    return compare.compare_pilots(compare.pilot_deltas(_joined(c))).select(
        "task_id", "metric", "n", "within", r("mean_abs", 3), r("worst", 3), "worst_pid")


def compare_ranks(c: Race) -> DataFrame:
    return compare.compare_ranks(_joined(c))


def top_differences(c: Race) -> DataFrame:
    """The largest total differences of each task."""
    from ..operators.ranking import spread_row_number
    d = _joined(c).where("side = 'both'").withColumn("diff", F.round(F.abs(F.col("total_points") - F.col("o.score")), 1))
    ranked = spread_row_number(d.select("task_id", "pid", "diff"), ["task_id"], [F.floor(-F.col("diff"))],
                               [F.col("diff").desc(), F.col("pid")], "place")
    return ranked.where("place <= 3")


def comparison_export(c: Race) -> DataFrame:
    from ..sinks.exports import comparison_lines
    return comparison_lines(_joined(c))


def replay_agreement(c: Race) -> DataFrame:
    """Stored results, some of them altered, against the state scored again from the raw reports."""
    n = F.col("pilot_id").cast("long")
    stored = c.s.pilot_state.withColumns({
        "distance_m": F.col("distance_m") + F.when(n % 9 == 0, 1.0).otherwise(0.0),
        "state": F.when(n % 14 == 0, "ESS").otherwise(F.col("state"))})
    return audit.replay_agreement(stored, c.replayed.pilot_state)


def points_derivation(c: Race) -> DataFrame:
    return audit.points_derivation(c.s.scores, c.s.task_scores).select(
        *KEY, big("line_no"), "part", "rule", "substituted", r("value", 4))


def field_summary(c: Race) -> DataFrame:
    return audit.field_summary(c.s.task_scores).select("task_id", "field", r("value", 4))


def competition_summary(c: Race) -> DataFrame:
    events = c.views.task_rows().select("task_id", F.floor(F.col("task_no") / 3).alias("event_id"))
    roster = c.views.pilots().join(events, "task_id").groupBy("event_id").agg(F.count("*").alias("registered"))
    tasks = events.join(c.s.task_scores, "task_id", "left").groupBy("event_id").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("pilots_flying") > 0).alias("scored_tasks"),
        F.sum("pilots_flying").alias("flights"), F.sum("pilots_goal").alias("goals"), F.max("task_validity").alias("best_validity"))
    return tasks.join(roster, "event_id", "left").select(
        "event_id", "tasks", "scored_tasks", "flights", "goals", r("best_validity", 6), "registered")


def decision_trace(c: Race) -> DataFrame:
    return audit.decision_trace(c.s.events, c.s.candidates, c.s.scored_start, c.s.landings, c.s.evidence)


def input_hashes(c: Race) -> DataFrame:
    return c.views.table("pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.sha2("url", 256).substr(1, 16).alias("short_hash"))


def field_invariants(c: Race) -> DataFrame:
    return audit.invariants(c.s.scores, c.s.task_scores, c.s.course, c.s.track)


def as_of_monotone(c: Race) -> DataFrame:
    rows = c.ladder.pilot_state.withColumns({
        "moment": F.element_at(F.split("task_id", "@"), -1).cast("long"), "task_id": F.split("task_id", "@")[0]})
    return audit.as_of_monotone(rows)


def geometry_assertions(c: Race) -> DataFrame:
    return audit.geometry_assertions(c.s.course).select("task_id", "zones_are_5m_wide", big("waypoints"), r("worst_pair_m", 2))


def latency_percentiles(c: Race) -> DataFrame:
    return audit.sorted_index_percentiles(c.views.table("events"), "event_type", "value").select(
        "event_type", "size", r("max", 2), r("p50", 2), r("p95", 2))


QUERIES = {f.__name__: f for f in (
    official_tsv, official_join, id_set_differences, pilot_ids_from_tracks, compare_task, compare_pilots, compare_ranks,
    top_differences, comparison_export, replay_agreement, points_derivation, field_summary, competition_summary,
    decision_trace, input_hashes, field_invariants, as_of_monotone, geometry_assertions, latency_percentiles)}
