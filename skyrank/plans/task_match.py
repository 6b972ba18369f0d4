"""Task and track matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching as m
from ..operators.tracks import KEY
from ..session import table
from .race import Race, big, r


def zone_reach(c: Race) -> DataFrame:
    return m.zone_reach(c.s.track, c.s.course).select(
        "task_id", big("wp_ix"), "reached", "pilots", r("share", 4), r("median_closest_m", 2), "suspect")


def start_analysis(c: Race) -> DataFrame:
    return m.start_analysis(c.s.events, c.s.course, m.field_sizes(c.s.track))


def first_entries(c: Race) -> DataFrame:
    return m.first_entries(c.s.track, m.unique_zones(c.s.course)).select(*KEY, big("wp_ix"), "entry_t")


def _scored_route(c: Race) -> DataFrame:
    zones = m.unique_zones(c.s.course).where(F.col("z.wp_ix") >= F.col("start_ix"))
    return zones.groupBy("task_id").agg(F.array_sort(F.collect_list("z.wp_ix")).alias("ixs"))


def task_completers(c: Race) -> DataFrame:
    route, sizes = _scored_route(c), m.field_sizes(c.s.track)
    entries = table(m.first_entries(c.s.track, m.unique_zones(c.s.course)))
    part = m.longest_subroute(entries, route, sizes).select("task_id", F.col("completed").alias("part"))
    rows = sizes.join(m.completers(entries, route), "task_id", "left").join(part, "task_id", "left")
    full = F.coalesce("completed", F.lit(0))
    return rows.select("task_id", "pilots", full.alias("completed"), F.when(full > 0, "as written").when(
        F.col("part").isNotNull(), "shortened").otherwise("no relation").alias("verdict"))


def longest_flown_subroute(c: Race) -> DataFrame:
    entries = m.first_entries(c.s.track, m.unique_zones(c.s.course))
    return m.longest_subroute(entries, _scored_route(c), m.field_sizes(c.s.track)).select(
        "task_id", big("length"), "completed", F.array_join(F.col("ixs").cast("array<string>"), ",").alias("route"))


def last_exit(c: Race) -> DataFrame:
    before = c.s.evidence.select(*KEY, F.col("next_t").alias("before_t"))
    rows = m.last_exits(c.s.events, before)
    gates = rows.groupBy("task_id").agg(F.min("exit_t").alias("inferred_gate"))
    return rows.join(gates, "task_id").select(*KEY, "exit_t", "inferred_gate")


def reconstruct_task(c: Race) -> DataFrame:
    return m.reconstruct(c.s.track, c.s.course, m.field_sizes(c.s.track))


QUERIES = {f.__name__: f for f in (zone_reach, start_analysis, first_entries, task_completers,
                                   longest_flown_subroute, last_exit, reconstruct_task)}
