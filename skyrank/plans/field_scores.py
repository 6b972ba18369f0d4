"""Field scoring, special cases and ranking queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gap
from ..operators import field, penalties, ranking
from ..operators.tracks import KEY
from .race import Race, big, r

STATUS_AT_S = 9000


def _tasks(*cols):
    return lambda c: c.s.task_scores.select("task_id", *[x() if callable(x) else x for x in cols])


field_counts = _tasks(lambda: big("present"), "pilots_flying", "pilots_ess", "pilots_goal",
                      lambda: r("best_distance", 2))
best_time = _tasks(lambda: r("best_time", 1), lambda: r("best_ess_time", 1))
launch_validity = _tasks(lambda: r("launch_validity", 8))
distance_validity = _tasks(lambda: r("distance_validity", 8))
time_validity = _tasks(lambda: r("time_validity", 8))
task_validity = _tasks(lambda: r("task_validity", 8))
max_time = _tasks(lambda: r("max_time", 1))


def allocation(c: Race) -> DataFrame:
    names = [f"{k}_weight" for k in ("distance", "leading", "time", "arrival")]
    pots = [f"available_{k}" for k in ("distance", "leading", "time")]
    return c.s.task_scores.select("task_id", r("goal_ratio", 6), *[r(n, 8) for n in names],
                                  *[r(p, 5) for p in pots], r("implied_leading_ratio", 6),
                                  r(F.bround(F.col("available_distance"), 0), 0, "integer_distance_pot"))


def max_time_by_pilot(c: Race) -> DataFrame:
    """Leading coefficients under the stricter per-pilot clock."""
    state = c.s.staged_state
    tasks = field.task_validity(field.field_totals(state, c.s.course))
    return field.leading_coefficients(state, tasks, "code").select(*KEY, r("lc", 6))


def leading_coefficient(c: Race) -> DataFrame:
    return c.s.scores.select(*KEY, r("lc", 6), r("lc_min", 6))


def _points(name, *extra):
    return lambda c: c.s.scores.select(*KEY, r(name, 1), *[x() for x in extra])


distance_points = _points("distance_points", lambda: r("distance_m", 2))
time_points = _points("time_points", lambda: r("section_s", 1))
leading_points = _points("leading_points")


def goal_altitude_factor(c: Race) -> DataFrame:
    return c.s.scores.select(*KEY, r("goal_alt", 1), r("goal_altitude_factor", 6))


def ess_no_goal_factor(c: Race) -> DataFrame:
    return c.s.scores.select(*KEY, r("ess_factor", 2))


def task_total(c: Race) -> DataFrame:
    return c.s.scores.select(*KEY, r("distance_points", 1), r("time_points", 1), r("leading_points", 1),
                             r("total_points", 1))


def score_field(c: Race) -> DataFrame:
    return c.s.board.select(
        *KEY, "rank", "state", r("distance_m", 2), r("distance_points", 1), r("time_points", 1),
        r("leading_points", 1), r("total_points", 1), r("lc", 6))


def scored_distance(c: Race) -> DataFrame:
    out = gap.scored_distance(F.col("raw_distance_m"), F.col("c.minimum_distance"),
                              F.col("takeoff_t").isNotNull() | F.col("start_t").isNotNull())
    return c.s.staged_state.select(*KEY, r("raw_distance_m", 2), r(out, 2, "scored_m"))


def per_task_overrides(c: Race) -> DataFrame:
    """Effective parameters: a run-wide override wins, then the task's own, then the competition's."""
    base = c.views.task_rows()
    over = base.where("task_no % 3 = 1").select(
        "task_id", F.lit(0.2632).alias("o_ltr"), F.lit(75.0).alias("o_time_min"),
        F.when(F.col("task_no") % 2 == 0, F.lit(1500.0)).alias("o_goal_m"))
    from ..sources.params import task_parameters
    return task_parameters(base, over).select(
        "task_id", r("leading_time_ratio", 4), r("nominal_time", 1), "goal_elevated", r("goal_elevation", 1), "warning")


def penalty_match(c: Race) -> DataFrame:
    return penalties.match_penalties(c.views.penalties(), c.views.pilots()).select(
        "task_id", "ord", "pilot_key", "pilot_id", "outcome")


def _penalised(c: Race) -> DataFrame:
    return penalties.apply_penalties(
        c.s.scores, penalties.match_penalties(c.views.penalties(), c.views.pilots()))


def penalties_apply(c: Race) -> DataFrame:
    return _penalised(c).select(*KEY, r("gross_points", 1), r("penalty_points", 4), r("total_points", 1),
                                "penalty_reasons")


def _stops(c: Race) -> DataFrame:
    return c.views.task_rows().where("task_no % 2 = 1").select(
        "task_id", (F.col("gate") + 4800).alias("announced_t"), F.lit(300).alias("score_back_s"),
        F.lit(3600).alias("minimum_time_s"), F.lit(5.0).alias("glide_ratio"))


def stopped_task(c: Race) -> DataFrame:
    return c.stopped(_stops(c)).validity.select(
        "task_id", "stop_t", big("duration_s"), "reached_ess", "landed", "launched", r("best_m", 2), r("mean_m", 2),
        r("stopped_validity", 6))


def stopped_window(c: Race) -> DataFrame:
    return c.stopped(_stops(c)).windows


def stopped_points(c: Race) -> DataFrame:
    return c.stopped(_stops(c)).points.select(
        *KEY, r("reduction", 4), r("stopped_time_points", 1), r("stopped_distance_points", 1), r("leading_points", 1))


def altitude_bonus(c: Race) -> DataFrame:
    return c.stopped(_stops(c)).bonuses.select(
        *KEY, r("bonus_m", 2), r("bonus_distance_m", 2), r("stopped_distance_m", 2))


def stopped_board(c: Race) -> DataFrame:
    return c.stopped(_stops(c)).board.select(*KEY, "rank", "state", r("distance_m", 2), r("total_points", 1))


def final_ranking(c: Race) -> DataFrame:
    return ranking.final_ranking(_penalised(c)).select(
        *KEY, "rank", "state", r("distance_m", 2), r("total_points", 1))


def progress_ranking(c: Race) -> DataFrame:
    """The live order of a field whose points do not exist yet."""
    rows = c.s.pilot_state.withColumn("total_points", F.lit(0.0))
    return ranking.progress_ranking(rows).select(*KEY, "rank", "state")


def classification(c: Race) -> DataFrame:
    return ranking.classification(c.s.board, c.s.course).select(
        *KEY, "rank", "state", r("total_points", 1, "score"), big("next_waypoint_index"), "next_waypoint",
        r("distance_to_next_m", 1), r("distance_to_goal_m", 1), r("progress_percent", 3))


def top_n(c: Race) -> DataFrame:
    return ranking.top_n(c.s.board, 3).select(*KEY, "rank", r("total_points", 1))


def _at(c: Race) -> DataFrame:
    return c.s.staged_state.withColumns({"now": F.col("c.first_gate") + STATUS_AT_S, "first_gate": F.col("c.first_gate")})


def tracking_status(c: Race) -> DataFrame:
    return ranking.tracking_status(_at(c)).select(*KEY, "status", "tracking", "age_s")


def board_counts(c: Race) -> DataFrame:
    return ranking.board_counts(_at(c))


QUERIES = {name: globals()[name] for name in (
    "field_counts best_time launch_validity distance_validity time_validity task_validity allocation max_time "
    "max_time_by_pilot leading_coefficient distance_points time_points leading_points goal_altitude_factor "
    "ess_no_goal_factor task_total score_field scored_distance per_task_overrides penalty_match penalties_apply "
    "stopped_task stopped_window stopped_points altitude_bonus stopped_board final_ranking progress_ranking classification top_n "
    "tracking_status board_counts").split()}
