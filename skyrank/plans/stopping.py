"""Stopped tasks scored again inside their windows.

Flights after the stop earn nothing, so the field is scored from the fixes that count: a pass up to
the stop finds who had started by then, which gives every pilot's window; a second pass scores what
lies inside it.  Only tasks with a stop are read again.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exact as ex
from ..operators import ranking, stopped
from ..operators.field import score_field
from ..operators.tracks import KEY, PAYLOAD
from .scoring import Scoring


class StoppedScoring:
    """All tables of a stopped field, from the run of the whole flights and a ``stops`` table.

    The start that counts is decided again inside the window: of a pilot's crossings the one that was
    worth most by its end.
    """

    def __init__(self, run: Scoring, stops: DataFrame, *, ellipsoid: bool = False):
        self._run, self._stops, self._ellipsoid = run, stops, ellipsoid

    @property
    def course(self) -> DataFrame:
        return self._run.course

    @cached_property
    def _fixes(self) -> DataFrame:
        return self._run.track.select(*KEY, "t", *PAYLOAD)

    def _tasks(self) -> DataFrame:
        return self._run.task_rows.drop("now").join(
            stopped.stop_times(self._stops).select("task_id", F.col("stop_t").alias("now")), "task_id")

    def _pass(self, fixes: DataFrame, exact: bool) -> Scoring:
        return Scoring(fixes, self._tasks(), self._run.waypoint_rows, ellipsoid=self._ellipsoid, exact=exact)

    @cached_property
    def starts(self) -> DataFrame:
        """Start times as they stood at the stop."""
        at_stop = self._pass(self._fixes.join(self._stops.select("task_id"), "task_id", "left_semi"), exact=False)
        return self._run.small(at_stop.state.select(*KEY, "start_t"))

    @cached_property
    def spans(self) -> DataFrame:
        return self._run.small(stopped.scored_spans(self.starts, self._stops, self.course))

    @cached_property
    def windows(self) -> DataFrame:
        return stopped.scored_windows(self.starts, self.spans)

    @cached_property
    def flights(self) -> Scoring:
        return self._pass(stopped.within_windows(self._fixes, self.windows, self._stops), exact=True)

    @property
    def down(self) -> DataFrame:
        """Landings of the whole flights."""
        return self._run.landings.select(*KEY, "landing_t")

    @cached_property
    def validity(self) -> DataFrame:
        return self._run.small(stopped.stopped_validity(self.flights.pilot_state, self.down, self.spans, self.course))

    @cached_property
    def last_remaining(self) -> DataFrame:
        """Exact distance to goal from the last point of each started pilot's window."""
        run = self.flights
        last = run.track.join(run.pilot_state.select(*KEY, F.col("last_ix").alias("fix_ix")), [*KEY, "fix_ix"], "left_semi")
        started = run.timing.where(F.col("start_fix").isNotNull())
        far = self._run.small(ex.exact_distances(ex.sampled_fixes(last, started), run.rims))
        return far.where(F.col("target") == "goal").select(*KEY, "d")

    @cached_property
    def bonuses(self) -> DataFrame:
        return stopped.altitude_bonuses(self.flights.pilot_state, self.last_remaining, self.down, self.spans, self.course)

    @cached_property
    def points(self) -> DataFrame:
        scores, tasks = score_field(self.flights.staged_state, self.flights.course, stage=self._run.small,
                                    factor=self.validity.select("task_id", F.col("stopped_validity").alias("factor")))
        return stopped.stopped_points(scores, tasks, self.spans, self.down, self.bonuses)

    @cached_property
    def board(self) -> DataFrame:
        """The ranking of the stopped tasks, by their own points and distances."""
        new = {"stopped_distance_m": "distance_m", "stopped_distance_points": "distance_points",
               "stopped_time_points": "time_points", "stopped_total": "total_points"}
        rows = self.points.drop(*new.values()).withColumnsRenamed(new)
        return ranking.final_ranking(rows)
