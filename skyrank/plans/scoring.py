"""The scoring plan: position reports and task definitions in, ranked boards out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gap
from ..operators import exact as ex
from ..operators import landing as ld
from ..operators import ranking, starts
from ..operators.field import score_field
from ..operators.tasks import compile_courses
from ..operators.tracks import KEY, first_reports, indexed_track, project_fixes
from ..session import cut, cut_dealt, table


class Scoring:
    """All tables of one scoring run; each is built once, on first use.

    ``fixes`` may be raw reports (with ``ord``) or already one row per second.
    ``stage`` decides how the indexed track, read by several passes, is kept.
    ``course`` and ``rims`` are those of a run of the same tasks, where there is one.
    """

    def __init__(self, fixes: DataFrame, tasks: DataFrame, waypoints: DataFrame, *,
                 ellipsoid: bool = False, exact: bool = True, landing: bool = True, stage=cut, small=table,
                 integer_pots: bool = False, max_time_rule: str = "field",
                 roster: DataFrame | None = None, early_policy: str = "launch_to_sss",
                 course: DataFrame | None = None, rims: DataFrame | None = None):
        self._fixes, self._tasks, self._waypoints = fixes, tasks, waypoints
        self._ellipsoid, self._exact, self._landing = ellipsoid, exact, landing
        self._stage, self._small, self._integer_pots, self._rule = stage, small, integer_pots, max_time_rule
        self._roster, self._early = roster, early_policy
        self._course, self._rims = course, rims

    @property
    def task_rows(self) -> DataFrame:
        return self._tasks

    @property
    def waypoint_rows(self) -> DataFrame:
        return self._waypoints

    def small(self, df: DataFrame) -> DataFrame:
        """Keep a table of tasks or pilots the way this run keeps its own."""
        return self._small(df)

    @cached_property
    def course(self) -> DataFrame:
        if self._course is not None:
            return self._course
        return self._small(compile_courses(self._tasks, self._waypoints, self._ellipsoid))

    @cached_property
    def fixes(self) -> DataFrame:
        one = first_reports(self._fixes) if "ord" in self._fixes.columns else self._fixes
        return project_fixes(one, self.course, self._ellipsoid)

    @cached_property
    def track(self) -> DataFrame:
        if self._stage is not cut:
            return self._stage(indexed_track(self.fixes))
        return cut_dealt(self.fixes, indexed_track)

    @cached_property
    def events(self) -> DataFrame:
        return starts.zone_events(self.track, self.course)

    @cached_property
    def evidence(self) -> DataFrame:
        return self._stage(starts.start_evidence(self.track, self.events, self.course))

    def _chains(self, evidence: DataFrame) -> DataFrame:
        return starts.zone_chain(starts.start_candidates(evidence))

    def _play(self, chains: DataFrame) -> DataFrame:
        return starts.best_start(starts.replay(self.track, chains))

    @cached_property
    def first_choice(self) -> DataFrame:
        """Start chosen on the whole track: (start_fix, start_cross_t, goal_ix or null).

        Distances decide only where several starts compete and none reached goal, so
        only those pilots' fixes are measured.
        """
        chains = self._chains(self.evidence.withColumn("cut_ix", F.lit(None).cast("int")))
        goal = F.element_at("tags", -1)
        facts = chains.groupBy(*KEY).agg(
            F.count("*").alias("n"), F.max(goal.isNotNull()).alias("any_goal"),
            F.max(F.struct(goal.isNotNull().cast("int").alias("g"), F.col("cand_ix").alias("ix"),
                           F.col("cand_t").alias("t"), goal.alias("goal_fix"))).alias("b"))
        settled = facts.where((F.col("n") == 1) | F.col("any_goal")).select(
            *KEY, F.col("b.ix").alias("start_fix"), F.col("b.t").alias("start_cross_t"),
            F.col("b.goal_fix").alias("goal_fix"))
        open_ = facts.where((F.col("n") > 1) & ~F.col("any_goal")).select(*KEY)
        played = self._play(chains.join(open_, KEY, "left_semi")).select(
            *KEY, "start_fix", "start_cross_t", F.element_at("tags", -1).alias("goal_fix"))
        return settled.unionByName(played)

    @cached_property
    def landings(self) -> DataFrame:
        """Landings that end a flight before any goal."""
        state = self.evidence.select(*KEY, "takeoff_t", "last_t").join(self.first_choice, KEY, "left")
        search = state.select(
            *KEY, (F.coalesce("start_cross_t", "takeoff_t") + ld.AFTER_START_DELAY_S).alias("after_t"),
            F.col("last_t").alias("before_t"), "goal_fix").where(F.col("after_t").isNotNull())
        found = ld.landings(self.track, search)
        kept = found.where(F.col("goal_fix").isNull() | (F.col("goal_fix") > F.col("landing_ix")))
        return self._stage(kept.drop("goal_fix"))

    @cached_property
    def cut_evidence(self) -> DataFrame:
        if not self._landing:
            none = {"landing_t": F.lit(None).cast("long"), "landing_ix": F.lit(None).cast("int"),
                    "cut_ix": F.lit(None).cast("int"),
                    "landing_at": F.lit(None).cast("struct<lat:double,lon:double,alt:int>")}
            return self.evidence.withColumns(none)
        return self.evidence.join(self.landings, KEY, "left").withColumn("cut_ix", F.col("landing_ix"))

    @cached_property
    def candidates(self) -> DataFrame:
        return starts.start_candidates(self.cut_evidence)

    @cached_property
    def scored_start(self) -> DataFrame:
        return self._stage(self._play(starts.zone_chain(self.candidates)))

    @cached_property
    def timing(self) -> DataFrame:
        """Everything decided by starts, zones and landings, one row per pilot."""
        ev = self.cut_evidence
        at_cut = lambda c: F.when(F.col("cut_ix").isNull() | (F.col("takeoff_ix") <= F.col("cut_ix")), c)
        early = F.coalesce(F.exists("crossings", lambda c: ~c["after_gate"] & (
            c["fix_ix"] <= F.coalesce("cut_ix", F.lit(starts.NO_CUT)))), F.lit(False))
        rows = ev.select(
            *KEY, at_cut(F.col("takeoff_t")).alias("takeoff_t"), early.alias("crossed_early"),
            F.coalesce("landing_t", "last_t").alias("last_t"), F.col("last_t").alias("last_seen_t"),
            F.coalesce("landing_ix", "last_ix").alias("last_ix"), "landing_t", "landing_ix",
            *[F.coalesce(f"landing_at.{n}", f"last_{n}").alias(f"last_{n}") for n in ("lat", "lon", "alt")], "c")
        return rows.join(self.scored_start, KEY, "left")

    @cached_property
    def samples(self) -> DataFrame:
        started = self.timing.where(F.col("start_fix").isNotNull())
        return ex.sampled_fixes(self.track, started)

    @cached_property
    def distances(self) -> DataFrame:
        return self._stage(ex.exact_distances(self.samples, self.rims))

    @cached_property
    def rims(self) -> DataFrame:
        return self._small(ex.rim_blocks(self.course)) if self._rims is None else self._rims

    @cached_property
    def lead_samples(self) -> DataFrame:
        return ex.lead_samples(self.distances)

    @cached_property
    def state(self) -> DataFrame:
        """Complete per-pilot state before the field pass."""
        c = F.col
        rows = self.timing
        if self._exact:
            rows = rows.join(ex.exact_progress(self.distances), KEY, "left")
        else:
            rows = rows.withColumns({n: F.lit(None).cast("double") for n in
                                     ("exact_remaining", "exact_ix", "lead_area", "lead_min_km")})
        started, airborne = c("start_fix").isNotNull(), c("takeoff_t").isNotNull()
        early = ~started & c("crossed_early")
        raw = (F.when(~started & early, gap.early_start_distance(c("c.launch_to_sss_m"), F.lit(0.0), self._early))
               .when(~started, F.lit(0.0))
               .when(c("goal_t").isNull() & c("exact_remaining").isNotNull(),
                     F.greatest(F.lit(0.0), c("c.total_m") - c("exact_remaining")))
               .otherwise(c("raw_m")))
        use_baro = (F.lower("c.altitude_source") == "baro" if "altitude_source" in self.course.columns
                    else F.lit(False))
        rows = rows.withColumns({
            "early_start": early,
            "start_t": F.when(started, starts.gate_as_of(c("c.start_type"), c("c.gates"), c("start_cross_t"))),
            "raw_distance_m": raw,
            "distance_m": F.when(started | airborne, F.greatest(c("c.minimum_distance"), raw)).otherwise(F.lit(0.0)),
            "state": F.when(c("goal_t").isNotNull(), "GOAL").when(c("ess_t").isNotNull(), "ESS")
            .when(started, "STARTED").when(airborne, "AIRBORNE").otherwise("WAITING"),
            "dist_fix_ix": F.when(c("goal_t").isNull(), F.coalesce("exact_ix", "dist_ix")).otherwise(c("dist_ix")),
            "goal_alt": F.when(use_baro, c("goal_baro")).otherwise(c("goal_gps")).cast("double"),
            "tags_done": F.size(F.filter(F.coalesce("tags", F.array().cast("array<int>")), lambda x: x.isNotNull())),
            "last_task_time": F.coalesce((c("last_play_t") - c("c.first_gate")).cast("double"), F.lit(0.0))})
        rows = rows.withColumns({
            "next_wp": F.when(started, c("c.start_ix") + 1 + c("tags_done")).otherwise(F.lit(0)),
            "tp_count": F.least(c("tags_done"), c("c.goal_ix") - c("c.start_ix") - 1),
            "section_s": (c("ess_t") - c("start_t")).cast("double")})
        rows = rows.withColumn("speed_kmh", F.when(c("section_s") > 0, c("c.speed_m") / c("section_s") * 3.6))
        return rows.select(
            *KEY, "state", "takeoff_t", "start_t", "start_cross_t", "ess_t", "goal_t", "goal_alt",
            "distance_m", "raw_distance_m", "early_start", "section_s", "speed_kmh", "next_wp", "tp_count",
            "tags", "tag_t", "start_fix", "dist_fix_ix", "landing_t", "landing_ix", "last_t", "last_ix",
            "last_lat", "last_lon", "last_alt", "lead_area", "lead_min_km", "last_task_time",
            "min_remaining", "c")

    @cached_property
    def staged_state(self) -> DataFrame:
        return self._stage(self.state)

    @property
    def pilot_state(self) -> DataFrame:
        """The staged state without the course it carries."""
        return self.staged_state.drop("c")

    @cached_property
    def _field(self):
        return score_field(self.staged_state, self.course, self._rule, self._integer_pots, self._roster,
                           self._small)

    @property
    def scores(self) -> DataFrame:
        return self._field[0]

    @property
    def task_scores(self) -> DataFrame:
        return self._field[1]

    @cached_property
    def board(self) -> DataFrame:
        return ranking.final_ranking(self.scores)
