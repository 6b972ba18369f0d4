"""Geometry, route, track and pilot-state queries over the race views."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import Views
from ..functions import geo, leading
from ..functions.geodesic import ellipsoid_latlon, ellipsoid_xy, geodesic_direct, geodesic_inverse
from ..operators import exact as ex
from ..operators import quality, starts, tasks, tracks
from ..operators.tracks import KEY
from ..session import ensure_checkpoint_dir, table, tune
from .scoring import Scoring
from .stopping import StoppedScoring


def r(col, digits: int, name: str | None = None) -> Column:
    out = F.round(col, digits)
    return out.alias(name or (col if isinstance(col, str) else "value"))


def big(col, name: str | None = None) -> Column:
    return F.col(col).cast("long").alias(name or col) if isinstance(col, str) else col.cast("long").alias(name)


MOMENTS_S = (1800, 4500, 7200)


class Race:
    """One data directory with its views and its scoring run, shared by every query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        tune(spark)
        ensure_checkpoint_dir(spark)
        self.spark, self.sf_dir, self.views = spark, sf_dir, Views(spark, sf_dir)
        self._stopped, self._moments = None, {}

    @cached_property
    def s(self) -> Scoring:
        v = self.views
        return Scoring(v.raw_fixes(), v.task_rows(), v.waypoint_rows())

    def stopped(self, stops: DataFrame) -> StoppedScoring:
        """The run of the stopped tasks; built for the first ``stops`` table it is asked for."""
        if self._stopped is None:
            self._stopped = StoppedScoring(self.s, stops)
        return self._stopped

    @cached_property
    def replayed(self) -> Scoring:
        """A second run from the raw reports, dealt out by arrival instead of by file."""
        v = self.views
        return Scoring(v.raw_fixes().repartition("ord"), v.task_rows(), v.waypoint_rows())

    @cached_property
    def ladder(self) -> Scoring:
        """The same races scored at several moments in one run."""
        return self._as_of(MOMENTS_S)

    def as_of(self, moment: int) -> Scoring:
        """A run that knows the races at ``moment``: the ladder where there is one, else a run of that moment."""
        if "ladder" in self.__dict__:
            return self.ladder
        if moment not in self._moments:
            self._moments[moment] = self._as_of([moment])
        return self._moments[moment]

    def _as_of(self, moments) -> Scoring:
        """A (task, moment) pair is a task of its own that knows nothing later than the moment.

        Reports of one second are settled before they are told to the pairs, and a pair takes only those up to
        its moment.  Its course is that of the task, whatever the moment.
        """
        v, at = self.views, "task_id || '@' || moment"
        each = F.explode(F.array(*[F.lit(m) for m in moments]))
        now = F.col("gate") + F.col("moment")
        tag = lambda d: d.withColumn("moment", each).withColumn("task_id", F.expr(at))
        pairs = table(v.task_rows().withColumn("moment", each).select(
            F.col("task_id").alias("of_task"), F.expr(at).alias("task_id"), now.alias("now")))
        fixes = tracks.first_reports(v.raw_fixes()).withColumnRenamed("task_id", "of_task").join(pairs, "of_task").where(
            "now is null or t <= now").drop("of_task", "now")
        return Scoring(fixes, tag(v.task_rows()).withColumn("now", now).drop("moment"), tag(v.waypoint_rows()).drop("moment"),
                       course=table(tag(self.s.course).withColumn("now", now).drop("moment")),
                       rims=table(tag(self.s.rims).drop("moment")))

    @cached_property
    def board(self) -> DataFrame:
        """The board, written, for queries that read it more than once."""
        return table(self.s.board)

    @cached_property
    def wps(self) -> DataFrame:
        return tasks.waypoints_of(self.s.course)


def haversine_legs(c: Race) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy("wp_ix")
    rows = c.wps.join(c.s.course.select("task_id", "start_ix"), "task_id").withColumn(
        "leg", geo.haversine_m(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)))
    centre = F.sum(F.when(F.col("wp_ix") >= F.col("start_ix"), F.col("leg"))).over(Window.partitionBy("task_id"))
    return rows.select("task_id", big("wp_ix"), r("leg", 3, "leg_m"), r(centre, 3, "centre_m"))


def project_fixes(c: Race) -> DataFrame:
    return c.s.track.select(*KEY, "t", r("x", 2), r("y", 2))


def unproject(c: Race) -> DataFrame:
    rows = c.s.track.select(*KEY, "t", "x", "y").join(c.s.course.select("task_id", "clat", "clon"), "task_id")
    lat, lon = geo.plane_latlon(F.col("x"), F.col("y"), F.col("clat"), F.col("clon"))
    micro = lambda deg, name: F.floor(deg * 1e6 + 0.2718281).alias(name)   # whole micro-degrees
    return rows.select(*KEY, "t", micro(lat, "lat_udeg"), micro(lon, "lon_udeg"))


def _leg_pairs(c: Race) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy("wp_ix")
    return c.wps.withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")


def geodesic_pairs(c: Race) -> DataFrame:
    g = geodesic_inverse("lat", "lon", "lat2", "lon2")
    return _leg_pairs(c).withColumn("g", g).select(
        "task_id", "wp_ix", r("g.distance_m", 3, "distance_m"), r("g.bearing", 6, "bearing"),
        r("g.final_bearing", 6, "final_bearing"))


def geodesic_points(c: Race) -> DataFrame:
    rows = _leg_pairs(c).withColumn("g", geodesic_inverse("lat", "lon", "lat2", "lon2"))
    rows = rows.withColumn("p", geodesic_direct("lat", "lon", "g.bearing", "g.distance_m"))
    return rows.select("task_id", "wp_ix", r("p.lat", 8, "lat"), r("p.lon", 8, "lon"),
                       r(F.hypot(F.col("p.lat") - F.col("lat2"), F.col("p.lon") - F.col("lon2")), 8, "error_deg"))


def ellipsoid_plane(c: Race) -> DataFrame:
    rows = c.wps.join(c.s.course.select("task_id", "clat", "clon"), "task_id")
    x, y = ellipsoid_xy(*[F.col(n) for n in ("lat", "lon", "clat", "clon")])
    rows = rows.withColumns({"ex": x, "ey": y}).withColumn("back", ellipsoid_latlon(
        F.col("ex"), F.col("ey"), F.col("clat"), F.col("clon")))
    return rows.select("task_id", "wp_ix", r("ex", 3), r("ey", 3), r("back.lat", 8, "lat"), r("back.lon", 8, "lon"))


def route_ellipsoid(c: Race) -> DataFrame:
    """The route of each task compiled as WGS84 next to the sphere's."""
    v = c.views
    wgs = tasks.compile_courses(v.task_rows().withColumn("earth_model", F.lit("WGS84")), v.waypoint_rows(), True)
    return wgs.select("task_id", r("total_m", 2, "wgs84_total_m"), r("speed_m", 2, "wgs84_speed_m")).join(
        c.s.course.select("task_id", r("total_m", 2, "sphere_total_m")), "task_id")


def task_centre(c: Race) -> DataFrame:
    return c.s.course.select("task_id", r("clat", 6, "lat0"), r("clon", 6, "lon0"))


def zone_radii(c: Race) -> DataFrame:
    """Radii under the three measurement policies and a relative tolerance of 0.1 %."""
    rt, at = F.lit(0.001), F.lit(5.0)
    pol = lambda p: geo.measure_radius(F.col("radius"), F.lit(p), rt, at)
    return c.wps.select("task_id", big("wp_ix"), r("inner", 3, "inner_m"), r("outer", 3, "outer_m"),
                        r(geo.inner_radius(F.col("radius"), rt, at), 3, "inner_rel"),
                        r(geo.outer_radius(F.col("radius"), rt, at), 3, "outer_rel"),
                        *[r(pol(p), 3, f"measure_{p}") for p in ("nominal", "outer", "inner")],
                        r(F.when(F.col("kind") == "TAKEOFF", F.lit(0.0)).otherwise(F.col("measure")), 3, "route_m"))


def zone_crossings(c: Race) -> DataFrame:
    return c.s.events.where("transition").select(*KEY, big("wp_ix"), big("fix_ix"), "t", "outward")


def zone_contacts(c: Race) -> DataFrame:
    return c.s.events.where(~F.col("is_sss")).groupBy(*KEY, big("wp_ix")).agg(
        F.count("*").alias("contacts"), F.count_if("segment_only").alias("chord_only"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def zone_contact_interpolated(c: Race) -> DataFrame:
    seg = c.s.track.where("px is not null").select(*KEY, "fix_ix", "t", "pt", "px", "py", "x", "y").join(
        c.s.course.select("task_id", "wps"), "task_id")
    seg = seg.select(*KEY, "fix_ix", "t", "pt", "px", "py", "x", "y", F.explode("wps").alias("z"))
    u = geo.first_contact_fraction(*[F.col(n) for n in ("px", "py", "x", "y", "z.x", "z.y", "z.outer")])
    seg = seg.withColumn("u", u).where(F.col("u") > 0)
    return seg.select(*KEY, big("fix_ix"), big("z.wp_ix", "wp_ix"), r("u", 6, "fraction"),
                      r(F.col("pt") + F.col("u") * (F.col("t") - F.col("pt")), 2, "contact_t"))


def distance_to_goal(c: Race) -> DataFrame:
    return starts.remaining_by_fix(c.s.track, c.s.scored_start, c.s.cut_evidence).select(
        *KEY, big("fix_ix"), big("wp_ix", "next_wp"), r("remaining", 2, "remaining_m"))


def waypoint_kind(c: Race) -> DataFrame:
    return tasks.waypoint_kinds(c.views.waypoint_rows()).select("task_id", big("wp_ix"), "kind").join(
        c.s.course.select("task_id", big("start_ix"), big("ess_ix")), "task_id")


def task_clock(c: Race) -> DataFrame:
    clock = lambda col: F.date_format(F.timestamp_seconds(col), "HH:mm:ss'Z'")
    rows = c.views.task_rows().select("task_id", "midnight", F.transform(
        F.reverse("gates"), lambda g: F.date_format(F.timestamp_seconds(g), "HH:mm:ss'Z'")).alias("clocks"),
        clock(F.col("deadline")).alias("deadline_clock"))
    gates = tasks.clock_gates(F.col("clocks"), F.col("midnight"))
    return rows.select("task_id", gates[0].alias("first_gate"), F.array_max(gates).alias("last_gate"),
                       F.size(gates).cast("long").alias("n_gates"),
                       tasks.clock_epoch(F.col("deadline_clock"), F.col("midnight")).alias("deadline"))


def as_of_now(c: Race) -> DataFrame:
    return c.as_of(4500).pilot_state.where(F.col("task_id").endswith("@4500")).select(*KEY, "state", "last_t", "start_t", "ess_t", r("distance_m", 2))


def drop_outlier_tracks(c: Race) -> DataFrame:
    kept, dropped = tracks.drop_outliers(c.s.track, 6.0)
    return kept.withColumn("outlier", F.lit(False)).unionByName(dropped.withColumn("outlier", F.lit(True))).select(
        *KEY, r("closest_km", 3), "outlier")


def plausibility_quarantine(c: Race) -> DataFrame:
    window = c.s.course.select("task_id", (F.col("first_gate") - 5400).alias("open_t"),
                               (F.col("first_gate") + 12000).alias("now_t"))
    rows = quality.plausibility(tracks.first_reports(c.views.raw_fixes()), window)
    return rows.select(*KEY, "t", "reason")


def merge_sessions(c: Race) -> DataFrame:
    named = c.views.raw_fixes().join(c.views.pilots().select(
        "pilot_id", F.lower(F.trim("name")).alias("pilot_key")), "pilot_id")
    return tracks.merge_sessions(named).select(
        "task_id", "pilot_key", "t", "lat", "lon", big("alt_gps"))


def route_layers(c: Race) -> DataFrame:
    return tasks.rim_points(c.s.course).groupBy("task_id", big("wp_ix")).agg(
        F.count("*").alias("points"), r(F.min("qx"), 2, "min_x"), r(F.max("qx"), 2, "max_x"),
        r(F.min("qy"), 2, "min_y"), r(F.max("qy"), 2, "max_y"))


def route_value_table(c: Race) -> DataFrame:
    return tasks.route_values(c.s.course).select("task_id", big("wp_ix"), big("q"), r("v", 2))


def route_refine(c: Race) -> DataFrame:
    return c.wps.select("task_id", big("wp_ix"), r("opt_x", 1), r("opt_y", 1))


def route_split_absorbed(c: Race) -> DataFrame:
    """Where each route point lies against its own rim after the slide: on it, or inside by overlap."""
    gap = geo.distance(F.col("opt_x"), F.col("opt_y"), F.col("x"), F.col("y")) - F.col("measure")
    return c.wps.where("kind <> 'TAKEOFF'").select("task_id", big("wp_ix"), (F.abs(gap) < 0.01).alias("on_rim"))


def route_distances(c: Race) -> DataFrame:
    return c.wps.join(c.s.course.select("task_id", "total_m", "speed_m", "launch_to_sss_m"), "task_id").select(
        "task_id", big("wp_ix"), r("leg_m", 2), r("remaining", 2, "remaining_m"), r("total_m", 2),
        r("speed_m", 2), r("launch_to_sss_m", 2))


def task_sanity(c: Race) -> DataFrame:
    return tasks.task_warnings(c.s.course).select("task_id", F.array_join("warnings", "; ").alias("warnings"))


# --- pilot state -------------------------------------------------------------------

def takeoff(c: Race) -> DataFrame:
    return c.s.evidence.select(*KEY, "takeoff_t", big("takeoff_ix"), big("fixes_used"))


def sss_crossings(c: Race) -> DataFrame:
    return c.s.events.where("is_sss").select(
        *KEY, big("fix_ix"), "t", "after_gate", "outward", "segment_only", r("d_prev", 2), r("d_fix", 2))


def next_zone_first_contact(c: Race) -> DataFrame:
    return c.s.evidence.where("next_t is not null").select(*KEY, "next_t", big("next_ix"))


def start_candidates(c: Race) -> DataFrame:
    return c.s.candidates.select(*KEY, F.explode("candidates").alias("s")).select(
        *KEY, big("s.fix_ix", "cand_ix"), F.col("s.t").alias("cand_t"))


def zone_runs(c: Race) -> DataFrame:
    return starts.event_runs(c.s.events).where("not is_sss and not late").select(
        *KEY, big("wp_ix"), big("lo"), big("hi"))


def zone_chain(c: Race) -> DataFrame:
    tag = lambda i: F.get("tags", F.lit(i)).cast("long").alias(f"tag_{i + 2}")
    return starts.zone_chain(c.s.candidates).select(*KEY, big("cand_ix"), *[tag(i) for i in range(4)])


def best_start(c: Race) -> DataFrame:
    return c.s.scored_start.select(*KEY, big("start_fix"), "start_cross_t", r("raw_m", 2),
                                   F.col("goal_t").isNotNull().alias("in_goal"))


def progress_min(c: Race) -> DataFrame:
    return c.s.scored_start.select(*KEY, r("min_remaining", 2), big("dist_ix"), r("raw_m", 2))


def exact_progress(c: Race) -> DataFrame:
    return ex.exact_progress(c.s.distances).where("exact_remaining is not null").select(
        *KEY, r("exact_remaining", 2), big("exact_ix"))


def landing(c: Race) -> DataFrame:
    return c.s.landings.select(*KEY, "landing_t", big("landing_ix"))


def landing_rescore(c: Race) -> DataFrame:
    """Pilots with a landing: what the whole track gave and what the track up to the landing gives."""
    landed = c.s.landings.select(*KEY)
    whole = c.s._play(c.s._chains(c.s.evidence.join(landed, KEY, "left_semi").withColumn(
        "cut_ix", F.lit(None).cast("int")))).select(
        *KEY, r("raw_m", 2, "raw_whole_m"), F.col("goal_t").alias("goal_whole_t"))
    cut = c.s.scored_start.select(*KEY, r("raw_m", 2, "raw_cut_m"), F.col("goal_t").alias("goal_cut_t"))
    return landed.join(whole, KEY, "left").join(cut, KEY, "left")


def pilot_state(c: Race) -> DataFrame:
    return c.s.pilot_state.select(
        *KEY, "state", "takeoff_t", "start_t", "ess_t", "goal_t", "last_t", r("distance_m", 2),
        r("raw_distance_m", 2), r("section_s", 1), r("speed_kmh", 3), "early_start",
        big("next_wp"), big("tp_count"))


def lead_samples(c: Race) -> DataFrame:
    return c.s.lead_samples.select(*KEY, big("fix_ix"), big("task_time"), r("d_km", 5))


def leading_area(c: Race) -> DataFrame:
    return ex.exact_progress(c.s.distances).select(
        *KEY, r("lead_area", 4), r("lead_min_km", 5)).where("lead_area is not null")


def leading_area_hump(c: Race) -> DataFrame:
    args = [F.col(n) for n in ("task_time", "d_km", "prev_km", "section_km")]
    return c.s.lead_samples.groupBy(*KEY).agg(r(F.sum(leading.hump_term(*args)), 4, "hump_area"))


def gate_as_of(c: Race) -> DataFrame:
    """The start clock of every crossing after the gate."""
    rows = c.s.events.where("is_sss and after_gate").join(c.s.course.select("task_id", "start_type", "gates"), "task_id")
    return rows.select(*KEY, F.col("t").alias("cross_t"), starts.gate_as_of(
        F.col("start_type"), F.col("gates"), F.col("t")).alias("start_t"))


def is_early_start(c: Race) -> DataFrame:
    crossings = F.col("crossings")
    rows = c.s.evidence.select(*KEY, "crossings", F.col("c.first_gate").alias("gate"), F.col("c.launch_to_sss_m").alias("l"))
    last_t = F.array_max(F.transform(crossings, lambda x: x["t"]))
    early = F.coalesce(last_t < F.col("gate"), F.lit(False))
    return rows.select(*KEY, last_t.alias("last_crossing_t"), early.alias("early"),
                       r(F.when(early, F.col("l")), 2, "early_distance_m"))


def track_integrity(c: Race) -> DataFrame:
    gaps = F.array_join(F.transform("gaps_over_5s", lambda g: F.concat_ws(
        ":", g["at"].cast("string"), g["gap"].cast("string"))), ",")
    return tracks.track_integrity(c.s.track).select(
        *KEY, "fixes", "first_t", "last_t", "span_s", r("nominal_rate_hz", 6), big("biggest_gap_s"),
        "biggest_gap_at", big("seconds_missing"), "n_gaps_over_5s", gaps.alias("gaps"),
        *[big(x) for x in ("alt_gps_min", "alt_gps_max", "alt_baro_min", "alt_baro_max")])


QUERIES = {f.__name__: f for f in (
    haversine_legs, project_fixes, unproject, geodesic_pairs, task_centre, zone_radii, zone_crossings,
    zone_contacts, zone_contact_interpolated, distance_to_goal, waypoint_kind, task_clock, as_of_now,
    drop_outlier_tracks, plausibility_quarantine, merge_sessions, route_layers, route_value_table,
    route_refine, route_split_absorbed, route_distances, route_ellipsoid, task_sanity, takeoff, sss_crossings,
    next_zone_first_contact, start_candidates, zone_runs, zone_chain, best_start, progress_min,
    exact_progress, landing, landing_rescore, pilot_state, lead_samples, leading_area, leading_area_hump, gate_as_of,
    is_early_start, track_integrity)} | {"geodesic_direct": geodesic_points, "ellipsoid_xy": ellipsoid_plane}
