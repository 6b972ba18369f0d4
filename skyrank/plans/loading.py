"""Source queries: text, JSON and HTML forms of the same races, parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracks import KEY, first_reports
from ..sources import igc, pages, params, penalties_json, tasks_json
from .race import Race, big, r

SHIFT_S = 36000   # move the flights ten hours on, so that many files cross midnight


def igc_lines(c: Race) -> DataFrame:
    """Logger files line by line: headers, then one B record per fix, some of them unusable."""
    f = first_reports(c.views.raw_fixes()).join(c.views.task_rows().select("task_id", "midnight"), "task_id")
    path = F.concat(F.lit("tracks/"), "pilot_id", F.lit(".igc"))
    pad = lambda e, n: F.lpad(e.cast("long").cast("string"), n, "0")
    s = (F.col("t") - F.col("midnight") + SHIFT_S) % 86400
    deg = lambda x: F.floor(x)
    mins = lambda x: F.floor((x - F.floor(x)) * 60000)
    lat, lon = F.col("lat"), F.col("lon")
    degrees = F.when(F.col("t") % 53 == 0, F.lit("XX")).otherwise(pad(deg(lat), 2))
    line = F.concat(F.lit("B"), pad(F.floor(s / 3600), 2), pad(F.floor(s % 3600 / 60), 2), pad(s % 60, 2), degrees, pad(mins(lat), 5), F.lit("N"),
                    pad(deg(lon), 3), pad(mins(lon), 5), F.lit("E"), F.when(F.col("t") % 50 == 0, "V").otherwise("A"),
                    pad(F.col("alt_baro"), 5), pad(F.col("alt_gps"), 5))
    body = f.select(path.alias("path"), F.col("t").alias("line_no"), F.when(F.col("t") % 59 == 0, F.substring(line, 1, 30)).otherwise(line).alias("line"))
    p = c.views.pilots().join(c.views.task_rows().select("task_id", "midnight"), "task_id")
    n = F.col("pilot_id").cast("long")
    head = p.select(F.concat(F.lit("tracks/"), "pilot_id", F.lit(".igc")).alias("path"), F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("line_no"), F.concat(F.lit("HFDTEDATE:"), F.date_format(F.timestamp_seconds(
            F.col("midnight") - F.when(n % 17 == 3, 86400).otherwise(0)), "ddMMyy")).alias("line")),
        F.struct(F.lit(2).cast("long").alias("line_no"), F.when(n % 4 == 1, F.lit("HFPLTPILOT:")).otherwise(
            F.concat(F.lit("HFPLTPILOTINCHARGE: "), F.col("name"))).alias("line")))).alias("h")).select("path", "h.line_no", "h.line")
    return head.unionByName(body)


def igc_ingest(c: Race) -> DataFrame:
    return igc.parse_lines(igc_lines(c)).select("path", "pilot", "t", r("lat", 6), r("lon", 6), big("alt_baro"), big("alt_gps"))


def igc_midnight_rollover(c: Race) -> DataFrame:
    return igc.parse_lines(igc_lines(c)).groupBy("path").agg(
        F.count("*").alias("fixes"), F.count_if("rolled").alias("after_midnight"), F.max("t").alias("last_t"))


def igc_header_scan(c: Race) -> DataFrame:
    return igc.scan_headers(igc_lines(c)).select("path", "day", "pilot", "pilot_key")


def track_date_check(c: Race) -> DataFrame:
    days = c.views.pilots().join(c.views.task_rows().select("task_id", "midnight"), "task_id").select(
        F.col("source_file").alias("path"), "midnight")
    return igc.track_date_check(igc.scan_headers(igc_lines(c)), days).select("path", "day", "midnight")


def _task_docs(c: Race) -> DataFrame:
    """Task documents, camelCase for even tasks and snake_case for odd ones."""
    w = c.views.waypoint_rows().groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        "wp_ix", "declared", "radius", "name", "lat", "lon", "alt"))).alias("w"))
    t = c.views.task_rows().join(w, "task_id")
    n, clock = F.col("task_no"), lambda e: F.date_format(F.timestamp_seconds(e), "HH:mm:ss'Z'")
    even = lambda v: F.when(n % 2 == 0, v)
    odd = lambda v: F.when(n % 2 == 1, v)
    doc = F.struct(
        F.lit(1).alias("version"), even(F.lit("wgs84")).alias("earthModel"), even(F.lit(0.1)).alias("radiusTolerance"),
        odd(F.lit(0.005)).alias("radius_tolerance"), odd(F.lit(6.0)).alias("absolute_tolerance"),
        even(F.lit("Nominal")).alias("measurementRadius"), odd(F.col("progress_curve")).alias("progress_curve"),
        F.transform("w", lambda p: F.struct(p["declared"].alias("type"), p["radius"].alias("radius"), F.struct(
            p["name"].alias("name"), p["lat"].alias("lat"), p["lon"].alias("lon"), p["alt"].alias("altSmoothed")).alias("waypoint"))).alias("turnpoints"),
        F.struct(F.col("start_type").alias("type"), F.transform(F.reverse("gates"), lambda g: clock(g)).alias("timeGates")).alias("sss"),
        F.struct(clock(F.col("deadline")).alias("deadline"), "goal_elevated", F.col("goal_elevated").alias("elevated"),
                 F.when(n % 3 == 0, F.lit(2500.0)).alias("elevation")).alias("goal"))
    return t.select("task_id", F.col("midnight").alias("date_epoch"), F.to_json(doc).alias("body"))


def task_load(c: Race) -> DataFrame:
    tasks, wps = tasks_json.parse_tasks(_task_docs(c))
    return wps.join(tasks, "task_id").select(
        "task_id", big("wp_ix"), "name", "declared", r("radius", 1), r("alt", 1), F.col("gates")[0].alias("first_gate"),
        F.size("gates").cast("long").alias("n_gates"), "deadline", "earth_model", r("radius_tolerance", 6), r("absolute_tolerance", 1),
        "measure_policy", "progress_curve", "start_type", "goal_elevated", r("goal_elevation", 1))


def _param_docs(c: Race) -> DataFrame:
    """Competition documents, one per task, with one kind of mistake in some."""
    n = F.col("task_no")
    doc = F.struct(
        F.concat(F.lit("Cup "), n.cast("string")).alias("name"), F.when(n % 7 == 1, "hang-gliding").when(n % 7 == 5, "ballooning").alias("discipline"),
        F.when(n % 2 == 0, F.lit(12)).alias("pilots_present"), F.when(n % 3 != 0, F.lit(50.0)).alias("nominal_distance_km"),
        F.when(n % 10 == 4, F.lit(70.0)).alias("minimum_distance_km"), F.when(n % 5 == 2, F.lit(0.2632)).when(n % 5 == 3, F.lit(0.4)).alias("leading_time_ratio"),
        F.when(n % 9 == 8, F.lit("radar")).alias("altitude_source"), F.when(n % 10 == 6, F.lit(1)).alias("nominal_distanse"), F.lit("note").alias("_comment"))
    return c.views.task_rows().select(F.col("task_id").alias("doc_id"), F.to_json(doc).alias("body"))


def params_load(c: Race) -> DataFrame:
    return params.parse_params(_param_docs(c)).select(
        "doc_id", "error", r("nominal_distance", 1), r("minimum_distance", 1), r("nominal_time", 1), r("leading_time_ratio", 4),
        r("ess_no_goal_time_factor", 2), r("score_back_s", 1), F.size("warnings").cast("long").alias("n_warnings"))


def placeholder_report(c: Race) -> DataFrame:
    rows = params.parse_params(_param_docs(c))
    return rows.select("doc_id", F.array_join("placeholders", ",").alias("placeholders"),
                       F.col("pilots_present").isNull().alias("launch_validity_not_measured"))


def penalties_load(c: Race) -> DataFrame:
    n = F.col("ord")
    entry = F.to_json(F.struct(F.when(n % 7 != 3, F.col("pilot_key")).alias("pilot"), F.when(n % 5 != 4, F.col("reason")).alias("reason"),
                               "percent_own", F.when(n % 11 == 5, F.lit(1)).alias("percentage"), F.when(F.col("points") > 0, F.col("points")).alias("points")))
    docs = c.views.penalties().select(F.concat(F.lit('{"'), "task_id", F.lit('":['), entry, F.lit("]}")).alias("body"))
    good, bad = penalties_json.parse_penalties(docs)
    return good.select("task_id", "pilot_key", "reason", r("percent_own", 1), r("points", 1), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("task_id", F.lit(None).cast("string").alias("pilot_key"), F.lit(None).cast("string").alias("reason"),
                   F.lit(None).cast("double").alias("percent_own"), F.lit(None).cast("double").alias("points"), "error"))


def _pages(c: Race) -> DataFrame:
    """The crawled pages and, per supplier, a small result page."""
    n = F.col("s_suppkey")
    txt = lambda e: e.cast("string")
    td = lambda *cs: F.concat(*[p for x in cs for p in (F.lit("<td>"), x if not isinstance(x, str) else F.lit(x), F.lit("</td>"))])
    board = F.concat(F.lit('<tr class="result">'), td(
        txt(n % 90 + 1), F.concat(F.lit(" p"), txt(n)), F.concat(F.lit("<b>"), "s_name", F.lit("</b> &amp; Co")), "-", "-", "-", "-", "-",
        F.concat(txt(n % 60), F.lit(",5")), "13:30:00", "15:18:06", "01:48:06", F.concat(txt(n % 40), F.lit(".25")),
        "ok", F.when(n % 3 == 0, F.lit("-")).otherwise(F.lit("150")), "361.7", "168.0", "(-)",
        F.when(n % 5 == 0, F.lit("n/a")).otherwise(F.concat(txt(n % 900), F.lit(",1")))), F.lit("</tr>"))
    prm = F.concat(F.lit("<tr>"), td("Nominal distance", F.concat(txt(n % 30 + 40), F.lit(",5"))), F.lit("</tr><TR>"),
                   td("Leading-time ratio", F.when(n % 2 == 0, F.lit("26.0")).otherwise(F.lit("0.26"))), F.lit("</TR><tr>"), td("Ignored", "x"), F.lit("</tr>"))
    wp = lambda kind, name: F.concat(F.lit('<tr class="result">'), td(kind, "1", name, "0.4", F.concat(txt(n % 40 + 10), F.lit(".5")), "1.25"), F.lit("</tr>"))
    html = F.concat(F.lit("<html><body>2025-06-01 to 2025-06-30"), F.when(n % 4 != 0, F.concat(
        F.lit("<h3> 2025-06-1"), txt(n % 9), F.lit(" </h3>"))).otherwise(F.lit("")), F.lit("<p>StartGate 1: <b>13:"), F.lpad(txt(n % 60), 2, "0"),
        F.lit("</b></p><p>Task deadline: 18:00</p><table>"), board, prm, F.when(n % 6 != 5, F.concat(wp("TOFF", "A01"), wp("GOAL", "G01"))).otherwise(wp("SSS", "S")),
        F.lit("</table></body></html>"))
    own = c.views.table("supplier").select((F.lit(1000000000) + n).alias("page_id"), html.alias("html"))
    return c.views.table("pages").select("page_id", "html").unionByName(own)


def official_html(c: Race) -> DataFrame:
    return pages.leaderboard(_pages(c)).select("page_id", "rank", "pilot_id", "name", r("score", 1), r("distance_km", 1), "sss",
                                               r("speed_kmh", 2), r("height_m", 1), r("distance_points", 1), r("time_points", 1))


def page_params(c: Race) -> DataFrame:
    return pages.parameters(_pages(c)).select("page_id", "key", r("value", 4))


def page_task_config(c: Race) -> DataFrame:
    tasks, points = pages.task_config(_pages(c), "Europe/Madrid")
    return points.join(tasks, "page_id").select("page_id", "kind", "name", r("radius_m", 1), r("lat", 2), r("lon", 2), "task_date", "gate", "gate_utc", "deadline_utc", "gate_given", "deadline_given")


QUERIES = {f.__name__: f for f in (igc_ingest, igc_midnight_rollover, igc_header_scan, track_date_check, task_load, params_load,
                                   placeholder_report, penalties_load, official_html, page_params, page_task_config)}
