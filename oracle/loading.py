"""Oracle SQL for the sources: the values the texts were written from."""

from .ctes import cte

cte("igc_fix", """select 'tracks/' || pilot_id || '.igc' as path, pilot_id, task_id, t, midnight, cast(pilot_id as bigint) n,
    floor(lat) + floor((lat - floor(lat)) * 60000) / 60000e0 lat, floor(lon) + floor((lon - floor(lon)) * 60000) / 60000e0 lon, alt_baro, alt_gps
    from fixes join task_rows using (task_id) where t % 50 <> 0 and t % 53 <> 0 and t % 59 <> 0""")
cte("igc_head", """select source_file as path, midnight - case when cast(pilot_id as bigint) % 17 = 3 then 86400 else 0 end as day, midnight,
    case when cast(pilot_id as bigint) % 4 = 1 then pilot_id else name end as pilot from pilots join task_rows using (task_id)""")
cte("igc_rows", "select f.*, h.pilot, t + 36000 - case when n % 17 = 3 then 86400 else 0 end as t2 from igc_fix f join (select path, pilot from igc_head) h using (path)")
cte("param_docs", """select *, case when task_no % 10 = 6 then 'unknown key(s) nominal_distanse' when task_no % 7 = 5 then 'unknown discipline ballooning'
    when task_no % 9 = 8 then 'altitude_source must be gps or baro' when ltr < 0 or ltr > 0.3 then 'leading_time_ratio out of range'
    when nd <= md then 'nominal distance must exceed minimum' end as error from (
    select task_id doc_id, task_no, case when task_no % 3 <> 0 then 50000e0 else 60000e0 end nd, case when task_no % 10 = 4 then 70000e0 else 5000e0 end md,
    case when task_no % 5 = 2 then 0.2632e0 when task_no % 5 = 3 then 0.4e0 when task_no % 7 = 1 then 0.175e0 when task_no % 7 = 5 then null else 0.26e0 end ltr,
    case when task_no % 7 = 1 then 0.8e0 when task_no % 7 = 5 then null else 0e0 end esf, case when task_no % 7 = 1 then 900e0 when task_no % 7 = 5 then null else 300e0 end sb from task_rows)""")
cte("supp_pages", "select 1000000000 + s_suppkey as page_id, s_suppkey as n, s_name from supplier")

SQL = {
    "igc_ingest": "select path, pilot, t2 as t, round(lat, 6) lat, round(lon, 6) lon, alt_baro, alt_gps from igc_rows",
    "igc_midnight_rollover": "select path, count(*) fixes, count(*) filter (t + 36000 - midnight >= 86400) after_midnight, max(t2) last_t from igc_rows group by 1",
    "igc_header_scan": "select path, day, pilot, lower(trim(pilot)) pilot_key from igc_head",
    "track_date_check": "select path, day, midnight from igc_head where day <> midnight",
    "task_load": """select w.task_id, wp_ix, name, declared, round(radius, 1) radius, round(alt, 1) alt, gate first_gate, case when gate2 is null then 1 else 2 end n_gates, deadline,
        case when task_no % 2 = 0 then 'WGS84' else 'FAI_SPHERE' end earth_model, case when task_no % 2 = 0 then 0.001e0 else 0.005e0 end radius_tolerance,
        case when task_no % 2 = 0 then 5e0 else 6e0 end absolute_tolerance, case when task_no % 2 = 0 then 'nominal' else 'outer' end measure_policy,
        case when task_no % 2 = 0 then 'WEIGHTED' else progress_curve end progress_curve, start_type, goal_elevated,
        case when task_no % 3 = 0 then 1000e0 else 300e0 end goal_elevation from waypoint_rows w join task_rows using (task_id)""",
    "params_load": """select doc_id, error, nd nominal_distance, md minimum_distance, 5400e0 nominal_time, round(ltr, 4) leading_time_ratio, esf ess_no_goal_time_factor,
        sb score_back_s, case when task_no % 2 = 1 then 1 else 0 end + case when ltr > 0.26 then 1 else 0 end n_warnings from param_docs""",
    "placeholder_report": """select doc_id, concat_ws(',', case when task_no % 10 <> 4 then 'minimum_distance_km' end, case when task_no % 3 = 0 then 'nominal_distance_km' end,
        'nominal_time_min') placeholders, task_no % 2 = 1 launch_validity_not_measured from param_docs""",
    "penalties_load": """select task_id, case when error is null then pilot_key end pilot_key, case when error is null then reason end reason,
        case when error is null then percent_own end percent_own, case when error is null then points end points, error from (
        select *, case when ord % 11 = 5 then 'unknown keys percentage' when ord % 7 = 3 then 'no pilot' when ord % 5 = 4 then 'no reason' end error from penalty_rows)""",
    "official_html": """select page_id, n % 90 + 1 rank, 'p' || n pilot_id, s_name || ' & Co' as name, case when n % 5 = 0 then 168e0 else n % 900 + 0.1e0 end score,
        n % 60 + 0.5e0 distance_km, '13:30:00' sss, round(n % 40 + 0.25e0, 2) speed_kmh, case when n % 3 = 0 then null else 150e0 end height_m, 361.7e0 distance_points,
        cast(null as double) time_points from supp_pages""",
    "page_params": """select page_id, 'nominal_distance_km' as key, n % 30 + 40.5e0 as value from supp_pages union all select page_id, 'leading_time_ratio', 0.26e0 from supp_pages""",
    "page_task_config": """select page_id, k as kind, nm as name, 400e0 radius_m, n % 40 + 10.5e0 lat, 1.25e0 lon, d task_date, '13:' || lpad(cast(n % 60 as varchar), 2, '0') gate,
        '11:' || lpad(cast(n % 60 as varchar), 2, '0') gate_utc, '16:00' deadline_utc, true gate_given, true deadline_given from (select *, case when n % 4 <> 0 then '2025-06-1' || (n % 9) else '2025-06-30' end d
        from supp_pages where n % 6 <> 5), (values ('TAKEOFF', 'A01'), ('GOAL', 'G01')) v(k, nm)""",
}
