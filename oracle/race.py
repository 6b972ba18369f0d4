"""Oracle SQL for the geometry, route, track and pilot-state queries."""

from .ctes import R, at_moment, hav

PT = "task_id, pilot_id"
REL_IN, REL_OUT = "least(radius * 0.999e0, radius - 5)", "greatest(radius * 1.001e0, radius + 5)"


def unplane(x="x", y="y"):
    rho = f"sqrt({x} * {x} + {y} * {y})"
    arc = f"({rho} / {R})"
    lat = f"degrees(asin(cos({arc}) * sin(radians(clat)) + {y} * sin({arc}) * cos(radians(clat)) / {rho}))"
    lon = (f"clon + degrees(atan2({x} * sin({arc}), {rho} * cos(radians(clat)) * cos({arc}) - "
           f"{y} * sin(radians(clat)) * sin({arc})))")
    return lat, lon


ULAT, ULON = unplane()

MOMENTS = {m: at_moment("pstate", m) for m in (1800, 4500, 7200)}

SQL = {
    "as_of_now": f"select concat(task_id, '@4500') task_id, pilot_id, state, last_t, start_t, ess_t, round(distance_m, 2) distance_m from {MOMENTS[4500]}",
    "haversine_legs": f"""select task_id, wp_ix, round(leg, 3) leg_m,
        round(sum(leg) filter (wp_ix >= start_ix) over (partition by task_id), 3) centre_m from (
        select z.task_id, wp_ix, start_ix, {hav('lat', 'lon', 'lat2', 'lon2')} as leg from (
        select *, lead(lat) over w lat2, lead(lon) over w lon2 from wps window w as (partition by task_id order by wp_ix)) z
        join tasks using (task_id))""",
    "project_fixes": f"select {PT}, t, round(x, 2) x, round(y, 2) y from track",
    "unproject": f"select {PT}, t, cast(floor(({ULAT}) * 1e6 + 0.2718281e0) as bigint) lat_udeg, cast(floor(({ULON}) * 1e6 + 0.2718281e0) as bigint) lon_udeg from (select {PT}, t, x, y, clat, clon from track join centres using (task_id))",
    "task_centre": "select task_id, round(clat, 6) lat0, round(clon, 6) lon0 from centres",
    "zone_radii": f"""select task_id, wp_ix, round(inner_r, 3) inner_m, round(outer_r, 3) outer_m, round({REL_IN}, 3) inner_rel,
        round({REL_OUT}, 3) outer_rel, round(radius, 3) measure_nominal, round({REL_OUT}, 3) measure_outer,
        round({REL_IN}, 3) measure_inner, round(rr, 3) route_m from wps""",
    "zone_crossings": f"select {PT}, wp_ix, fix_ix, t, outward from events_z where transition",
    "zone_contacts": f"""select {PT}, wp_ix, count(*) contacts, count(*) filter (segment_only) chord_only, min(t) first_t,
        max(t) last_t from events_z where not is_sss group by 1, 2, 3""",
    "zone_contact_interpolated": f"""select {PT}, fix_ix, wp_ix, round(u, 6) fraction, round(pt + u * (t - pt), 2) contact_t from (
        select *, (-hb - sqrt(hb * hb - a * c)) / a as u from (
        select f.task_id, f.pilot_id, fix_ix, wp_ix, f.t, f.pt, pow(f.x - f.px, 2) + pow(f.y - f.py, 2) a,
        (f.px - z.x) * (f.x - f.px) + (f.py - z.y) * (f.y - f.py) hb, pow(f.px - z.x, 2) + pow(f.py - z.y, 2) - outer_r * outer_r c
        from track f join wps z using (task_id) where px is not null) where c > 0 and a > 1e-18 and hb * hb - a * c >= 0)
        where u > 0 and u <= 1""",
    "distance_to_goal": f"""select p.task_id, p.pilot_id, p.fix_ix, 2 + (p.fix_ix >= coalesce(p.g2, 2147483647))::int + (p.fix_ix >= coalesce(p.g3, 2147483647))::int
        + (p.fix_ix >= coalesce(p.g4, 2147483647))::int + (p.fix_ix >= coalesce(p.g5, 2147483647))::int as next_wp, round(p.rem, 2) remaining_m
        from pb_played p join pb_best b using (task_id, pilot_id, cand_ix) where p.fix_ix > cand_ix""",
    "waypoint_kind": "select k.task_id, wp_ix, kind, start_ix, ess_ix from wp_kinds k join tasks using (task_id)",
    "task_clock": """select task_id, gate as first_gate, coalesce(gate2, gate) as last_gate,
        case when gate2 is null then 1 else 2 end as n_gates, deadline from task_rows""",
    "drop_outlier_tracks": f"""select {PT}, round(d, 3) closest_km, d > 6 as outlier from (
        select {PT}, min(sqrt(x * x + y * y)) / 1000 d from track group by 1, 2)""",
    "plausibility_quarantine": f"""select {PT}, t, case when static is not null then static
        when t - prev_t <= 60 and t > mt and {hav('mlat', 'mlon', 'lat', 'lon')} / (t - mt) * 3.6e0 > 120 then 'speed'
        when t - prev_t <= 60 and t > mt and abs(alt_gps - malt) / (t - mt) > 20 then 'climb' end as reason from (
        select *, lag(t) over w prev_t, median(case when static is null then t end) over rr mt, median(case when static is null then lat end) over rr mlat,
        median(case when static is null then lon end) over rr mlon, median(case when static is null then alt_gps end) over rr malt from (
        select f.*, case when lat not between -90 and 90 or lon not between -180 and 180 then 'range'
        when alt_gps not between -500 and 12000 then 'altitude' when t < gate - 9000 or t > gate + 12060 then 'time' end static
        from fixes f join task_rows using (task_id))
        window w as (partition by {PT} order by t), rr as (partition by {PT} order by t rows between 5 preceding and 1 preceding))""",
    "merge_sessions": """select r.task_id, lower(trim(name)) pilot_key, t, arg_min(lat, ord) lat, arg_min(lon, ord) lon,
        arg_min(alt_gps, ord)::bigint alt_gps from raw_fixes r join pilots p on p.pilot_id = r.pilot_id group by 1, 2, 3""",
    "route_layers": """select task_id, wp_ix, count(*) points, round(min(qx), 2) min_x, round(max(qx), 2) max_x,
        round(min(qy), 2) min_y, round(max(qy), 2) max_y from rim0 group by 1, 2""",
    "route_value_table": "select task_id, wp_ix, q, round(v, 2) v from dpa_v",
    "route_refine": "select task_id, wp_ix, round(opt_x, 1) opt_x, round(opt_y, 1) opt_y from opt",
    "route_split_absorbed": """select task_id, wp_ix, abs(sqrt(pow(opt_x - x, 2) + pow(opt_y - y, 2)) - measure) < 0.01 on_rim
        from zones where kind <> 'TAKEOFF'""",
    "route_distances": """select z.task_id, wp_ix, round(leg_m, 2) leg_m, round(remaining, 2) remaining_m, round(total_m, 2) total_m,
        round(speed_m, 2) speed_m, round(launch_to_sss_m, 2) launch_to_sss_m from zones z join tasks using (task_id)""",
    "task_sanity": """select s.task_id, concat_ws('; ', case when first_gate >= deadline then 'gate at or after deadline' end,
        case when sqrt(pow(n.x - s.x, 2) + pow(n.y - s.y, 2)) + n.radius <= s.radius then concat('zone ', n.name, ' lies inside ', s.name) end) warnings
        from tasks k join wps s on s.task_id = k.task_id and s.wp_ix = start_ix join wps n on n.task_id = k.task_id and n.wp_ix = start_ix + 1""",
    "takeoff": f"select {PT}, takeoff_t, takeoff_ix, fixes_used from facts",
    "sss_crossings": f"""select {PT}, fix_ix, t, after_gate, outward, segment_only, round(d_prev, 2) d_prev, round(d_fix, 2) d_fix
        from events_z where is_sss""",
    "next_zone_first_contact": f"select {PT}, min(t) next_t, min(fix_ix) next_ix from events_z where is_next group by 1, 2",
    "start_candidates": f"select {PT}, cand_ix, cand_t from pb_cand",
    "zone_runs": f"""select {PT}, wp_ix, min(fix_ix) lo, max(fix_ix) hi from (select *, fix_ix - row_number() over
        (partition by {PT}, wp_ix order by fix_ix) g from events_z where not is_sss and not late) group by {PT}, wp_ix, g""",
    "zone_chain": f"select {PT}, cand_ix, g2 tag_2, g3 tag_3, g4 tag_4, g5 tag_5 from pb_chain",
    "best_start": f"select {PT}, cand_ix start_fix, cand_t start_cross_t, round(raw_m, 2) raw_m, goal_t is not null in_goal from pb_best",
    "progress_min": f"select {PT}, round(least_rem, 2) min_remaining, dist_ix, round(raw_m, 2) raw_m from pb_best",
    "exact_progress": f"select {PT}, round(exact_remaining, 2) exact_remaining, exact_ix from exact_best",
    "landing": f"select {PT}, landing_t, landing_ix from landings",
    "landing_rescore": """select l.task_id, l.pilot_id, round(a.raw_m, 2) raw_whole_m, a.goal_t goal_whole_t, round(b.raw_m, 2) raw_cut_m,
        b.goal_t goal_cut_t from landings l left join pa_best a using (task_id, pilot_id) left join pb_best b using (task_id, pilot_id)""",
    "pilot_state": f"""select {PT}, state, takeoff_t, start_t, ess_t, goal_t, last_t, round(distance_m, 2) distance_m, round(raw_distance_m, 2) raw_distance_m,
        round(section_s, 1) section_s, round(speed_kmh, 3) speed_kmh, early_start,
        case when cand_ix is null then 0 else 2 + (g2 is not null)::int + (g3 is not null)::int + (g4 is not null)::int + (g5 is not null)::int end::bigint next_wp,
        least((g2 is not null)::int + (g3 is not null)::int + (g4 is not null)::int + (g5 is not null)::int, 3)::bigint tp_count from pstate""",
    "lead_samples": f"select {PT}, fix_ix, task_time, round(d_km, 5) d_km from lead_rows",
    "leading_area": f"select {PT}, round(lead_area, 4) lead_area, round(lead_min_km, 5) lead_min_km from leads",
    "leading_area_hump": f"""select {PT}, round(sum(task_time * (prev_km - d_km) * pow(1 - pow(10e0, 9 * (prev_km + d_km) / (2 * section_km) - 9), 5)
        * pow(1 - pow(10e0, -3 * (prev_km + d_km) / (2 * section_km)), 2)), 4) hump_area from lead_rows group by 1, 2""",
    "gate_as_of": f"""select {PT}, t cross_t, case when start_type <> 'RACE' then t when gate2 <= t then gate2 else gate end start_t
        from events_z join task_rows using (task_id) where is_sss and after_gate""",
    "is_early_start": f"""select f.task_id, f.pilot_id, last_t2 last_crossing_t, coalesce(last_t2 < gate, false) early,
        case when last_t2 < gate then round(launch_to_sss_m, 2) end early_distance_m from facts f join tasks using (task_id)
        left join (select {PT}, max(t) last_t2 from events_z where is_sss group by 1, 2) using (task_id, pilot_id)""",
    "track_integrity": f"""select {PT}, count(*) fixes, min(t) first_t, max(t) last_t, max(t) - min(t) span_s,
        round((count(*) - 1) / (max(t) - min(t)), 6) nominal_rate_hz, max(g) filter (g > 1) biggest_gap_s, arg_max(t - g, (g, g - t)) filter (g > 1) biggest_gap_at,
        sum(g - 1) filter (g > 1)::bigint seconds_missing, count(*) filter (g > 5) n_gaps_over_5s,
        string_agg(concat(t - g, ':', g), ',' order by t) filter (g > 5) gaps, min(alt_gps)::bigint alt_gps_min, max(alt_gps)::bigint alt_gps_max,
        min(alt_baro)::bigint alt_baro_min, max(alt_baro)::bigint alt_baro_max from (
        select *, count(*) filter (g > 5) over (partition by {PT} order by t) n from (select *, t - pt as g from track)) group by 1, 2""",
}
SQL["project_fixes"] = " ".join(SQL["project_fixes"].split())
