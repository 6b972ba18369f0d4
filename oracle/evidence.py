"""Oracle SQL for comparison and audit queries."""

from .ctes import cte, hav
from .race import MOMENTS

PT = "task_id, pilot_id"
cte("off_rows", """select task_id, rank, pilot_id pid, 'P. ' || cast(pilot_id as bigint) as name, start_t + 7200 - midnight start_s,
    case when goal_t is not null then ess_t + 7200 - midnight end finish_s, case when goal_t is not null then cast(section_s as bigint) end time_s,
    round(goal_alt, 1)::double height_m, case when goal_t is not null then round(speed_kmh, 1) end speed_kmh, round(distance_m / 1000, 1) distance_km,
    distance_points dist_p, leading_points lead_p, case when goal_t is not null then round(time_points + 1.5e0, 1) end spd_p,
    case when goal_t is not null then -1.5e0 end low_p, round(total_points + case when cast(pilot_id as bigint) % 10 = 6 then 0.3e0 else 0e0 end, 1) score
    from board join task_rows using (task_id) where cast(pilot_id as bigint) % 25 <> 9
    union all select task_id, 999, 'X' || task_id, 'A. Stranger', null, null, null, null, null, null, null, null, null, null, 0e0 from task_rows""")
cte("b2", "select b.*, pilot_id as pid, midnight from board b join task_rows using (task_id)")
cte("both_rows", """select b.task_id, b.pid, b.rank, o.rank orank, b.total_points, o.score, b.distance_m, o.distance_km, b.ess_t, b.midnight, o.finish_s, b.section_s, o.time_s,
    b.speed_kmh, o.speed_kmh ospeed, b.distance_points, o.dist_p, b.time_points, o.spd_p, o.low_p, b.leading_points, o.lead_p, b.lc, b.state, o.name
    from b2 b join off_rows o using (task_id, pid)""")
cte("deltas", " union all ".join(f"select task_id, pid, '{n}' as metric, {tol} as tol, cast({e} as double) as delta from both_rows" for n, tol, e in (
    ("scored distance", "0.05e0", "distance_m / 1000 - distance_km"), ("finish time", "1e0", "(ess_t - midnight) - (finish_s - 7200)"),
    ("section time", "1e0", "section_s - time_s"), ("average speed", "0.05e0", "speed_kmh - ospeed"), ("distance points", "0.1e0", "distance_points - dist_p"),
    ("time points", "0.1e0", "time_points - (spd_p + coalesce(low_p, 0e0))"), ("leading points", "0.1e0", "leading_points - lead_p"),
    ("total", "0.1e0", "total_points - score"))))
TIMED = "(goal_t is not null and best_time > 0 and section_s <> 0)"
LED = "(lc > 0 and lc_min > 0)"
SF = "case when section_s <= best_time then 1e0 else greatest(0e0, 1 - pow((section_s - best_time) / 3600 / sqrt(best_time / 3600), 5e0 / 6)) end"
LF = "greatest(0e0, 1 - cbrt(pow(lc - lc_min, 2) / lc_min))"
LINES = [("distance", "12.1", "printf('min(%.1f / %.1f, 1) x %.1f', distance_m, best_distance, available_distance)", "distance_points", "true"),
         ("speed fraction", "12.2", "printf('T %.6f best %.6f', section_s / 3600, best_time / 3600)", f"round({SF}, 6)", TIMED),
         ("time", "12.2", f"printf('%.6f x %.1f x %.4f', {SF}, available_time, goal_altitude_factor)", "time_points", TIMED),
         ("time", "13.2", "printf('factor %.2f', case when goal_t is not null then 1e0 else ess_no_goal_time_factor end)", "time_points", f"not coalesce({TIMED}, false) and ess_t is not null"),
         ("time", "12.2", "'goal not reached'", "0e0", f"not coalesce({TIMED}, false) and ess_t is null"),
         ("leading factor", "12.3", "printf('LC %.6f LCmin %.6f', lc, lc_min)", f"round({LF}, 6)", LED),
         ("leading", "12.3.1", f"printf('%.6f x %.1f', {LF}, available_leading)", "leading_points", LED),
         ("leading", "12.3", "'no valid start'", "0e0", f"not {LED}"), ("arrival", "12.4", "'0'", "0e0", "true"),
         ("total", "12", "printf('%.1f + %.1f + %.1f', distance_points, time_points, leading_points)", "total_points", "true")]
cte("deriv", " union all ".join(f"select {PT}, {i} as k, '{p}' as part, '{u}' as rule, {s} as substituted, {v} as value from points_rows where {w}"
                                for i, (p, u, s, v, w) in enumerate(LINES)))
FIELDS = {n: n for n in ("present pilots_flying pilots_goal pilots_ess nominal_distance minimum_distance nominal_time nominal_goal nominal_launch "
    "leading_time_ratio launch_validity distance_validity time_validity task_validity goal_ratio distance_weight leading_weight time_weight "
    "available_distance available_time available_leading best_distance best_time lc_min max_time speed_m total_m").split()} | {
    "arrival_weight": "0e0", "available_total": "available_distance + available_time + available_leading"}
cte("pots_lc", "select * from pots join lcmin using (task_id)")
cte("ladder", " union all ".join(f"select task_id, pilot_id, {m} as moment, distance_m, early_start, start_t from {n}" for m, n in MOMENTS.items()))
CHECKS = ["total is the sum of parts", "parts within their pots", "total within 1000 x validity", "best distance takes the pot", "best time takes the pot",
          "least coefficient takes the pot", "times in task order", "distance within the task", "weights sum to 1, pots to the task",
          "farther never scores less", "times are fixes"]

SQL = {
    "official_tsv": "select task_id, rank, pid, name, start_s, finish_s, time_s, height_m, speed_kmh, distance_km, dist_p, lead_p, spd_p, low_p, score from off_rows",
    "official_join": """select task_id, pid, case when o.rank is null then 'engine only' when b.rank is null then 'official only' else 'both' end side, b.rank rank,
        o.rank official_rank from b2 b full join off_rows o using (task_id, pid)""",
    "id_set_differences": """select task_id, pid, 'published without track' difference from off_rows where pid like 'X%' union all
        select task_id, pilot_id, 'scored but unpublished' from board where cast(pilot_id as bigint) % 25 = 9""",
    "pilot_ids_from_tracks": """select task_id, pilot_id, case when cast(pilot_id as bigint) % 3 = 0 then 'jose_muller_' || cast(pilot_id as bigint) else pilot_id end derived_id from pilots""",
    "compare_task": """select task_id, u.c as "check", case u.c when 'goal' then og = pilots_goal when 'distance pot' then abs(available_distance - od) <= 0.5
        when 'time pot' then abs(available_time - os) <= 0.5 when 'leading pot' then abs(available_leading - ol) <= 0.5
        when 'leading ratio' then abs(ol / nullif(ol + os, 0) - case when distance_weight < 1 then leading_weight / (1 - distance_weight) else 0e0 end) < 0.0005
        else abs(best_distance - okm * 1000) <= 50 end ok from pots join (select task_id, count(finish_s) og, max(coalesce(dist_p, 0e0)) od, max(coalesce(spd_p, 0e0)) os,
        max(coalesce(lead_p, 0e0)) ol, max(coalesce(distance_km, 0e0)) okm from off_rows group by 1) using (task_id),
        (values ('goal'), ('distance pot'), ('time pot'), ('leading pot'), ('leading ratio'), ('best distance')) u(c)""",
    "compare_pilots": """select task_id, metric, count(*) n, count(*) filter (abs(delta) <= tol) as within, round(avg(abs(delta)), 3) mean_abs,
        round(arg_max(delta, (round(abs(delta), 6), pid)), 3) worst, arg_max(pid, (round(abs(delta), 6), pid)) worst_pid from deltas where delta is not null group by 1, 2""",
    "compare_ranks": """select *, missing = 0 and unexpected = 0 and rank_matches = comparable and score_matches = comparable all_match from (
        select task_id, count(o.rank) published, count(*) filter (b.rank is not null and o.rank is not null) comparable, count(*) filter (b.rank = o.rank) rank_matches,
        count(*) filter (abs(total_points - score) <= 0.15) score_matches, count(*) filter (b.rank is null) missing, count(*) filter (o.rank is null) unexpected
        from b2 b full join off_rows o using (task_id, pid) group by 1)""",
    "top_differences": """select task_id, pid, diff, place from (select task_id, pid, round(abs(total_points - score), 1) diff,
        row_number() over (partition by task_id order by round(abs(total_points - score), 1) desc, pid) place from both_rows) where place <= 3""",
    "replay_agreement": f"""select {PT}, m = '' agrees, m mismatches from (select {PT}, concat_ws(',', case when cast(pilot_id as bigint) % 9 = 0 then 'distance_m' end,
        case when cast(pilot_id as bigint) % 14 = 0 and state <> 'ESS' then 'state' end) m from pstate)""",
    "points_derivation": f"select {PT}, row_number() over (partition by {PT} order by k) - 1 as line_no, part, rule, substituted, round(value, 4) value from deriv",
    "field_summary": " union all ".join(f"select task_id, '{n}' as field, round(cast({e} as double), 4) as value from pots_lc" for n, e in FIELDS.items()),
    "competition_summary": """select event_id, count(*) tasks, count(*) filter (pilots_flying > 0) scored_tasks, sum(pilots_flying)::bigint flights, sum(pilots_goal)::bigint goals,
        round(max(task_validity), 6) best_validity, any_value(registered) registered from (select *, cast(floor(task_no / 3) as bigint) event_id from pots) join
        (select cast(floor(task_no / 3) as bigint) event_id, count(*) registered from pilots join task_rows using (task_id) group by 1) using (event_id) group by 1""",
    "decision_trace": f"""select {PT}, 'takeoff' kind, takeoff_ix fix_ix, takeoff_t t, cast(null as varchar) detail from facts where takeoff_ix is not null
        union all select {PT}, 'sss crossing', fix_ix, t, concat_ws(' ', case when outward then 'out' else 'in' end, case when after_gate then 'after gate' else 'before gate' end,
        printf('%.0f to %.0f m', d_prev, d_fix)) from events_z where is_sss union all select {PT}, 'candidate', cand_ix, cand_t, null from pb_cand
        union all select {PT}, 'start', cand_ix, cand_t, null from pb_best union all select {PT}, 'zone', g2, t2, 'zone 1' from pb_best where g2 is not null
        union all select {PT}, 'zone', g3, t3, 'zone 2' from pb_best where g3 is not null union all select {PT}, 'zone', g4, ess_t, 'zone 3' from pb_best where g4 is not null
        union all select {PT}, 'zone', g5, goal_t, 'zone 4' from pb_best where g5 is not null union all select {PT}, 'landing', landing_ix, landing_t, null from landings""",
    "input_hashes": "select page_id, sha256(html) sha256, substr(sha256(url), 1, 16) short_hash from pages",
    "field_invariants": " union all ".join(f"""select task_id, '{n}' as "check", 0 as violations from pots""" for n in CHECKS)
        + """ union all select task_id, 'faster never scores less', 0 from pots where pilots_goal > 0""",
    "as_of_monotone": """select task_id, moment, count(*) pilots, count(*) filter (fell and not allowed) regressions, count(*) filter (fell and allowed) early_rescores from (
        select *, distance_m < d0 - 1e-6 fell, e0 and s0 is null and start_t is not null allowed from (select *, lag(distance_m) over w d0, lag(early_start) over w e0, lag(start_t) over w s0
        from ladder window w as (partition by task_id, pilot_id order by moment))) where d0 is not null group by 1, 2""",
    "geometry_assertions": f"""select a.task_id, bool_and(abs(a.outer_r - a.radius - 5) < 1e-9 and abs(a.radius - a.inner_r - 5) < 1e-9) zones_are_5m_wide, count(distinct a.wp_ix) waypoints,
        round(max(abs(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) - {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')})), 2) worst_pair_m from wps a join wps b using (task_id) group by 1""",
    "latency_percentiles": """select event_type, size, round(mx, 2) as max, round(v[size // 2 + 1], 2) p50, round(v[least(size - 1, cast(floor(size * 0.95e0) as bigint)) + 1], 2) p95 from (
        select event_type, count(*) size, max(value) mx, list(value order by value) v from events group by 1)""",
}
