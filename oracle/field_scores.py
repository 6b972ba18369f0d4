"""Oracle SQL for field scoring, special cases and ranking."""

from .ctes import CTES, cte, hav, with_fixes

PT = "task_id, pilot_id"
cte("pen_match", """select p.*, case when n1 > 0 then case when n1 = 1 then id1 end when n2 > 0 then case when n2 = 1 then id2 end
    when n3 = 1 then id3 end as pilot_id, case when n1 + n2 + n3 = 0 then 'no match'
    when case when n1 > 0 then n1 when n2 > 0 then n2 else n3 end > 1 then 'ambiguous' else 'applied' end as outcome from (
    select p.*, count(distinct q.pilot_id) filter (lower(trim(pilot_key)) in (q.pilot_id, q.pilot_id || '.igc', ltrim(q.pilot_id, '0')) or (ltrim(q.pilot_id, '0') = '' and trim(pilot_key) = '0')) n1,
    min(q.pilot_id) filter (lower(trim(pilot_key)) in (q.pilot_id, q.pilot_id || '.igc', ltrim(q.pilot_id, '0')) or (ltrim(q.pilot_id, '0') = '' and trim(pilot_key) = '0')) id1,
    count(distinct q.pilot_id) filter (lower(trim(pilot_key)) = lower(trim(name))) n2, min(q.pilot_id) filter (lower(trim(pilot_key)) = lower(trim(name))) id2,
    count(distinct q.pilot_id) filter (contains(lower(name), lower(trim(pilot_key)))) n3, min(q.pilot_id) filter (contains(lower(name), lower(trim(pilot_key)))) id3
    from penalty_rows p left join pilots q using (task_id) group by all) p""")
cte("pen_1", f"""select b.*, coalesce(p1.percent_own, 0) o1, coalesce(p1.percent_task, 0) k1, coalesce(p1.points, 0) f1,
    coalesce(p2.percent_own, 0) o2, coalesce(p2.percent_task, 0) k2, coalesce(p2.points, 0) f2, concat_ws('; ', p1.reason, p2.reason) reasons, p1.reason r1
    from points_rows b left join (select *, row_number() over (partition by {PT} order by ord) n from pen_match where pilot_id is not null) p1
    on p1.task_id = b.task_id and p1.pilot_id = b.pilot_id and p1.n = 1
    left join (select *, row_number() over (partition by {PT} order by ord) n from pen_match where pilot_id is not null) p2
    on p2.task_id = b.task_id and p2.pilot_id = b.pilot_id and p2.n = 2""")
cte("penalised", """select *, a1 + a2 as penalty_points, round(greatest(0e0, total1 - a2), 1) as net from (
    select *, total1 * o2 / 100 + 1000 * task_validity * k2 / 100 + f2 as a2 from (
    select *, round(greatest(0e0, total_points - a1), 1) as total1 from (
    select *, total_points * o1 / 100 + 1000 * task_validity * k1 / 100 + f1 as a1 from pen_1)))""")
cte("stops", """select task_id, gate + 4500 as stop_t, gate, gate2, start_type from task_rows where task_no % 2 = 1""")
cte("started", "select task_id, pilot_id, case when start_type <> 'RACE' then cand_t when gate2 <= cand_t then gate2 else gate end as start_t from pb_best join task_rows using (task_id)")
with_fixes("started", "_ka", "select f.* from raw_fixes f join stops k using (task_id) where f.t <= k.stop_t")
cte("stop_spans", """select k.*, k.stop_t - coalesce(from_all, last_s) as span_s from (select *, case when gate2 is null and start_type = 'RACE' then gate end as from_all from stops) k
    left join (select task_id, max(start_t) last_s from started_ka group by 1) using (task_id)""")
cte("stop_windows", f"select {PT}, coalesce(from_all, start_t) as from_t, coalesce(from_all, start_t) + span_s as to_t from started_ka join stop_spans using (task_id)")
KB = """select f.* from raw_fixes f join stops k using (task_id) left join stop_windows w on w.task_id = f.task_id and w.pilot_id = f.pilot_id
    where f.t <= least(k.stop_t, coalesce(w.to_t, k.stop_t))"""
with_fixes("pstate", "_kb", KB)
cte("down", f"select s.task_id, s.pilot_id, coalesce(least(s.landing_t, l.landing_t) <= stop_t, false) as is_down from pstate_kb s join stops using (task_id) left join landings l on l.task_id = s.task_id and l.pilot_id = s.pilot_id")
cte("stop_factor", """select *, coalesce(case when reached_ess > 0 then 1e0 when duration_s >= 3600 then
    least(1e0, case when len_ess - best_m + 1 <= 0 then 0e0 else sqrt(greatest(0e0, (best_m - mean_m) / (len_ess - best_m + 1))) end
    + case when launched <= 0 then 0e0 else pow(landed / launched, 3) end) else 0e0 end, 0e0) as factor from (
    select s.task_id, any_value(k.stop_t) stop_t, any_value(span_s) duration_s, count(ess_t) reached_ess, count(*) filter (takeoff_t is not null and is_down) landed,
    count(*) filter (takeoff_t is not null) launched, max(distance_m) filter (takeoff_t is not null) best_m, avg(distance_m) filter (takeoff_t is not null) mean_m,
    any_value(s.total_m) - any_value(t.ess_rem) len_ess from pstate_kb s join down using (task_id, pilot_id) join stop_spans k on k.task_id = s.task_id join tasks t on t.task_id = s.task_id group by 1)""")
with_fixes("validity", "_kb", KB)
CTES["validity_kb"] = f"select v.* replace (task_validity * factor as task_validity) from ({CTES['validity_kb']}) v join stop_factor using (task_id)"
with_fixes("points_rows", "_kb", KB)
cte("last_kb", f"select f.task_id, f.pilot_id, max(f.t) t, arg_max(alt_gps, f.t) alt from track_kb f group by 1, 2")
cte("bonuses", f"""select *, greatest(distance_m, bd) as scored_m from (select task_id, pilot_id, distance_m, case when flying then bonus else 0e0 end bonus,
    case when flying then least(total_m, total_m - d + bonus) end bd from (
    select s.task_id, s.pilot_id, s.distance_m, s.total_m, g.d, s.goal_t is null and g.d is not null and not is_down as flying, greatest(0e0, alt - 950e0) * 5e0 as bonus
    from pstate_kb s join down using (task_id, pilot_id) join last_kb l using (task_id, pilot_id)
    left join exact_goal_kb g on g.task_id = s.task_id and g.pilot_id = s.pilot_id and g.t = l.t))""")
cte("reduced", f"""select *, case when n_goal > 0 and best_time is not null then greatest(0e0, available_time * case when ref_s <= best_time then 1e0 else
    greatest(0e0, 1 - pow((ref_s - best_time) / 3600 / sqrt(best_time / 3600), 5e0 / 6)) end) else 0e0 end as reduction from (
    select b.*, z.scored_m, count(goal_t) over (partition by b.task_id) n_goal, max(z.scored_m) over (partition by b.task_id) best_scored,
    coalesce(min(section_s) filter (ess_t is not null and goal_t is null and not is_down) over (partition by b.task_id), span_s) as ref_s
    from points_rows_kb b join bonuses z using (task_id, pilot_id) join down using (task_id, pilot_id) join stop_spans using (task_id))""")
cte("stop_points", """select *, round(t_points + d_points + leading_points, 1) as total from (select *, case when n_goal = 0 then 0e0
    when goal_t is not null then round(greatest(0e0, time_points - reduction), 1) else time_points end as t_points,
    case when best_scored <= 0 then 0e0 else round(least(scored_m / best_scored, 1e0) * (available_distance + reduction), 1) end as d_points from reduced)""")
NXT = "case when cand_ix is null then 0 else 2 + (g2 is not null)::int + (g3 is not null)::int + (g4 is not null)::int + (g5 is not null)::int end"
cte("lastpos", "select s.task_id, s.pilot_id, f.lat last_lat, f.lon last_lon from pstate s join track f on f.task_id = s.task_id and f.pilot_id = s.pilot_id and f.fix_ix = s.last_ix")
cte("aged", f"""select *, first_gate + 9000 - last_t as age_s, takeoff_t is not null and start_t is null as dns,
    least((g2 is not null)::int + (g3 is not null)::int + (g4 is not null)::int + (g5 is not null)::int, 3) as tp from pstate""")


def pots(cols):
    return f"select task_id, {cols} from pots"


SQL = {
    "field_counts": pots("present, pilots_flying, pilots_ess, pilots_goal, round(best_distance, 2) best_distance"),
    "best_time": pots("round(best_time, 1) best_time, round(best_ess_time, 1) best_ess_time"),
    **{k: pots(f"round({k}, 8) {k}") for k in ("launch_validity", "distance_validity", "time_validity", "task_validity")},
    "max_time": pots("round(max_time, 1) max_time"),
    "allocation": pots("""round(goal_ratio, 6) goal_ratio, round(distance_weight, 8) distance_weight, round(leading_weight, 8) leading_weight,
        round(time_weight, 8) time_weight, 0e0 arrival_weight, round(available_distance, 5) available_distance, round(available_leading, 5) available_leading,
        round(available_time, 5) available_time, round(available_leading / (available_leading + available_time), 6) implied_leading_ratio,
        round_even(available_distance, 0) integer_distance_pot"""),
    "leading_coefficient": f"select {PT}, round(lc, 6) lc, round(lc_min, 6) lc_min from points_rows",
    "distance_points": f"select {PT}, distance_points, round(distance_m, 2) distance_m from points_rows",
    "time_points": f"select {PT}, time_points, round(section_s, 1) section_s from points_rows",
    "leading_points": f"select {PT}, leading_points from points_rows",
    "goal_altitude_factor": f"select {PT}, round(goal_alt, 1)::double goal_alt, round(goal_altitude_factor, 6) goal_altitude_factor from points_rows",
    "ess_no_goal_factor": f"""select {PT}, case when goal_t is not null then 1e0 when ess_t is not null then round(ess_no_goal_time_factor, 2)
        else 0e0 end ess_factor from points_rows""",
    "task_total": f"select {PT}, distance_points, time_points, leading_points, total_points from points_rows",
    "score_field": f"""select {PT}, rank, state, round(distance_m, 2) distance_m, distance_points, time_points, leading_points, total_points,
        round(lc, 6) lc from board""",
    "scored_distance": f"select {PT}, round(raw_distance_m, 2) raw_distance_m, round(distance_m, 2) scored_m from pstate",
    "per_task_overrides": """select task_id, round(case when task_no % 3 = 1 then 0.2632e0 else leading_time_ratio end, 4) leading_time_ratio,
        case when task_no % 3 = 1 then 4500e0 else nominal_time end nominal_time,
        case when task_no % 3 = 1 and task_no % 2 = 0 then true else goal_elevated end goal_elevated,
        case when task_no % 3 = 1 and task_no % 2 = 0 then 1000e0 else goal_elevation end goal_elevation,
        case when task_no % 3 = 1 then 'leading_time_ratio above 0.26' end warning from task_rows""",
    "penalty_match": "select task_id, ord, pilot_key, pilot_id, outcome from pen_match",
    "penalties_apply": f"""select {PT}, total_points gross_points, round(penalty_points, 4) penalty_points, net total_points,
        case when r1 is not null then reasons end penalty_reasons from penalised""",
    "final_ranking": f"""select {PT}, row_number() over (partition by task_id order by net desc, distance_m desc, pilot_id) as rank, state,
        round(distance_m, 2) distance_m, net total_points from penalised""",
    "progress_ranking": f"""select {PT}, row_number() over (partition by task_id order by case when goal_t is not null then 0 when ess_t is not null then 1 else 2 end,
        coalesce(goal_t, ess_t, 0), case when goal_t is null and ess_t is null then -distance_m else 0 end, pilot_id) as rank, state from pstate""",
    "classification": f"""select b.task_id, b.pilot_id, rank, state, total_points score, z.wp_ix next_waypoint_index, z.name next_waypoint,
        round({hav('last_lat', 'last_lon', 'z.lat', 'z.lon')}, 1) distance_to_next_m, round(greatest(0e0, b.total_m - distance_m), 1) distance_to_goal_m,
        round(least(100e0, greatest(0e0, distance_m / b.total_m * 100)), 3) progress_percent
        from board b join lastpos l using (task_id, pilot_id) left join wps z on z.task_id = b.task_id and z.wp_ix = {NXT}""",
    "top_n": f"select {PT}, rank, total_points from board where rank <= 3",
    "tracking_status": f"""select {PT}, age_s, case when age_s > 120 then 'LOST' else 'ONLINE' end tracking, case when goal_t is not null then 'GOAL'
        when ess_t is not null then 'ESS' when dns and early_start then 'EARLY' when dns and age_s > 900 then 'NO START' when dns then 'PRE-START'
        when takeoff_t is null then 'WAITING' when age_s > 900 then 'LANDED' when age_s > 120 then 'NO SIG' else concat('TP', tp) end status from aged""",
    "board_counts": """select task_id, count(*) filter (goal_t is not null) n_goal, count(*) filter (goal_t is null and ess_t is not null) n_ess,
        count(*) filter (dns) n_no_start, count(*) filter (ess_t is null and not dns and age_s > 900) n_landed,
        count(*) filter (ess_t is null and not dns and age_s > 120 and age_s <= 900) n_lost, count(*) filter (ess_t is null and not dns and age_s <= 120) n_flying,
        count(*) filter (start_t is not null) n_started, count(*) filter (takeoff_t is not null) n_launched from aged group by 1""",
    "stopped_window": f"select {PT}, from_t, to_t from stop_windows",
    "stopped_task": """select task_id, stop_t, duration_s, reached_ess, landed, launched, round(best_m, 2) best_m, round(mean_m, 2) mean_m,
        round(factor, 6) stopped_validity from stop_factor""",
    "stopped_points": f"""select {PT}, round(reduction, 4) reduction, t_points stopped_time_points, d_points stopped_distance_points, leading_points from stop_points""",
    "altitude_bonus": f"select {PT}, round(bonus, 2) bonus_m, round(bd, 2) bonus_distance_m, round(scored_m, 2) stopped_distance_m from bonuses",
    "stopped_board": f"""select {PT}, row_number() over (partition by task_id order by total desc, scored_m desc, pilot_id) as rank, state,
        round(scored_m, 2) distance_m, total total_points from stop_points""",
}
cte("lcs_code", CTES["lcs"].replace("p.max_time,", "greatest(least(p.last_ess, cast(p.deadline - p.first_gate as double)), s.last_task_time) as max_time,"))
SQL["max_time_by_pilot"] = f"select {PT}, round(lc, 6) lc from lcs_code"
