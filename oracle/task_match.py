"""Oracle SQL for task and track matching."""

from .ctes import cte

PT = "task_id, pilot_id"
cte("sizes", "select task_id, count(distinct pilot_id) pilots from track group by 1")
cte("uniq_z", "select task_id, min(wp_ix) wp_ix from wps group by task_id, round(lat, 5), round(lon, 5), radius")
cte("entries", f"""select f.task_id, f.pilot_id, z.wp_ix, min(f.t) entry_t from track f join wps z using (task_id) join uniq_z u on u.task_id = z.task_id and u.wp_ix = z.wp_ix
    where fix_ix > 0 and pow(f.x - z.x, 2) + pow(f.y - z.y, 2) <= outer_r * outer_r group by 1, 2, 3""")
cte("nearest", """select f.task_id, pilot_id, wp_ix, kind, radius, min(sqrt(pow(f.x - z.x, 2) + pow(f.y - z.y, 2))) d from track f join wps z using (task_id) group by all""")
cte("e_row", f"""select {PT}, max(entry_t) filter (wp_ix = 1) e1, max(entry_t) filter (wp_ix = 2) e2, max(entry_t) filter (wp_ix = 3) e3,
    max(entry_t) filter (wp_ix = 4) e4, max(entry_t) filter (wp_ix = 5) e5 from entries group by 1, 2""")
# every subset of zones 1..4 with the goal; a bit that is set wants its zone entered in order
cte("sub_ok", f"""select task_id, pilot_id, mask from e_row, unnest(range(16)) u(mask) where e5 is not null
    and (mask & 8 = 0 or e1 is not null) and (mask & 4 = 0 or e2 is not null) and (mask & 2 = 0 or e3 is not null) and (mask & 1 = 0 or e4 is not null)
    and (mask & 8 = 0 or e1 <= least(case when mask & 4 > 0 then e2 else e5 end, case when mask & 2 > 0 then e3 else e5 end, case when mask & 1 > 0 then e4 else e5 end, e5))
    and (mask & 4 = 0 or e2 <= least(case when mask & 2 > 0 then e3 else e5 end, case when mask & 1 > 0 then e4 else e5 end, e5))
    and (mask & 2 = 0 or e3 <= least(case when mask & 1 > 0 then e4 else e5 end, e5)) and (mask & 1 = 0 or e4 <= e5)""")
cte("sub_best", """select * from (select *, row_number() over (partition by task_id order by length desc, completed desc, mask desc) n from (
    select task_id, mask, count(*) completed, 1 + bit_count(mask::int) as length from sub_ok group by 1, 2) join sizes using (task_id)
    where completed >= greatest(3, round_even(pilots * 0.05e0, 0))) where n = 1""")
cte("full_ok", "select task_id, count(*) completed from sub_ok where mask = 15 group by 1")
cte("ways", f"""select e.task_id, e.pilot_id, 'enter' way, e.t from (select {PT}, min(t) t from events_z where is_sss and transition and not outward group by 1, 2) e
    union all select x.task_id, x.pilot_id, 'exit', min(x.t) from events_z x join (select {PT}, min(t) t0 from events_z where is_sss and transition and not outward group by 1, 2) e
    on e.task_id = x.task_id and e.pilot_id = x.pilot_id where x.is_sss and x.transition and x.outward and x.t > t0 group by 1, 2""")
cte("minutes", """select task_id, way, cast(floor((t - midnight) / 60) as bigint) as minute, count(*) n from ways join task_rows using (task_id) group by 1, 2, 3""")

SQL = {
    "zone_reach": """select task_id, wp_ix, reached, pilots, round(reached / pilots, 4) share, round(d, 2) median_closest_m,
        case when kind in ('SSS', 'TAKEOFF') and reached / pilots < 0.5 then true else reached / pilots <= 0.05 end suspect from (
        select *, count(*) filter (d <= radius) over z reached, count(*) over z pilots, row_number() over (partition by task_id, wp_ix order by d, pilot_id) n
        from nearest window z as (partition by task_id, wp_ix)) where n - 1 = pilots // 2""",
    "start_analysis": """select task_id, pilots, enter_total, exit_total, enter_minute, enter_busiest, exit_minute, exit_busiest, declared_minute,
        case when greatest(enter_busiest, exit_busiest) >= 0.5 * pilots and abs(m - declared_minute) > 2 then m end suggested_minute from (
        select *, case when enter_busiest >= exit_busiest then enter_minute else exit_minute end m from (
        select task_id, pilots, coalesce(sum(n) filter (way = 'enter'), 0)::bigint enter_total, coalesce(sum(n) filter (way = 'exit'), 0)::bigint exit_total,
        arg_max(minute, (n, -minute)) filter (way = 'enter') enter_minute, coalesce(max(n) filter (way = 'enter'), 0) enter_busiest,
        arg_max(minute, (n, -minute)) filter (way = 'exit') exit_minute, coalesce(max(n) filter (way = 'exit'), 0) exit_busiest, 720 declared_minute
        from minutes join sizes using (task_id) group by 1, 2))""",
    "first_entries": f"select {PT}, wp_ix, entry_t from entries",
    "task_completers": """select task_id, sizes.pilots, coalesce(f.completed, 0) completed, case when f.completed > 0 then 'as written' when b.task_id is not null then 'shortened'
        else 'no relation' end verdict from sizes left join full_ok f using (task_id) left join sub_best b using (task_id)""",
    "longest_flown_subroute": """select task_id, length, completed, concat_ws(',', case when mask & 8 > 0 then '1' end, case when mask & 4 > 0 then '2' end,
        case when mask & 2 > 0 then '3' end, case when mask & 1 > 0 then '4' end, '5') route from sub_best""",
    "last_exit": f"""select {PT}, exit_t, min(exit_t) over (partition by task_id) inferred_gate from (select e.task_id, e.pilot_id, max(t) exit_t
        from seg e left join (select {PT}, min(t) before_t from events_z where is_next group by 1, 2) n using (task_id, pilot_id)
        where is_sss and d0 <= outer_r and d1 > outer_r and (before_t is null or t <= before_t) group by 1, 2)""",
}
