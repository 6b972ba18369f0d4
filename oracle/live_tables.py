"""Oracle SQL for the ingest-table queries."""

from .ctes import cte

PT = "task_id, pilot_id"
N = "cast(regexp_extract(task_id, '(\\d+)', 1) as bigint)"
cte("stored_pts", """select task_id, pilot_id, epoch, arg_max(lat, ord) lat, arg_max(alt_gps, ord) alt_gps, arg_max(alt_baro, ord) alt_baro,
    arg_max(event_id, ord) event_id, arg_max(source, ord) source, arg_max(raw, ord) raw from points_once where batch_id % 2 = 0 group by 1, 2, 3""")
cte("batch_pts", "select * from points_all where batch_id % 2 = 1 or ord >= 1000000000")
cte("batch_last", """select task_id, pilot_id, epoch, lat, alt_gps, alt_baro, event_id, source, raw from (select *, row_number() over
    (partition by task_id, pilot_id, epoch order by ord desc) n from batch_pts) where n = 1""")
cte("merged_pts", """select task_id, pilot_id, epoch, coalesce(s.lat, b.lat) lat, coalesce(b.alt_gps, s.alt_gps) alt_gps, coalesce(b.alt_baro, s.alt_baro) alt_baro,
    coalesce(b.event_id, s.event_id) event_id, coalesce(b.source, s.source) source, coalesce(b.raw, s.raw) raw,
    case when s.event_id is null then 'new' when b.event_id is null then 'kept' else 'updated' end change
    from stored_pts s full join batch_last b using (task_id, pilot_id, epoch)""")
cte("state0", "select task_id, max(epoch) latest_epoch, count(*) point_count from stored_pts group by 1")
cte("counted", """select task_id, received, accepted, received - accepted duplicates, processed_epoch, batch_epoch from
    (select task_id, count(*) received, max(epoch) processed_epoch from batch_pts group by 1) join
    (select task_id, count(*) filter (change = 'new') accepted, max(epoch) filter (change <> 'kept') batch_epoch from merged_pts group by 1) using (task_id)""")
cte("arch_pts", f"select ord as id, {PT}, epoch, {N} as n from points_all")
cte("arch_tasks", "select task_id, n, strftime(make_timestamp((max(epoch) - 86400 * (n % 7)) * 1000000), '%Y-%m-%d') task_date from arch_pts group by 1, 2")
ERR = "event_id % 89 = 0 or event_id % 97 = 0"

cte("saved", f"select *, {N} n from state0")

SQL = {
    "points_normalise": f"""select ord, case when event_id % 89 <> 0 then pilot_id end pilot_id, epoch, round(alt_gps, 1) alt_gps, 'partner' source,
        case when not ({ERR}) then sha256(concat_ws('|', pilot_id, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S+00:00'),
        printf('%.7f', round(lat, 6)), printf('%.7f', round(lon, 6)))) end fingerprint, {ERR} as bad from points_all""",
    "points_batch_reject": """select batch_id, count(*) points, case when bool_or(event_id % 3001 = 0) then 0 else count(*) end accepted
        from points_all group by 1""",
    "points_upsert": f"""select {PT}, epoch, round(lat, 4) lat, round(alt_gps, 1) alt_gps, round(alt_baro, 1) alt_baro, cast(event_id as varchar) event_id,
        source, change, json_extract_string(raw, '$.k') raw_k from merged_pts""",
    "ingest_counts": "select task_id, received, accepted, duplicates, processed_epoch from counted",
    "ingest_state": """select task_id, greatest(latest_epoch, batch_epoch) latest_epoch, coalesce(point_count, 0) + coalesce(accepted, 0) point_count,
        coalesce(accepted > 0, false) dirty from state0 full join (select * from counted where accepted > 0) using (task_id)""",
    "points_dedupe_read": f"""select {PT}, epoch as t, round(arg_max(lat, ord), 4) lat,
        coalesce(trunc(max_by(struct_pack(v := alt_baro), ord).v)::bigint, 0) alt_baro, coalesce(trunc(max_by(struct_pack(v := alt_gps), ord).v)::bigint, 0) alt_gps
        from points_all group by {PT}, epoch""",
    "tasks_to_score": f"""select task_id, 'ext-' || task_id external_id, point_count, latest_epoch from (select *, {N} n from state0)
        where n % 11 <> 10 and point_count > 0 and n % 5 <> 1""",
    "score_save": """select 'pilot' as kind, task_id, pilot_id, rank, case when n % 5 in (1, 2, 4) then points_received else -1 end as score, cast(null as bigint) processed_epoch,
            cast(null as bigint) point_count, cast(null as varchar) status, cast(null as varchar) summary, cast(null as varchar) error, cast(null as boolean) dirty
        from (select task_id, pilot_id, row_number() over (partition by task_id order by pilot_id) rank, count(*) points_received from points_all group by 1, 2)
        join saved using (task_id)
        union all select 'summary', task_id, null, null, null, case when n % 5 = 0 then 0 else latest_epoch end, case n % 5 when 0 then 1 when 2 then point_count - 1 else point_count end,
            case when n % 5 = 3 then 'error' else 'ok' end, case n % 5 when 0 then 'old' when 3 then '{}' else 'new' end,
            case when n % 5 = 3 then 'no fix inside the task' else '' end, null from saved
        union all select 'state', task_id, null, null, null, null, null, null, null, null, n % 5 in (0, 2, 3) from saved""",
    "pending_board": f"""select {PT}, row_number() over (partition by task_id order by pilot_id) rank, points_received, last_epoch, lat from (
        select {PT}, count(*) points_received, max(epoch) last_epoch, round(arg_max(lat, (epoch, ord)), 4) lat from points_all group by 1, 2)""",
    "latest_classification": f"""select {PT}, rank, state, total_points score, round(distance_m, 2) distance_m, cast(null as bigint) points_received, 'ok' status
        from board join (select task_id from task_rows where task_no % 2 = 0) using (task_id) union all
        select {PT}, row_number() over (partition by task_id order by pilot_id), 'TRACKING', 0e0, 0e0, n, 'pending' from (
        select {PT}, count(*) n from raw_fixes join (select task_id from task_rows where task_no % 2 = 1) using (task_id) group by 1, 2)""",
    "event_latest_task": """select cast(floor(task_no / 3) as bigint) event_id, task_no % 3 + 1 as version, b.task_id, pilot_id, rank, total_points from (
        select max(task_no) task_no from task_rows group by floor(task_no / 3)) join task_rows using (task_no) join board b using (task_id)""",
    "points_archive": """select task_id, case when n % 4 = 3 or task_date < '2024-01-29' then 0 else cnt end as active,
        case when n % 4 = 3 or task_date < '2024-01-29' then cnt else 0 end as archive,
        case when n % 4 <> 3 and task_date < '2024-01-29' then cnt else 0 end archived, case when n % 4 <> 3 and task_date < '2024-01-29' then cnt else 0 end deleted
        from arch_tasks join (select task_id, count(*) cnt from arch_pts group by 1) using (task_id)""",
    "points_read_fallback": f"select {PT}, count(*) points, min(epoch) first_epoch from arch_pts where epoch >= 1704499200 group by 1, 2",
    "roster_sync": """with p as (select cast(floor(s_suppkey / 5) as bigint) event_id, s_suppkey ord, case when s_suppkey % 43 <> 7 then cast(s_suppkey as varchar) end pilot_id,
        case when s_suppkey % 3 <> 0 then 'C' || s_nationkey end category_id, s_nationkey from supplier),
        e as (select *, case when pilot_id is null then 'pilot_id is required' when category_id is not null and s_nationkey > 22 then 'unknown category_id ' || category_id end message from p)
        select event_id, pilot_id, category_id, cast(null as varchar) message from e where event_id not in (select event_id from e where message is not null)
        union all select event_id, cast(ord as varchar), null, message from e where message is not null""",
    "task_sync": """select o_custkey external_id, count(*) filter (o_orderstatus <> 'P') as version, strftime(arg_max(o_orderdate, o_orderkey) filter (o_orderstatus <> 'P'), '%Y-%m-%d') task_date,
        arg_max(case when o_orderkey % 2 = 0 then 'override' else o_orderstatus end, o_orderkey) filter (o_orderstatus <> 'P') status,
        count(*) filter (o_orderstatus = 'P') refused from orders group by 1 having count(*) filter (o_orderstatus <> 'P') > 0""",
    "late_data_classify": f"""select {PT}, arrival, count(*) n from (select *, case when nth > 1 and lat = lat1 and lon = lon1 then 'duplicate' when nth > 1 then 'conflict'
        when reached > epoch then 'late' else 'in_order' end arrival from (select *, max(epoch) over (partition by {PT} order by ord rows between unbounded preceding and 1 preceding) reached,
        row_number() over s nth, first_value(lat) over s lat1, first_value(lon) over s lon1 from points_all window s as (partition by {PT}, epoch order by ord))) group by 1, 2, 3""",
    "tracker_priority_merge": f"""select {PT}, priority, count(*) n, max(t) last_epoch from (select *, max(case when priority = 1 then t end) over
        (partition by {PT} order by t, priority, ord rows unbounded preceding) best from (select *, case when ord % 3 = 0 then 2 else 1 end priority from raw_fixes))
        where priority = 1 or best is null or t - best > 40 group by 1, 2, 3""",
    "active_task_assign": """select pilot_id, active_task, count(*) n from (select f.pilot_id, f.ord, f.t, min(k.task_id) active_task from raw_fixes f
        join task_rows own using (task_id)
        left join task_rows k on k.task_no // 3 = own.task_no // 3 and f.t between k.gate - 900 and k.deadline group by 1, 2, 3) group by 1, 2""",
}
