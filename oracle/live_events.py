"""Oracle SQL for the event stream and exports."""

from .ctes import cte

PT = "task_id, pilot_id"
cte("ev_all", """select *, task_id as comp, ord + case when event_id % 10 = 3 then 1500 else 0 end as arrival, event_id + 1 as seq, 'e' || event_id as eid,
    case when event_id % 100 = 8 then 'task.upsert' when event_id % 100 = 18 then 'competition.upsert' when event_id % 100 = 28 then 'competition.status'
    when event_id % 10 = 9 then 'pilot.upsert' when event_id % 51 = 1 then 'posn' else 'position' end as kind from points_all""")
cte("ev_reason", """select *, case when event_id % 54 = 4 then 'missing observed_at' when event_id % 50 = 0 then 'schema' when kind = 'posn' then 'type'
    when event_id % 52 = 2 then 'data is not an object' when event_id % 53 = 3 then 'sequence is not an integer' else 'ok' end as reason from ev_all""")
cte("ev_ok", "select * from ev_reason where reason = 'ok'")
cte("ev_one", "select comp, eid, pilot_id, seq, kind, min(epoch) epoch from ev_ok group by 1, 2, 3, 4, 5")
cte("ev_gate", """select o.*, case when coalesce(k.known_at > o.seq, true) then 'unknown pilot' when coalesce(s.task_at > o.seq, true) or coalesce(s.params_at > o.seq, true)
    then 'before setup' else 'accepted' end outcome from ev_one o left join (select comp, pilot_id, min(seq) known_at from ev_one where kind = 'pilot.upsert' group by 1, 2) k using (comp, pilot_id)
    left join (select comp, min(seq) filter (kind = 'task.upsert') task_at, min(seq) filter (kind = 'competition.upsert') params_at from ev_one group by 1) s using (comp)
    where kind = 'position'""")
cte("export_rows", f"""select task_id comp, 0 k, 'competition.upsert' as kind, null as pilot_id, midnight as t from task_rows union all
    select task_id, 1, 'task.upsert', null, midnight from task_rows union all select task_id, 2, 'pilot.upsert', pilot_id, midnight from pilots join task_rows using (task_id)
    union all select task_id, 3, 'position', pilot_id, t from fixes union all select task_id, 4, 'competition.status', null, max(t) from fixes group by 1""")

SQL = {
    "event_stream_read": "select arrival, comp competition_id, eid event_id, case when event_id % 53 <> 3 then seq end as sequence, kind as type from ev_all",
    "event_validate": "select reason, count(*) n from ev_reason group by 1",
    "event_dedupe": """select comp competition_id, eid event_id, seq as sequence, kind as type, arrival, observed_at, alt_gps from (select *,
        strftime(to_timestamp(epoch) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') observed_at, row_number() over (partition by comp, eid order by arrival, alt_gps) n
        from (select * replace (cast(trunc(coalesce(alt_gps, 0)) as bigint) as alt_gps) from ev_ok)) where n = 1""",
    "sequence_guard": """select comp competition_id, count(distinct eid) accepted, count(*) - count(distinct eid) refused, max(seq) top
        from ev_ok group by 1""",
    "setup_state": """select comp competition_id, kind as type, case when kind = 'pilot.upsert' then pilot_id else '' end as key, max(seq) as sequence
        from ev_ok where kind <> 'position' group by 1, 2, 3""",
    "position_gate": "select comp competition_id, outcome, count(*) n from ev_gate group by 1, 2",
    "position_append": """select comp competition_id, pilot_id, count(*) filter (m is null or epoch > m) appended, count(*) filter (epoch <= m) refused, max(epoch) clock from (
        select *, max(epoch) over (partition by comp, pilot_id order by seq rows between unbounded preceding and 1 preceding) m from ev_one where kind = 'position') group by 1, 2""",
    "publish_cadence": "select comp competition_id, seq as sequence, kind = 'competition.status' on_status from ev_one where seq % 25 = 0 or kind = 'competition.status'",
    "snapshot_upsert": """select comp competition_id, s as sequence, payload, place from (select *, row_number() over (partition by comp order by s desc) place from (
        select comp, cast(floor(seq / 5) as bigint) * 5 s, arg_max(eid, arrival) payload from ev_ok group by 1, 2)) where place <= 10""",
    "reorder_buffer": f"""select slot, row_number() over (partition by slot order by pilot_id, epoch, ord) place, {PT}, epoch, ord from (
        select *, cast(floor((epoch + ord % 7 * 3) / 10) as bigint) slot from points_all)""",
    "dirty_task_scoring": """select task_id, point_count + accepted as point_count, greatest(latest_epoch, batch_epoch) latest_epoch from state0 join counted using (task_id)
        where accepted > 0 and cast(regexp_extract(task_id, '(\\d+)', 1) as bigint) % 11 <> 10""",
    "tracking_lost": f"select {PT}, t + 120 as lost_t, nt as back_t from (select *, lead(t) over (partition by {PT} order by t) nt from fixes) where nt - t > 120",
    "late_recompute": f"select {PT}, rank, state, round(distance_m, 2) distance_m, total_points from board",
    "replay_equals_live": "select 'batch only' as side, 0 as n union all select 'stream only', 0 union all select 'micro-batches', 5",
    "events_export": """select comp competition_id, 100 + row_number() over (partition by comp order by k, t, pilot_id) as sequence, kind as type, pilot_id, t from export_rows""",
    "partition_layout": "select task_id, count(*) fixes, count(distinct pilot_id) pilots from fixes group by 1",
}
