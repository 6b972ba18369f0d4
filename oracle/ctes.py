"""ANSI SQL building blocks, written independently of the Spark plans, that a second
engine (DuckDB) runs on the same tables to check every result."""

from __future__ import annotations

import re

from skyrank import fixtures as fx

R = "6371000e0"
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = " ".join(sql.split())


def needed(sql: str) -> list[str]:
    need, todo = set(), [sql]
    while todo:
        for name in set(re.findall(r"[a-z_][a-z0-9_]*", todo.pop())):
            if name in CTES and name not in need:
                need.add(name)
                todo.append(CTES[name])
    return [n for n in CTES if n in need]


def at_moment(name: str, seconds: int) -> str:
    """Define building block ``name`` once more as known so many seconds after the gate."""
    names = needed(name)
    tag = lambda text: re.sub(r"[a-z_][a-z0-9_]*", lambda m: f"{m[0]}_at{seconds}" if m[0] in names else m[0], text)
    for n in names:
        body = CTES[n]
        if n == "raw_fixes":
            body = f"select f.* from ({body}) f join task_rows k using (task_id) where f.t <= k.gate + {seconds}"
        CTES[f"{n}_at{seconds}"] = tag(body)
    return f"{name}_at{seconds}"


def with_fixes(name: str, suffix: str, raw_fixes: str) -> str:
    """Define ``name`` and what leads to it once more over other fixes; what does not read fixes is shared."""
    reads = {n for n in needed(name) if "raw_fixes" in needed(n) + [n]}
    tag = lambda text: re.sub(r"[a-z_][a-z0-9_]*", lambda m: m[0] + suffix if m[0] in reads else m[0], text)
    for n in needed(name) + [name]:
        if n in reads | {name} and n + suffix not in CTES:
            CTES[n + suffix] = raw_fixes if n == "raw_fixes" else tag(CTES[n])
    return name + suffix


def compose(sql: str) -> str:
    """Prefix ``sql`` with the building blocks it needs, in definition order."""
    parts = [f"{n} as materialized ({CTES[n]})" for n in needed(sql)]
    return (f"with {', '.join(parts)} " if parts else "") + " ".join(sql.split())


# --- inputs ---------------------------------------------------------------------
cte("task_rows", fx.stages_sql(
    "(select distinct cast(floor(s_suppkey / 10) as bigint) as task_no from supplier)", fx.TASK_STAGES))
cte("waypoint_rows", fx.stages_sql(
    "(select task_id, variant, lat0, lon0, unnest(range(6)) as wp_ix from task_rows)", fx.WAYPOINT_STAGES))
cte("raw_fixes", f"select {', '.join(fx.FIX_COLUMNS)} from ({fx.stages_sql('lineitem', fx.FIX_STAGES)})")
cte("pilots", f"select task_id, pilot_id, name, source_file from ({fx.stages_sql('supplier', fx.PILOT_STAGES)})")
cte("penalty_rows", f"select {', '.join(fx.PENALTY_COLUMNS)} from "
    f"({fx.stages_sql('supplier', fx.PENALTY_STAGES)}) where pilot_key is not null")
cte("points_once", f"""select task_id, pilot_id, batch_id, ord, cast(floor(epoch(ts)) as bigint) as epoch, lat, lon,
    alt_gps, alt_baro, source, raw, event_id from ({fx.stages_sql('events', fx.POINT_STAGES)})""")
cte("points_all", """select task_id, pilot_id, batch_id, ord, epoch, lat, lon, alt_gps, alt_baro, source, raw, event_id
    from points_once union all
    select task_id, pilot_id, batch_id, ord + 1000000000, epoch, lat, lon, 777e0, null, source, raw, event_id
    from points_once where event_id % 7 = 0""")

# --- task compilation -------------------------------------------------------------
cte("wp_kinds", """select w.*, case when declared in ('TAKEOFF','SSS','ESS') then declared
    when wp_ix = n - 1 then 'GOAL'
    when wp_ix = 0 and not has_takeoff and coalesce(sss_at > 0, true) then 'TAKEOFF' else 'TURNPOINT' end as kind
    from waypoint_rows w join (select task_id, count(*) n, bool_or(coalesce(declared = 'TAKEOFF', false)) has_takeoff,
    min(wp_ix) filter (declared = 'SSS') sss_at from waypoint_rows group by 1) using (task_id)""")
cte("centres", "select task_id, avg(lat) clat, avg(lon) clon from waypoint_rows group by 1")


def plane(lat, lon, clat="clat", clon="clon"):
    cosc = (f"least(1e0, greatest(-1e0, sin(radians({clat})) * sin(radians({lat})) + cos(radians({clat})) * "
            f"cos(radians({lat})) * cos(radians({lon}) - radians({clon}))))")
    k = f"case when acos({cosc}) < 1e-12 then 1e0 else acos({cosc}) / sin(acos({cosc})) end"
    x = f"{R} * {k} * cos(radians({lat})) * sin(radians({lon}) - radians({clon}))"
    y = (f"{R} * {k} * (cos(radians({clat})) * sin(radians({lat})) - sin(radians({clat})) * cos(radians({lat})) * "
         f"cos(radians({lon}) - radians({clon})))")
    return x, y


def hav(a, b, c, d):
    return (f"2 * {R} * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * "
            f"cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))")


X, Y = plane("lat", "lon")
cte("wps", f"""select *, case when kind = 'TAKEOFF' then 0e0 else measure end as rr from (
    select w.task_id, wp_ix, name, kind, lat, lon, radius, alt, clat, clon,
    least(radius, radius - 5e0) as inner_r, greatest(radius, radius + 5e0) as outer_r,
    greatest(radius, radius + 5e0) as measure, {X} as x, {Y} as y from wp_kinds w join centres using (task_id))""")
cte("rim0", """select task_id, wp_ix, q, rr, x as cx, y as cy, 2 * pi() * q / k as ang, 2 * pi() / k as step,
    x + cos(2 * pi() * q / k) * rr as qx, y + sin(2 * pi() * q / k) * rr as qy from (
    select *, unnest(range(k)) as q from (select *, case when rr <= 0 then 1
    else greatest(144, cast(ceil(2 * pi() * rr / 100e0) as bigint)) end as k from wps))""")


def value_ctes(prefix: str, rim: str, last: int) -> None:
    """prefix_v: every rim point with its shortest onward distance, next zone and next point."""
    cte(f"{prefix}_{last}", f"select task_id, wp_ix, q, qx, qy, 0e0 as v, cast(null as bigint) as nxt, "
        f"cast(null as bigint) as pick from {rim} where wp_ix = {last}")
    done = [f"{prefix}_{last}"]
    for i in range(last - 1, -1, -1):
        later = " union all ".join(f"select * from {d}" for d in done)
        cte(f"{prefix}_{i}", f"""select p.task_id, p.wp_ix, p.q, p.qx, p.qy,
            coalesce(min(sqrt(pow(p.qx - n.qx, 2) + pow(p.qy - n.qy, 2)) + n.v), 0e0) as v, any_value(p.nx) as nxt,
            arg_min(n.q, sqrt(pow(p.qx - n.qx, 2) + pow(p.qy - n.qy, 2)) + n.v) as pick
            from (select r.task_id, r.wp_ix, r.q, r.qx, r.qy, min(w.wp_ix) as nx from {rim} r
                  left join wps w on w.task_id = r.task_id and w.wp_ix > {i} and w.wp_ix <= {last}
                  and sqrt(pow(r.qx - w.x, 2) + pow(r.qy - w.y, 2)) > w.rr where r.wp_ix = {i}
                  group by 1, 2, 3, 4, 5) p
            left join ({later}) n on n.task_id = p.task_id and n.wp_ix = p.nx group by 1, 2, 3, 4, 5""")
        done.append(f"{prefix}_{i}")
    cte(f"{prefix}_v", " union all ".join(f"select * from {d}" for d in done))


def path_ctes(prefix: str, last: int) -> None:
    cte(f"{prefix}_p0", f"select task_id, wp_ix, q, nxt, pick from (select *, row_number() over "
        f"(partition by task_id order by v, q) rn from {prefix}_v where wp_ix = 0) where rn = 1")
    for s in range(1, last + 1):
        cte(f"{prefix}_p{s}", f"select v.task_id, v.wp_ix, v.q, v.nxt, v.pick from {prefix}_p{s - 1} a join {prefix}_v v "
            f"on v.task_id = a.task_id and v.wp_ix = a.nxt and v.q = a.pick")
    cte(f"{prefix}_path", " union all ".join(f"select task_id, wp_ix, q from {prefix}_p{s}" for s in range(last + 1)))


value_ctes("dpa", "rim0", 5)
path_ctes("dpa", 5)
rim, dp = "rim0", "dpa"
for level, nxt_dp in ((1, "dpb"), (2, "dpc")):
    cte(f"rim{level}", f"""select task_id, wp_ix, d + 20 as q, rr, cx, cy, ang0 + step * d / 20e0 as ang, step / 20e0 as step,
        cx + cos(ang0 + step * d / 20e0) * rr as qx, cy + sin(ang0 + step * d / 20e0) * rr as qy
        from (select r.task_id, r.wp_ix, r.rr, r.cx, r.cy, r.ang as ang0, r.step, unnest(range(-20, 21)) as d
              from {rim} r join {dp}_path p using (task_id, wp_ix, q) where r.rr > 0)
        union all select r.task_id, r.wp_ix, r.q, r.rr, r.cx, r.cy, r.ang, r.step, r.qx, r.qy from {rim} r
        left join (select distinct task_id, wp_ix from {dp}_path) p using (task_id, wp_ix)
        where r.rr <= 0 or p.wp_ix is null""")
    value_ctes(nxt_dp, f"rim{level}", 5)
    path_ctes(nxt_dp, 5)
    rim, dp = f"rim{level}", nxt_dp
cte("picked", f"select r.task_id, r.wp_ix, r.qx, r.qy from {rim} r join {dp}_path using (task_id, wp_ix, q)")
cte("opt_raw", """select w.task_id, w.wp_ix, w.x as cx, w.y as cy, w.rr, p.qx is not null as chosen,
    coalesce(p.qx, a.qx + u * (coalesce(b.qx, a.qx) - a.qx)) as ox, coalesce(p.qy, a.qy + u * (coalesce(b.qy, a.qy) - a.qy)) as oy
    from (select w.*, (select max(wp_ix) from picked k where k.task_id = w.task_id and k.wp_ix < w.wp_ix) as ia,
          (select min(wp_ix) from picked k where k.task_id = w.task_id and k.wp_ix > w.wp_ix) as ib from wps w) w
    left join picked p on p.task_id = w.task_id and p.wp_ix = w.wp_ix
    left join picked a on a.task_id = w.task_id and a.wp_ix = w.ia
    left join picked b on b.task_id = w.task_id and b.wp_ix = w.ib,
    lateral (select case when b.qx is null or pow(b.qx - a.qx, 2) + pow(b.qy - a.qy, 2) <= 1e-18 then 0e0 else
    least(1e0, greatest(0e0, ((w.x - a.qx) * (b.qx - a.qx) + (w.y - a.qy) * (b.qy - a.qy)) /
    (pow(b.qx - a.qx, 2) + pow(b.qy - a.qy, 2)))) end as u)""")
cte("opt", """select task_id, wp_ix, case when moves then ax + t * (ox - ax) else ox end as opt_x,
    case when moves then ay + t * (oy - ay) else oy end as opt_y from (
    select *, coalesce(chosen and wp_ix > 0 and rr > 0 and sqrt(c + rr * rr) > rr and a >= 1e-18 and disc >= 0
    and t >= 0 and t <= 1, false) as moves from (
    select *, (-b - sqrt(greatest(disc, 0e0))) / (2 * nullif(a, 0e0)) as t from (
    select *, b * b - 4 * a * c as disc from (
    select *, pow(ox - ax, 2) + pow(oy - ay, 2) as a, 2 * ((ax - cx) * (ox - ax) + (ay - cy) * (oy - ay)) as b,
    pow(ax - cx, 2) + pow(ay - cy, 2) - rr * rr as c from (
    select *, lag(ox) over (partition by task_id order by wp_ix) ax, lag(oy) over (partition by task_id order by wp_ix) ay
    from opt_raw)))))""")
cte("zones", """select w.*, opt_x, opt_y, leg_m, sum(leg_m) over (partition by task_id order by wp_ix desc) as remaining
    from wps w join (select *, coalesce(sqrt(pow(lead(opt_x) over z - opt_x, 2) + pow(lead(opt_y) over z - opt_y, 2)), 0e0) as leg_m
    from opt window z as (partition by task_id order by wp_ix)) using (task_id, wp_ix)""")
cte("tasks", """select t.*, gate as first_gate, start_ix, ess_ix, goal_ix, total_m, start_rem - ess_rem as speed_m,
    case when start_ix > 0 then total_m - start_rem else 0e0 end as launch_to_sss_m, ess_rem from task_rows t join (
    select task_id, any_value(s) start_ix, any_value(e) ess_ix, any_value(g) goal_ix, max(remaining) filter (wp_ix = 0) total_m,
    max(remaining) filter (wp_ix = s) start_rem, max(remaining) filter (wp_ix = e) ess_rem from zones z join (
    select task_id as tid, coalesce(min(wp_ix) filter (kind = 'SSS'), 1) s, coalesce(min(wp_ix) filter (kind = 'ESS'), max(wp_ix)) e,
    max(wp_ix) g from zones group by 1) k on k.tid = z.task_id group by 1) using (task_id)""")

# --- tracks -----------------------------------------------------------------------
cte("fixes", """select task_id, pilot_id, t, arg_min(lat, ord) lat, arg_min(lon, ord) lon, arg_min(alt_baro, ord) alt_baro,
    arg_min(alt_gps, ord) alt_gps from raw_fixes group by 1, 2, 3""")
cte("fixes_xy", f"select task_id, pilot_id, t, lat, lon, alt_baro, alt_gps, {X} as x, {Y} as y "
    "from fixes join centres using (task_id)")
cte("track", """select *, pow(x - x0, 2) + pow(y - y0, 2) > 40000 as away from (
    select *, row_number() over w - 1 as fix_ix, lag(x) over w as px, lag(y) over w as py, lag(t) over w as pt,
    first_value(x) over w as x0, first_value(y) over w as y0
    from fixes_xy window w as (partition by task_id, pilot_id order by t))""")
cte("facts", """select task_id, pilot_id, count(*) fixes_used, min(t) first_t, max(t) last_t, max(fix_ix) last_ix,
    min(t) filter (away) takeoff_t, min(fix_ix) filter (away) takeoff_ix from track group by 1, 2""")
CHORD = """(l2 > 1e-18 and dot > 0 and dot < l2 and crs * crs <= outer_r * outer_r * l2)"""
cte("seg", """select *, (d0 < inner_r) <> (d1 < inner_r) or (d0 <= outer_r) <> (d1 <= outer_r) as transition,
    d0 > outer_r and d1 > outer_r and l2 > 1e-18 and dot > 0 and dot < l2 and crs * crs <= outer_r * outer_r * l2 as chord
    from (select f.task_id, pilot_id, fix_ix, t, f.px, f.py, f.x, f.y, wp_ix, inner_r, outer_r, start_ix, goal_ix, first_gate, deadline,
    wp_ix = start_ix as is_sss, sqrt(pow(f.px - z.x, 2) + pow(f.py - z.y, 2)) d0, sqrt(pow(f.x - z.x, 2) + pow(f.y - z.y, 2)) d1,
    pow(f.x - f.px, 2) + pow(f.y - f.py, 2) l2, (z.x - f.px) * (f.x - f.px) + (z.y - f.py) * (f.y - f.py) dot,
    (z.x - f.px) * (f.y - f.py) - (z.y - f.py) * (f.x - f.px) crs
    from track f join zones z using (task_id) join tasks using (task_id) where f.px is not null and wp_ix >= start_ix)""")
cte("events_z", """select task_id, pilot_id, wp_ix, fix_ix, t, is_sss, t >= first_gate as after_gate, t > deadline as late,
    wp_ix = start_ix + 1 as is_next, transition, chord and not transition as segment_only, d1 > d0 as outward, d0 as d_prev, d1 as d_fix
    from seg where (chord and not transition) or (case when is_sss then transition else d0 <= outer_r or d1 <= outer_r end)""")


def play_ctes(p: str, cuts: str) -> None:
    """One scoring pass with evidence ending at ``cuts``(task_id, pilot_id, cut_ix)."""
    cte(f"{p}_cross", f"""select e.*, cut_ix from events_z e join {cuts} using (task_id, pilot_id)
        where is_sss and fix_ix <= coalesce(cut_ix, 2147483647)""")
    cte(f"{p}_next", f"""select task_id, pilot_id, min(fix_ix) next_ix from events_z join {cuts} using (task_id, pilot_id)
        where is_next and fix_ix <= coalesce(cut_ix, 2147483647) group by 1, 2""")
    cte(f"{p}_cand", f"""select task_id, pilot_id, fix_ix cand_ix, t cand_t, cut_ix from (
        select c.*, max(case when fix_ix <= next_ix then fix_ix end) over (partition by task_id, pilot_id) last_before,
        gate2 is not null or start_type <> 'RACE' as multi
        from {p}_cross c left join {p}_next using (task_id, pilot_id) join tasks using (task_id) where after_gate)
        where multi or last_before is null or fix_ix = last_before""")
    prev = f"select task_id, pilot_id, cand_ix, cand_t, cut_ix, cand_ix as g1 from {p}_cand"
    cols = "task_id, pilot_id, cand_ix, cand_t, cut_ix, g1"
    for k in range(2, 6):
        prev = f"""select {', '.join('a.' + c for c in cols.split(', '))}, min(e.fix_ix) as g{k} from ({prev}) a
            left join events_z e on e.task_id = a.task_id and e.pilot_id = a.pilot_id and e.wp_ix = {k} and not e.is_sss
            and not e.late and e.fix_ix > a.g{k - 1} and e.fix_ix <= coalesce(a.cut_ix, 2147483647)
            group by {', '.join('a.' + c for c in cols.split(', '))}"""
        cols += f", g{k}"
    cte(f"{p}_chain", prev)
    cte(f"{p}_played", f"""select c.*, f.fix_ix, f.t, f.alt_gps, total_m,
        case when f.fix_ix = cand_ix then total_m when f.fix_ix >= coalesce(g5, 2147483647) then 0e0 else
        greatest(0e0, sqrt(pow(f.x - z.x, 2) + pow(f.y - z.y, 2)) - z.measure) + z.remaining end as rem
        from {p}_chain c join tasks using (task_id) join track f using (task_id, pilot_id)
        left join zones z on z.task_id = c.task_id and z.wp_ix = 2 + case when f.fix_ix >= g2 then 1 else 0 end
        + case when f.fix_ix >= g3 then 1 else 0 end + case when f.fix_ix >= g4 then 1 else 0 end + case when f.fix_ix >= g5 then 1 else 0 end
        where f.fix_ix >= cand_ix and f.fix_ix <= coalesce(g5, cut_ix, 2147483647) and (f.t <= deadline or f.fix_ix = cand_ix)""")
    cte(f"{p}_runs", f"""select task_id, pilot_id, cand_ix, cand_t, g1, g2, g3, g4, g5, total_m, min(rem) least_rem,
        arg_min(fix_ix, (rem, fix_ix)) dist_ix, max(t) filter (fix_ix > cand_ix) last_play_t,
        max(t) filter (fix_ix = g2) t2, max(t) filter (fix_ix = g3) t3, max(t) filter (fix_ix = g4) ess_t, max(t) filter (fix_ix = g5) goal_t,
        max(alt_gps) filter (fix_ix = g5) goal_alt from {p}_played group by all""")
    cte(f"{p}_best", f"""select *, case when goal_t is not null then total_m else greatest(0e0, total_m - least_rem) end as raw_m from (
        select *, row_number() over (partition by task_id, pilot_id order by goal_t is not null desc,
        case when goal_t is null then total_m - least_rem end desc, case when goal_t is null then cand_ix else -cand_ix end) rn
        from {p}_runs) where rn = 1""")


cte("no_cut", "select task_id, pilot_id, cast(null as bigint) as cut_ix from facts")
play_ctes("pa", "no_cut")

# --- landing ----------------------------------------------------------------------
cte("search", """select f.task_id, f.pilot_id, coalesce(cand_t, takeoff_t) + 60 as after_t, last_t as before_t, g5 as goal_fix
    from facts f left join pa_best using (task_id, pilot_id) where coalesce(cand_t, takeoff_t) is not null""")
cte("closings", """select a.task_id, a.pilot_id, a.fix_ix, a.t, a.x, a.y, min(b.t) as close_t from track a join track b
    on a.task_id = b.task_id and a.pilot_id = b.pilot_id and b.t >= a.t + 180 group by all""")
cte("anchors", """select a.task_id, a.pilot_id, a.fix_ix, a.t, close_t from closings a join track b
    on a.task_id = b.task_id and a.pilot_id = b.pilot_id and b.t between a.t and a.close_t group by all
    having max(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) <= 10000 and max(b.alt_gps) - min(b.alt_gps) <= 80""")
cte("steps", """select a.task_id, a.pilot_id, a.t, min(b.t) as next_t from track a join track b
    on a.task_id = b.task_id and a.pilot_id = b.pilot_id and b.t >= a.t + 5 and b.t < a.t + 2000 group by all""")
cte("landing_hits", """with recursive grid as (
    select s.task_id, s.pilot_id, min(f.t) as t from search s join track f using (task_id, pilot_id)
    where f.t >= after_t group by 1, 2
    union all select g.task_id, g.pilot_id, s.next_t from grid g join steps s using (task_id, pilot_id, t)
    left join anchors a on a.task_id = g.task_id and a.pilot_id = g.pilot_id and a.t = g.t where a.t is null)
    select task_id, pilot_id, min(t) as landing_t, min(fix_ix) as landing_ix from grid join anchors using (task_id, pilot_id, t) group by 1, 2""")
cte("landings", """select h.* from landing_hits h join search using (task_id, pilot_id)
    where goal_fix is null or goal_fix > landing_ix""")
cte("cuts", "select f.task_id, f.pilot_id, landing_ix as cut_ix from facts f left join landings using (task_id, pilot_id)")
play_ctes("pb", "cuts")

# --- exact progress ---------------------------------------------------------------
value_ctes("dpe", "rim0", 4)
cte("limits", """select b.*, l.landing_ix, l.landing_t, deadline, first_gate, speed_m, progress_curve,
    least(coalesce(l.landing_t, f.last_t), deadline) as state_until, least(coalesce(l.landing_t + 15, f.last_t), f.last_t, deadline) as dist_until
    from pb_best b join facts f using (task_id, pilot_id) join tasks using (task_id) left join landings l using (task_id, pilot_id)""")
cte("sampled", """select f.task_id, f.pilot_id, f.fix_ix, f.t, f.x, f.y, first_gate, speed_m, progress_curve,
    2 + case when f.fix_ix >= g2 then 1 else 0 end + case when f.fix_ix >= g3 then 1 else 0 end
    + case when f.fix_ix >= g4 then 1 else 0 end + case when f.fix_ix >= g5 then 1 else 0 end as wp_ix,
    goal_t is null and f.t <= dist_until as for_goal, f.t <= coalesce(ess_t, state_until) as for_lead
    from limits l join track f using (task_id, pilot_id) where f.fix_ix >= cand_ix and f.fix_ix <= coalesce(g5, 2147483647)
    and (f.t <= deadline or f.fix_ix = cand_ix) and f.t <= greatest(dist_until, state_until)
    """)


def way(s):
    """Metres by the rim point ``s`` steps from the best one, with onward distances on a parabola."""
    return (f"(sqrt(pow(x - (cx + cos(2e0 * pi() * (q + {s}) / k) * rr), 2) + pow(y - (cy + sin(2e0 * pi() * (q + {s}) / k) * rr), 2))"
            f" + v + (v_right - v_left) / 2 * {s} + ((v_right + v_left) / 2 - v) * {s} * {s})")


A3, B3 = "(r.lo + (r.hi - r.lo) / 3)", "(r.hi - (r.hi - r.lo) / 3)"
SHRUNK = f"""list_reduce(list_transform(range(41), lambda i: {{'lo': -1e0, 'hi': 1e0}}), lambda r, z: case when {way(A3)} <= {way(B3)}
    then {{'lo': r.lo, 'hi': {B3}}} else {{'lo': {A3}, 'hi': r.hi}} end)"""
cte("rim_k", "select task_id, wp_ix, any_value(rr) rr, any_value(cx) cx, any_value(cy) cy, count(*) k from rim0 group by 1, 2")
for target, stop, dp, want in (("goal", 5, "dpa", "for_goal"), ("ess", 4, "dpe", "for_lead")):
    cte(f"aimed_{target}", f"""select s.*, case when s.wp_ix > {stop} then 0e0 else sqrt(pow(s.x - z.opt_x, 2) + pow(s.y - z.opt_y, 2)) + z.remaining - e.remaining end as upper,
        (select min(wp_ix) from wps w where w.task_id = s.task_id and w.wp_ix >= s.wp_ix and w.wp_ix <= {stop}
        and sqrt(pow(s.x - w.x, 2) + pow(s.y - w.y, 2)) > w.measure) as aim from sampled s
        left join zones z on z.task_id = s.task_id and z.wp_ix = s.wp_ix join zones e on e.task_id = s.task_id and e.wp_ix = {stop} where {want}""")
    cte(f"grid_{target}", f"""select s.task_id, s.pilot_id, s.fix_ix, s.t, s.x, s.y, first_gate, speed_m, progress_curve, aim, upper,
        min(sqrt(pow(s.x - v.qx, 2) + pow(s.y - v.qy, 2)) + v.v) as d,
        arg_min(v.q, (sqrt(pow(s.x - v.qx, 2) + pow(s.y - v.qy, 2)) + v.v, v.q)) as q
        from aimed_{target} s left join {dp}_v v on v.task_id = s.task_id and v.wp_ix = s.aim group by all""")
    cte(f"exact_{target}", f"""select task_id, pilot_id, fix_ix, t, first_gate, speed_m, progress_curve, case when aim is null then 0e0
        when rr > 0 and abs(v_right + v_left - 2 * v) <= 0.1e0 * 2 * pi() * rr / k then least(upper, d, {way("((b.lo + b.hi) / 2)")})
        else least(upper, d) end as d from (
        select *, case when aim is not null then {SHRUNK} end as b from (
        select g.*, m.v, l.v as v_left, n.v as v_right, k.rr, k.cx, k.cy, k.k from grid_{target} g
        left join rim_k k on k.task_id = g.task_id and k.wp_ix = g.aim
        left join {dp}_v m on m.task_id = g.task_id and m.wp_ix = g.aim and m.q = g.q
        left join {dp}_v l on l.task_id = g.task_id and l.wp_ix = g.aim and l.q = (g.q + k.k - 1) % k.k
        left join {dp}_v n on n.task_id = g.task_id and n.wp_ix = g.aim and n.q = (g.q + 1) % k.k))""")
cte("exact_best", "select task_id, pilot_id, min(d) exact_remaining, arg_min(fix_ix, (d, fix_ix)) exact_ix from exact_goal group by 1, 2")
cte("lead_rows", """select *, d / 1000 as d_km, speed_m / 1000 as section_km, t - first_gate as task_time from (
    select *, least(speed_m / 1000, coalesce(min(d / 1000) over (partition by task_id, pilot_id order by t
    rows between unbounded preceding and 1 preceding), speed_m / 1000)) as prev_km from exact_ess) where d / 1000 < prev_km""")


def weight_antiderivative(u):
    """Integral over u of (1-10^(9u-9))^5 (1-10^(-3u))^2, expanded by hand into powers of ten."""
    five, two = [1, -5, 10, -10, 5, -1], [1, -2, 1]
    terms = []
    for i, a in enumerate(five):
        for j, b in enumerate(two):
            k = 9 * i - 3 * j
            c = f"({a * b}e0 * pow(10e0, {-9 * i}))"
            terms.append(f"{c} * ({u})" if k == 0 else f"{c} * pow(10e0, {k} * ({u})) / ({k} * ln(10e0))")
    return "(" + " + ".join(terms) + ")"


def clamp01(e):
    return f"least(1e0, greatest(0e0, {e}))"


def weight_integral(a, b):
    return f"({weight_antiderivative(f'1 - {clamp01(a)}')} - {weight_antiderivative(f'1 - {clamp01(b)}')})"


def rising(u):
    return f"pow(1 - pow(10e0, 9 * ({u}) - 9), 5)"


def falling(u):
    return f"pow(1 - pow(10e0, -3 * ({u})), 2)"


MID = "((prev_km + d_km) / (2 * section_km))"
cte("leads", f"""select task_id, pilot_id, sum(case when progress_curve = 'HUMP_V2A'
    then task_time * (prev_km - d_km) * {rising(MID)} * {falling(MID)}
    else d_km * task_time * {weight_integral('1 - prev_km / section_km', '1 - d_km / section_km')} end) lead_area,
    min(d_km) lead_min_km from lead_rows group by 1, 2""")

# --- pilot state and field ---------------------------------------------------------
cte("pstate", """select s.*, case when goal_t is not null then 'GOAL' when ess_t is not null then 'ESS' when cand_ix is not null then 'STARTED'
    when takeoff_t is not null then 'AIRBORNE' else 'WAITING' end as state,
    case when cand_ix is not null or takeoff_t is not null then greatest(minimum_distance, raw_distance_m) else 0e0 end as distance_m,
    cast(ess_t - start_t as double) as section_s,
    case when ess_t - start_t > 0 then speed_m / (ess_t - start_t) * 3.6e0 end as speed_kmh
    from (select f.task_id, f.pilot_id, case when l.landing_ix is null or takeoff_ix <= l.landing_ix then takeoff_t end takeoff_t,
    coalesce(l.landing_t, last_t) last_t, coalesce(l.landing_ix, last_ix) last_ix, l.landing_t, l.landing_ix, b.cand_ix, b.cand_t as start_cross_t,
    b.g2, b.g3, b.g4, b.g5, b.t2, b.t3, b.ess_t, b.goal_t, b.goal_alt, b.least_rem,
    case when b.goal_t is null then coalesce(exact_ix, dist_ix) else dist_ix end as dist_fix_ix,
    b.cand_ix is null and coalesce(early, false) as early_start, minimum_distance, speed_m, k.total_m, k.first_gate, deadline, progress_curve,
    case when b.cand_ix is null then null when start_type <> 'RACE' then b.cand_t when gate2 <= b.cand_t then gate2 else gate end as start_t,
    case when b.cand_ix is null then case when coalesce(early, false) then greatest(0e0, launch_to_sss_m) else 0e0 end
    when b.goal_t is null and exact_remaining is not null then greatest(0e0, k.total_m - exact_remaining) else raw_m end as raw_distance_m,
    coalesce(cast(last_play_t - k.first_gate as double), 0e0) last_task_time, lead_area, lead_min_km
    from facts f join tasks k using (task_id) left join landings l using (task_id, pilot_id) left join pb_best b using (task_id, pilot_id)
    left join exact_best using (task_id, pilot_id) left join leads using (task_id, pilot_id)
    left join (select task_id, pilot_id, bool_or(not after_gate) early from pb_cross group by 1, 2) using (task_id, pilot_id)) s""")
FLY = "(takeoff_t is not null or distance_m > 0)"
cte("totals", f"""select task_id, count(*) pilots_rows, count(*) filter ({FLY}) pilots_flying,
    count(*) filter ({FLY} and ess_t is not null) pilots_ess, count(*) filter ({FLY} and goal_t is not null) pilots_goal,
    coalesce(max(distance_m) filter ({FLY}), 0e0) best_distance,
    min(section_s) filter ({FLY} and section_s <> 0 and goal_t is not null) best_time,
    min(section_s) filter ({FLY} and section_s <> 0) best_ess_time,
    coalesce(sum(greatest(0e0, distance_m - minimum_distance)) filter ({FLY}), 0e0) over_minimum,
    coalesce(max(last_task_time) filter ({FLY} and start_t is not null), 0e0) last_out,
    coalesce(cast(max(ess_t - first_gate) filter ({FLY}) as double), 0e0) last_ess from pstate group by 1""")


def cubic(x, a, b, c, d):
    return f"({a} + {b} * ({x}) + {c} * pow({x}, 2) + {d} * pow({x}, 3))"


cte("validity", f"""select *, launch_validity * distance_validity * time_validity as task_validity from (
    select t.*, k.* exclude (task_id, total_m, speed_m, pilots_present), k.total_m, k.speed_m,
    coalesce(pilots_present, pilots_rows) as present,
    case when pilots_flying = 0 then 0e0 else {clamp01(cubic('least(1e0, pilots_flying / (coalesce(pilots_present, pilots_rows) * nominal_launch))', '0e0', '0.028e0', '2.917e0', '-1.944e0'))} end as launch_validity,
    case when pilots_flying = 0 then 0e0 else least(1e0, over_minimum / (pilots_flying * ((nominal_goal + 1) * (nominal_distance - minimum_distance)
      + greatest(0e0, nominal_goal * (best_distance - nominal_distance))) / 2)) end as distance_validity,
    case when pilots_flying = 0 then 0e0 else {clamp01(cubic('least(1e0, case when best_ess_time > 0 then best_ess_time / nominal_time else best_distance / nominal_distance end)', '-0.271e0', '2.912e0', '-2.098e0', '0.457e0'))} end as time_validity,
    case when pilots_flying = 0 then 0e0 else pilots_goal / pilots_flying end as goal_ratio
    from totals t join tasks k using (task_id))""")
cte("pots", f"""select *, 1000 * task_validity * distance_weight as available_distance, 1000 * task_validity * time_weight as available_time,
    1000 * task_validity * leading_weight as available_leading, 0e0 as available_arrival,
    least(greatest(last_out, last_ess), cast(deadline - first_gate as double)) as max_time from (
    select *, 1 - distance_weight - leading_weight as time_weight from (
    select *, case when goal_ratio = 0 then 1 - distance_weight else (1 - distance_weight) * leading_time_ratio end as leading_weight from (
    select *, {cubic('goal_ratio', '0.9e0', '-1.665e0', '1.713e0', '-0.587e0')} as distance_weight from validity)))""")
cte("lcs", f"""select *, case when start_t is null or not {FLY} then 0e0 when progress_curve = 'HUMP_V2A' then
    (area + case when near > 0 then case when best_time > 0 then best_time / 2 + 100 * near else greatest(0e0, max_time - last_task_time) end
    * near * {falling('near / sec_km')} else 0e0 end) / (1800 * sec_km)
    else (area + near * max_time * {weight_integral('1 - near / sec_km', '1e0')}) / (1800 * sec_km) end as lc from (
    select s.*, p.max_time, p.best_time, p.best_distance, p.task_validity, p.available_distance, p.available_time, p.available_leading, p.pilots_ess,
    p.goal_elevated, p.goal_elevation, p.ess_no_goal_time_factor, coalesce(lead_area, 0e0) area, s.speed_m / 1000 as sec_km,
    coalesce(lead_min_km, s.speed_m / 1000) near from pstate s join pots p using (task_id))""")
cte("lcmin", """select task_id, coalesce(min(lc) filter (lc > 0 and (progress_curve <> 'HUMP_V2A' or pilots_ess = 0 or ess_t is not null)), 0e0) lc_min
    from lcs group by 1""")
ALT = "((goal_alt - 950e0) / goal_elevation)"
cte("points_rows", f"""select *, round(distance_points + time_points + leading_points, 1) as total_points from (
    select *, case when best_distance <= 0 then 0e0 else round(least(distance_m / best_distance, 1e0) * available_distance, 1) end as distance_points,
    case when best_time > 0 and section_s <> 0 then round(case when section_s <= best_time then 1e0 else greatest(0e0,
      1 - pow((section_s - best_time) / 3600 / sqrt(best_time / 3600), 5e0 / 6)) end * available_time * goal_altitude_factor
      * case when goal_t is not null then 1e0 when ess_t is not null then ess_no_goal_time_factor else 0e0 end, 1) else 0e0 end as time_points,
    case when lc > 0 and lc_min > 0 then round(greatest(0e0, 1 - cbrt(pow(lc - lc_min, 2) / lc_min)) * available_leading, 1) else 0e0 end as leading_points
    from (select *, case when goal_elevated and goal_t is not null then case when {ALT} <= 0 then 0.8e0 when {ALT} >= 1 then 1e0
    else {cubic(ALT, '0.8e0', '0.6e0', '-0.6e0', '0.2e0')} end else 1e0 end as goal_altitude_factor from lcs join lcmin using (task_id)))""")
cte("board", """select *, row_number() over (partition by task_id order by total_points desc, distance_m desc, pilot_id) as rank from points_rows""")
