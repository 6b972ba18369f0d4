"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, sharding
from .queries import CONTROL_CASE


def _escaped(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


MARKS = len(chat.START) + len(chat.MESSAGE) + len(chat.END)

OP1 = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{CONTROL_CASE}'
  union all select -7, 1, 'assistant', '{CONTROL_CASE}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum({MARKS} + length({_escaped('role')}) + length({_escaped('text')})) as bigint) as formatted_chars
from turns group by conv_id
"""

_FOLDED = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""
with d as (select doc_id, coalesce({_FOLDED}, []) as w from documents),
b as (select item_id, coalesce({_FOLDED}, []) as w from benchmark),
phrase as (
  select distinct item_id, least(13, len(w)) as n, w[i : i + least(13, len(w)) - 1] as p
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from phrase),
spots as (
  select doc_id, i, n, w[i : i + n - 1] as p
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes)),
found as (select s.doc_id, s.i, s.n, item_id from spots s join phrase using (n, p)),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

OP5 = f"""
with filled as (select string_split('{",".join(map(str, sharding.fill()))}', ',') as t),
placed as (
  select doc_id, source,
    cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12)) as bigint) % {sharding.SLOTS} as slot
  from documents)
select doc_id, source, slot, cast(t[slot + 1] as bigint) as shard from placed, filled
"""

OP7 = """
with d as (
  select doc_id, coalesce('s' || source, 't') as k, coalesce(cast(doc_id as varchar), '') as id,
    coalesce(cast(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as bigint), 0) as size,
    cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as o
  from documents),
s as (
  select k, cast(sum(size) as bigint) as source_size, cast((row_number() over (order by k) - 1) % 3 + 1 as double) as w
  from d group by k),
r as (select *, 3 * source_size as cap, 3 * source_size / w as ratio from s),
l as (
  select *, (cast(sum(source_size) over () as bigint) - cast(coalesce(sum(cap) over b, 0) as bigint))
            / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from r window b as (order by ratio, k rows between unbounded preceding and 1 preceding)),
t as (
  select k, source_size,
    coalesce(least(cast(cap as double), w * (select level from l where level <= ratio order by ratio, k limit 1)), 0) as target
  from l),
q as (
  select d.*, source_size, target,
    cast(sum(size) over (partition by k order by o, id, size rows unbounded preceding) as bigint) as done
  from d join t using (k)),
c as (select q.*, case when target > 0 then (x * source_size + done) / target end as f
  from q, (select unnest([0, 1, 2]) as x)),
run as (
  select doc_id, size, cast(sum(size) over (order by f, k, o, id rows unbounded preceding) as bigint) as run
  from c where f is not null),
taken as (select doc_id, cast(sum(size) as bigint) as n from run where run <= (select sum(size) from d) group by doc_id)
select q.doc_id, q.size, cast(q.source_size as bigint) as source_size, target, coalesce(n, 0) as taken
from q left join taken using (doc_id)
"""

OP3 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

OP6 = """
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
spots as (
  select doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) as p
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by p order by doc_id, i) as n from spots) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from later),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
kept as (
  select doc_id, string_agg(x, ' ' order by j) as k, count(*) as n
  from words anti join gone using (doc_id, j) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (doc_id)
"""

OP9 = """
with d as (select doc_id, coalesce(encode(text), ''::blob) as b from documents),
spots as (
  select doc_id, i, md5(array_slice(b, i, i + 49)) as p
  from (select doc_id, b, unnest(range(1, octet_length(b) - 48)) as i from d)),
firsts as (select p, min(doc_id) as m from spots group by p having min(doc_id) < max(doc_id)),
later as (select doc_id, i from spots join firsts using (p) where doc_id > m),
numbered as (
  select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run
  from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from later)),
runs as (select doc_id, run, min(i) as a, max(i) + 50 as e from numbered group by doc_id, run),
gaps as (select *, coalesce(lag(e) over (partition by doc_id order by a), 1) as f from runs),
kept as (
  select doc_id, count(*) as n_spans, sum(e - a) as n_removed, max(e) as tail,
    string_agg(substr(hex(b), 2 * f - 1, 2 * (a - f)), '' order by a) as h
  from gaps join d using (doc_id) group by doc_id)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  coalesce(n_spans, 0) as n_spans,
  sha256(case when h is null then b else unhex(h || substr(hex(b), 2 * tail - 1)) end) as kept_sha256
from d left join kept using (doc_id)
"""

OP13 = """
with d as (
  select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
e as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as c1, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as c2,
    cast('0x' || substr(h, 17, 8) as bigint) % 100 as c3, cast('0x' || substr(h, 25, 8) as bigint) % 100 as c4
  from d),
f as (
  select doc_id, t, n, least(c1, c2) as a, greatest(c1, c2) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c3 >= 90 then 'plain'
         when c4 < 20 then 'spm' else 'psm' end as form
  from e),
g as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
         else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from g
"""

ORACLES = {
    "op1_chat_formatting": OP1, "op3_exact_topk": OP3, "op4_benchmark_decontamination": OP4, "op5_sharding": OP5,
    "op6_substring_dedup": OP6, "op7_source_mixing": OP7, "op9_suffix_array_dedup": OP9,
    "op13_fill_in_middle": OP13,
}
