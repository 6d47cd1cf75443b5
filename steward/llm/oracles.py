"""DuckDB SQL of the contracts that SQL can express over whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_control = r"([<\[])(\||/?s>|/?INST\]|<?/?SYS>)"
_escaped = lambda c: f"regexp_replace(replace({c}, '\\', '\\\\'), '{_control}', '\\1\\\\\\2', 'g')"
OP5 = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, turn, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v(turn, role))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|role|><|text|><|end|>') + length({_escaped("role")}) + length({_escaped("text")}))::bigint as formatted_chars
from c group by conv_id"""

_word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP6 = f"""
with recursive d as (select doc_id, regexp_extract_all({LOW}, '{_word}') as w from documents),
b as (select item_id, regexp_extract_all({LOW}, '{_word}') as w from benchmark),
windows as (select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as span
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0) x),
sizes as (select distinct n from windows),
places as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as span from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n) x),
hits as (select p.doc_id, p.i, p.n, item_id from places p join windows using (n, span)),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) x group by 1),
found as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as items from hits group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join found using (doc_id)"""

OP8 = f"""
with recursive d as (select doc_id, regexp_extract_all({LOW}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from d where len(w) > 0) x),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select x, x as y from (select distinct x from e) z union select r.x, e.y from r join e on r.y = e.x),
m as (select x, min(y) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id from d left join n using (doc_id) left join m on m.x = d.doc_id"""

ORACLES = {"op5_chat_formatting": OP5, "op6_decontamination": OP6, "op8_jaccard_join": OP8}
