"""DuckDB statements that recompute queries of this package where SQL can express them over whole tables.

The learnt scores, compression, tokenizer and packing queries have none. Line de-duplication, passages and repetition
are compared with brute force in the tests, as their sequences of hashes have no practical SQL over whole tables.
"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_FOLD = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
with p as (
  select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p),
r(action, rule_host, rule_path) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
  ('block', 'com', '/de/')),
best as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         arg_max(action, length(rule_host || rule_path)) as action
  from q join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id)
select q.page_id, host, path, rule, coalesce(action, 'allow') as verdict, false as alias_blocked, false as alias_allowed
from q left join best using (page_id)
"""

OP8 = rf"""
with recursive w as (
  select doc_id, {_WORDS.format(text=_FOLD.format(text='text'))} as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] end) as g
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
-- A text that shares most of its shingles with another holds one of its rarest ones: only those start a pair.
f as (select g, count(*) as f from s group by g),
ranked as (
  select s.doc_id, s.g, n.n, row_number() over (partition by s.doc_id order by f.f, s.g) as r
  from s join f using (g) join n using (doc_id)),
prefix as (select doc_id, g from ranked where r <= n - ceil(n * 0.85) + 1),
cand as (select distinct a.doc_id as a, b.doc_id as b from prefix a join prefix b on a.g = b.g and a.doc_id < b.doc_id),
shared as (select a, b, count(*) as c from cand join s x on x.doc_id = a join s y on y.doc_id = b and y.g = x.g group by a, b),
links as (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(node, root) using key (node) as (
  select distinct a, a from edges
  union
  select e.b, min(r.root) from reach r join edges e on e.a = r.node join recurring.reach o on o.node = e.b
  where r.root < o.root group by e.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(r.root, d.doc_id) as component_id,
       d.doc_id = coalesce(r.root, d.doc_id) as kept
from documents d left join n using (doc_id) left join reach r on r.node = d.doc_id
"""

OP10 = r"""
with words as (
  select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
items as (
  select distinct id as item, least(len(ws), 10) as size, unnest([array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ')
    for i in range(1, len(ws) - least(len(ws), 10) + 2)]) as g
  from words where side = 'b' and len(ws) > 0),
sizes as (select distinct size from items),
grams as (
  select id, size, unnest([{'pos': i, 'g': array_to_string(ws[i:i + size - 1], ' ')} for i in range(1, len(ws) - size + 2)]) as x
  from words, sizes where side = 'd'),
met as (select id, size, x.pos as pos, item from grams join items using (size) where x.g = items.g),
hit as (select id, count(distinct p) as n_hit from (select id, unnest(range(pos, pos + size)) as p from met) group by id),
named as (select id, count(distinct item) as n_items, string_agg(distinct item::varchar, ',' order by item::varchar) as ids
          from met group by id)
select w.id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words w left join hit h on h.id = w.id left join named n on n.id = w.id where side = 'd'
"""

OP11 = r"""
with told as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, turn, role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as v(turn, role)),
e as (
  select *, replace(replace(replace(text, '\', '\b'), '<turn ', '\t'), '</turn>', '\e') as said,
         replace(replace(replace(replace(role, '\', '\b'), '<turn ', '\t'), '</turn>', '\e'), '>', '\g') as head
  from told)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<turn ' || head || '>' || said || '</turn>'))::bigint as formatted_chars, true as mask_fits
from e group by conv_id
"""

SQL = {"op2_url_aliases": OP2, "op8_near_dup": OP8, "op10_decontaminate": OP10, "op11_reply_trees": OP11}
