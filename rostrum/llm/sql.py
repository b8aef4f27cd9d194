"""DuckDB SQL for the queries that SQL can express."""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str) -> str:
    return f"regexp_extract_all({_LOWER.format(column)}, '{_WORD}')"


NGRAM_JACCARD = f"""
with recursive w as (select doc_id, {_words("text")} as ws from documents),
s as (select doc_id, ws, len(ws) as n, array_to_string(ws, ' ') as seq from w),
c as (select seq, min(doc_id) as rep, count(*) as copies, any_value(ws) as ws from s where n > 0 group by seq),
g as (select rep, unnest(list_distinct(case when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) as g from c),
k as (select rep, count(*) as k from g group by rep),
p as (select a.rep as x, b.rep as y, count(*) as i from g a join g b on a.g = b.g and a.rep <> b.rep group by 1, 2),
l as (select x, y from p join k kx on kx.rep = x join k ky on ky.rep = y where i >= 0.8 * (kx.k + ky.k - i) - 1e-9),
r(x, y) as (select rep, rep from c union select r.x, l.y from r join l on r.y = l.x),
root as (select x, min(y) as class_id from r group by x),
size as (select class_id, sum(copies) as class_size from root join c on c.rep = root.x group by class_id),
deg as (select x, sum(copies) as d from l join c on c.rep = l.y group by x)
select s.doc_id, coalesce(root.class_id, s.doc_id) as class_id, cast(coalesce(size.class_size, 1) as bigint) as class_size,
       cast(coalesce(deg.d, 0) + coalesce(c.copies - 1, 0) as bigint) as n_links,
       cast(case when s.n = 0 then 0 else greatest(s.n - 4, 1) end as bigint) as n_grams
from s left join c on s.seq = c.seq and s.n > 0 left join root on root.x = c.rep
left join size on size.class_id = root.class_id left join deg on deg.x = c.rep
"""

DECONTAMINATION = f"""
with w as (select doc_id, {_words("text")} as ws from documents),
i as (select cast(item_id as varchar) as item_id, {_words("text")} as ws from benchmark),
iw as (select distinct item_id, least(13, len(ws)) as m,
        unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda s: array_to_string(ws[s:s + least(13, len(ws)) - 1], ' '))) as win
       from i where len(ws) > 0),
sizes as (select distinct m from iw),
dw as (select doc_id, m, unnest(range(1, len(ws) - m + 2)) as s, ws from w, sizes where len(ws) >= m),
hit as (select d.doc_id, d.s, d.m, iw.item_id from (select doc_id, m, s, array_to_string(ws[s:s + m - 1], ' ') as win from dw) d join iw using (m, win)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from hit) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join n using (doc_id) left join t using (doc_id)
"""

CHAT_FORMAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) as bigint) as formatted_chars
from t group by conv_id
"""

LINE_DEDUP = r"""
with l as (select row_number() over () as row, page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') as host,
  list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'),
    '</?(?:p|div|br|li|ul|ol|nav|tr|table|td|th|h[1-6]|article|section|header|footer|title|head|body|html|blockquote|pre|form|aside|main)\b[^>]*>', chr(10), 'gi'),
    '<[^>]*>', '', 'g'), '[\t\x0B\f\r ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' '), chr(10)), lambda x: x <> '') as lines from pages),
h as (select host, count(*) as host_pages from l group by host),
c as (select host, line, count(*) as n from (select distinct row, host, unnest(lines) as line from l) group by 1, 2),
bad as (select host, line from c join h using (host) where n > 1 and n > 0.3 * host_pages),
e as (select row, l.host, u.line, u.pos from l, unnest(lines) with ordinality as u(line, pos)),
k as (select e.row, string_agg(e.line || chr(10), '' order by e.pos) as text, count(*) as n from e left join bad on bad.host = e.host and bad.line = e.line
      where bad.line is null group by e.row)
select page_id, host, host_pages, cast(len(lines) as bigint) as n_lines, cast(len(lines) - coalesce(n, 0) as bigint) as n_dropped,
       sha256(coalesce(text, '')) as kept_sha256
from l join h using (host) left join k using (row)
"""

FILTER_AUDIT = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
f as (select doc_id, part,
  (case when len(ws) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end)
  || (case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) then 'C' else '' end) || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
  || (case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end) as fails from d),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
b as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f left join l using (doc_id) group by part, fails),
x(c) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select filter_order, step, filter_order[step] as letter from o, (select unnest(range(1, 6)) as step)),
p as (select part, fails, n, good, toxic, filter_order, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda c: strpos(filter_order, c))), 9) as first from b, o),
r as (select part, filter_order, step, letter, sum(case when first > step then n else 0 end) as kept, sum(case when first = step then n else 0 end) as removed,
  sum(case when contains(fails, letter) and first < step then n else 0 end) as redundant, sum(case when fails = letter then n else 0 end) as unique_fails,
  sum(case when first = step then good else 0 end) as good_lost, sum(case when first = step then toxic else 0 end) as toxic_lost
  from p join s using (filter_order) group by part, filter_order, step, letter)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley from r
"""

LEXICAL_SEARCH = r"""
with w as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
a as (select cast(count(*) as bigint) as nn, cast(sum(len(ws)) as bigint) as ll from w where len(ws) > 0),
t as (select row, doc_id, len(ws) as n, unnest(ws) as term from w),
p as (select row, doc_id, n, term, count(*) as tf from t semi join q using (term) group by row, doc_id, n, term),
df as (select term, count(*) as df from p group by term),
e as (select term, cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) as bigint) as weight from df, a),
v as (select row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) as v from p join e using (term), a),
s as (select item_id, row, doc_id, sum(v) as score from q join v using (term) group by item_id, row, doc_id having sum(v) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last, row) as int) as rank, doc_id, cast(score as bigint) as score
from s qualify rank <= 10
"""


def _license_sql() -> str:
    from rostrum.llm.license_scan import ORDERED, PHRASES, SHORT_FORMS, TEMPLATES, THRESHOLD, rivals, spelled

    known = spelled(TEMPLATES)
    texts = lambda values: f"[{', '.join(repr(w) for w in values)}]"
    rows = [f"({i}, '{t.label}', {len(t.words)}, {texts(t.distinct)}, {t.need(THRESHOLD)}, {texts(' '.join(p) for p in t.pairs)})" for i, t in enumerate(known)]
    against = ", ".join(f"({i}, {j})" for i, others in enumerate(rivals(known)) for j in others)
    phrases = ", ".join([*(f"('{label}', {texts(p.split())}, true)" for p, label in PHRASES.items()), *(f"('{t.label}', {texts(t.words)}, false)" for t in spelled(SHORT_FORMS))])
    return f"""
with w as (select row_number() over () as row, doc_id, {_words("text")} as ws from documents),
t(t, label, n, ts, need, ps) as (values {", ".join(rows)}),
against(t, u) as (values {against}),
p(label, ps, base) as (values {phrases}),
places as (select row, label, base, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + len(ps)] = ps)) as i
         from w, p where list_contains(ws, ps[1])),
b as (select row, count(distinct i) filter (base) as n_base, min(i) filter (base) as first_word, max(i) filter (base) as last_word,
  coalesce(list(distinct label) filter (base), []) as base_ls, list(distinct label) as ls from places group by row),
k as (select row, t.*, unnest(range(0, (len(ws) + n - 1) // n)) as k, ws from w, t where len(list_intersect(ws, ts)) >= need),
c as (select * exclude (ws), ws[k * n + 1:k * n + 2 * n] as block from k),
m as (select row, t, label, n, k, len(list_intersect(list_distinct(block), ts)) as o, len(ts) as s,
        len(list_intersect(list_distinct(list_transform(range(1, len(block)), lambda i: block[i] || ' ' || block[i + 1])), ps)) >= ceil({ORDERED} * len(ps) - 1e-9) as ordered from c
      where len(list_intersect(list_distinct(block), ts)) >= need),
beaten as (select distinct a.row, a.t, a.k from m a join against on against.t = a.t join m b on b.t = against.u and b.row = a.row
   where a.ordered and b.ordered and b.k * b.n < (a.k + 2) * a.n and a.k * a.n < (b.k + 2) * b.n and (b.o / b.s > a.o / a.s or (b.o / b.s = a.o / a.s and b.o > a.o))),
best as (select row, list(distinct label) as ls from (select * from m where ordered) anti join beaten using (row, t, k) group by row),
g as (select row, count(*) as n, list(distinct label) as ls, max(o / s) as share from m group by row)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.base_ls), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(g.ls, [])))), ','), '') as labels,
  cast(case when len(b.ls) > 0 then 1 else coalesce(share, 0) end as double) as score, cast(coalesce(g.n, 0) as bigint) as n_matches,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(best.ls, [])))), ','), '') as best_labels
from w left join b using (row) left join g using (row) left join best using (row)
"""


LICENSE_SCAN = _license_sql()
