"""SQL for the registered queries of the training-data operators, where SQL can express them."""

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_format"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) as bigint) as formatted_chars
from turns group by conv_id
"""

#: Sets, links and the smallest reachable id; links are found through common shingles.
ORACLES["op2_ngram_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(0), '', 'g'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end as sh from w),
n as (select doc_id, len(sh) as n from s),
t as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from n union select r.a, e.b from reach r join both_ways e on r.b = e.a)
select n.doc_id, cast(n.n as bigint) as n_shingles, r.low as component_id, cl.low as class_id
from n join (select a, min(b) as low from reach group by a) r on r.a = n.doc_id
join (select doc_id, min(doc_id) over (partition by case when len(sh) = 0 then cast(doc_id as varchar) else array_to_string(list_sort(sh), chr(10)) end) as low from s) cl
  on cl.doc_id = n.doc_id
"""

ORACLES["op4_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
judged as (select *, length(k) >= 10 and doc_id > min(doc_id) over (partition by k) as gone from keyed)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

ORACLES["op6_quality_rules"] = r"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    string_split(coalesce(text, ''), chr(10)) as ls from documents),
grams as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) as i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from grams) where c > 1),
covered as (select doc_id, count(distinct i + j) as n from twice, (select unnest(range(0, 8)) as j) group by doc_id),
c as (
  select w.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, len(ls) as n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z0-9\x{80}-\x{10FFFF}]'))) as n_wordlike,
    coalesce(list_max(map_values(list_aggregate(ws, 'histogram'))), 0) as n_top_word,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09\x0B-\x0D]*([-*]|\x{2022})'))) as n_bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09\x0B-\x0D]*$'))) as n_ellipses
  from w left join covered using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 15 * n_words or word_chars > 15 * n_words or 2 * word_chars < 3 * n_words
    or 100 * n_dup_lines > 50 * n_lines or 2 * n_wordlike < n_words
    or 100 * n_top_word > 30 * n_words or 100 * n_bullets > 90 * n_lines or 100 * n_ellipses > 30 * n_lines) as kept
from f
"""

ORACLES["op7_decontaminate"] = r"""
with t as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
w as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from t),
s as (select kind, id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) as g
  from w where len(ws) >= 5),
n as (select id, count(*) as n_item from s where kind = 'b' group by id),
p as (select d.id as doc_id, b.id as item_id, count(*) as n_shared from s d join s b on d.g = b.g and d.kind = 'd' and b.kind = 'b' group by 1, 2)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from p join n on n.id = p.item_id
where 100 * n_shared >= 80 * n_item
"""

ORACLES["op5_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as top from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < top then top end as refers_to
from d
"""

ORACLES["op12_phrase_mining"] = r"""
with pieces as (
  select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
total as (select lang, cast(sum(len(ws)) as bigint) as n from pieces group by lang),
grams as (
  select lang, ws[i:i + k - 1] as g from (
    select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from pieces, (select unnest(range(1, 6)) as k) where len(ws) >= k)),
f as (select lang, g, count(*) as f from grams group by lang, g having count(*) >= 100),
c as (select * from f where len(g) > 1),
cuts as (select c.lang, c.g, c.f as a, k, x.f as l, y.f as r, n, 1000::hugeint * c.f * n // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, len(g))) as k from c) c join total using (lang)
  join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:]),
low as (select *, row_number() over (partition by lang, g order by score, k) as p from cuts),
inside as (select lang, g[i:i + k - 1] as g, max(f) as longer from (
    select lang, g, f, k, unnest(range(1, len(g) - k + 2)) as i from c, (select unnest(range(2, 5)) as k) where len(g) > k) group by 1, 2),
kept as (select low.*, array_to_string(low.g, ' ') as phrase from low left join inside on inside.lang = low.lang and inside.g = low.g
  where p = 1 and not coalesce(100 * longer >= 100 * a, false)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked where rank <= 2000
"""
