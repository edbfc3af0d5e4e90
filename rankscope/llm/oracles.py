"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_CALLS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_PROSE = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score
      from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score from s
window w as (partition by query_id order by score desc, vec_id) qualify rank <= 20"""

OP3 = f"""
with d as (select doc_id, {_CALLS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 11)) as p, w from d where len(w) >= 13),
keyed as (select doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) as k from win),
firsts as (select k, min(doc_id) as f from keyed group by k),
gone as (select doc_id, p + j as p from keyed join firsts using (k), range(13) as r(j) where f < doc_id group by all),
lists as (select doc_id, list(p) as g from gone group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(len(g), 0) as n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(g, []), i)), ' ')) as kept_sha256
from d left join lists using (doc_id)"""

OP6 = f"""
with b as (select item_id, {_PROSE.format(_FOLD)} as w from benchmark),
win as (select distinct item_id, array_to_string(w[p:p + 9], ' ') as k, least(len(w), 10) as n
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0)),
d as (select doc_id, {_PROSE.format(_FOLD)} as w from documents),
sizes as (select distinct n from win),
spots as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as p, w from d, sizes where len(w) >= n),
hits as (select doc_id, p, s.n, item_id from (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as k from spots) s
         join win on win.n = s.n and win.k = s.k),
words as (select doc_id, count(distinct p + j) as n_hit from hits, range(10) as r(j) where j < n group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items,
                 array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from hits group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

_STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP8 = f"""
with lines as (select doc_id, line, i, translate({_STRIP.format("line")}, '{_UPPER}', '{_LOWER}') as k
               from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i
                     from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
firsts as (select k, min(doc_id) as f from lines where length(k) >= 10 group by k),
marked as (select doc_id, line, i, f is not null and f < doc_id as gone from lines left join firsts using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id"""

OP11 = rf"""
with pieces as (select row_number() over () as p, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
                from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]')) as piece from documents)),
words as (select p, lang, generate_subscripts(w, 1) as i, unnest(w) as x from pieces),
runs as (select lang, x, lead(x) over s as y, lead(x, 2) over s as z from words window s as (partition by p order by i)),
total as (select lang, count(*) as n from runs group by lang),
f as (select lang, x as phrase, 1 as m, x, '' as y, '' as z, count(*) as a from runs group by all
      union all select lang, x || ' ' || y, 2, x, y, '', count(*) from runs where y is not null group by all
      union all select lang, x || ' ' || y || ' ' || z, 3, x, y, z, count(*) from runs where z is not null group by all),
c as (select * from f where m > 1 and a >= 10),
cuts as (select lang, phrase, m, a, 1 as k, x as l, case m when 2 then y else y || ' ' || z end as r from c
         union all select lang, phrase, m, a, 2, x || ' ' || y, z from c where m = 3),
scored as (select cuts.lang, cuts.phrase, cuts.m, cuts.a, k, fl.a as l, fr.a as r,
                  cast((1000000 * cast(cuts.a as hugeint) * cuts.a) // (cast(fl.a as hugeint) * fr.a) as bigint) as score
           from cuts join f fl on fl.lang = cuts.lang and fl.phrase = cuts.l join f fr on fr.lang = cuts.lang and fr.phrase = cuts.r),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, phrase, max(a) as a from (select lang, x || ' ' || y as phrase, a from c where m = 3
                                                  union all select lang, y || ' ' || z, a from c where m = 3) group by all),
kept as (select low.* from low left join inside on inside.lang = low.lang and inside.phrase = low.phrase and low.m = 2
         where inside.a is null or 100 * inside.a < 50 * low.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join total using (lang) qualify rank <= 2000"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP13 = rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {_WORDS} as w from documents),
firsts as (select text, min(doc_id) as f from d group by text),
marked as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
cells as (select part,
                 (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
                 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
                 + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(f < doc_id, false)::int as cell,
                 coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as bad
          from d join firsts using (text) left join marked using (doc_id)),
c as (select part, cell, count(*) as n, count(*) filter (good) as good, count(*) filter (bad) as bad from cells group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as b),
o as (select f1.x || f2.x || f3.x || f4.x || f5.x as filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] as bs
      from f f1, f f2, f f3, f f4, f f5 where f1.b + f2.b + f3.b + f4.b + f5.b = 31 and (f1.b | f2.b | f3.b | f4.b | f5.b) = 31),
s as (select filter_order, cast(step as int) as step, bs[step] as own, cast(coalesce(list_sum(bs[1:step - 1]), 0) as int) as earlier from o, range(1, 6) as r(step)),
t as (select part, filter_order, step, own,
             sum(n) filter (cell & (own + earlier) = 0) as kept, sum(n) filter (cell & own > 0 and cell & earlier = 0) as removed,
             sum(n) filter (cell & own > 0 and cell & earlier > 0) as redundant, sum(n) filter (cell = own) as unique_fails,
             sum(good) filter (cell & own > 0 and cell & earlier = 0) as good_lost, sum(bad) filter (cell & own > 0 and cell & earlier = 0) as toxic_lost
      from c, s group by all)
select part, filter_order, step, {", ".join(f"cast(coalesce({x}, 0) as bigint) as {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley
from t"""

ORACLE = {"op2_similar_profiles": OP2, "op3_repeated_passages": OP3, "op6_benchmark_calls": OP6, "op8_repeated_calls": OP8,
          "op11_call_phrases": OP11, "op13_filter_audit": OP13}
