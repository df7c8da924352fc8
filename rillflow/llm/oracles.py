"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""with w as (select doc_id, lang, source, coalesce(text, '') as t, {WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
three as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
keyed as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from three),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from keyed) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(3) r(k) group by 1),
m as (select w.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words from w left join covered c on c.doc_id = w.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
r as (select doc_id, base_failed, lang, source, unnest(['word_chars_k', 'symbols_k', 'dup_lines_k', 'repeats_k']) as rate, unnest([word_chars, n_symbols, n_dup_lines, n_repeat_words]) as c, unnest([n_words, n_words, n_lines, n_words]) as n from b),
v as (select *, 1000 * c // greatest(n, 1) as v from r where not base_failed),
bins as (select *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as bin from v),
grp as (select distinct lang, source, rate from bins),
grid as (select g.lang, g.source, g.rate, a.bin, a.n as a, coalesce(l.n, 0) as l, coalesce(o.n, 0) as g from grp g join (select rate, bin, count(*) as n from bins group by all) a on a.rate = g.rate
  left join (select lang, rate, bin, count(*) as n from bins group by all) l on l.rate = g.rate and l.bin = a.bin and l.lang is not distinct from g.lang
  left join (select lang, source, rate, bin, count(*) as n from bins group by all) o on o.rate = g.rate and o.bin = a.bin and o.lang is not distinct from g.lang and o.source is not distinct from g.source),
cum as (select lang, source, rate, bin, (sum(a) over w)::double as a, (sum(l) over w)::double as l, (sum(g) over w)::double as g, (sum(a) over t)::double as ta, (sum(l) over t)::double as tl, (sum(g) over t)::double as tg from grid
  window w as (partition by lang, source, rate order by bin), t as (partition by lang, source, rate)),
f as (select *, (g + 100::double * ((l + 100::double * (a / ta)) / (tl + 100::double))) / (tg + 100::double) as f from cum),
m1 as (select rate, sum(bin)::double as s, count(*)::double as n from bins group by all),
m2 as (select lang, rate, sum(bin)::double as s, count(*)::double as n from bins group by all),
m3 as (select lang, source, rate, sum(bin)::double as s, count(*)::double as n from bins group by all),
mean as (select m3.lang, m3.source, m3.rate, (m3.s + 100::double * ((m2.s + 100::double * (m1.s / m1.n)) / (m2.n + 100::double))) / (m3.n + 100::double) as mean from m3 join m2 on m2.rate = m3.rate and m2.lang is not distinct from m3.lang join m1 on m1.rate = m3.rate),
q as (select lang, source, rate, min(bin) filter (where f >= 0.1::double) as q1, min(bin) filter (where f >= 0.5::double) as q5, min(bin) filter (where f >= 0.9::double) as q9 from f group by all),
d as (select r.doc_id, r.rate, c, 1000 * c - greatest((q9 + 4 * (q9 - q5))::double, mean) * n as over, (q1 - 4 * (q5 - q1)) * n - 1000 * c as under from r join q on q.rate = r.rate and q.lang is not distinct from r.lang and q.source is not distinct from r.source
  join mean on mean.rate = r.rate and mean.lang is not distinct from r.lang and mean.source is not distinct from r.source),
bad as (select distinct doc_id from d where over > 0 and over::double * over::double > 9000000::double * c or rate = 'word_chars_k' and under > 0 and under::double * under::double > 9000000::double * c)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.doc_id is null as kept from b left join bad on bad.doc_id = b.doc_id"""

OP6 = """with p as (select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as own, sha1(coalesce(html, '')) as d from pages)
select page_id, strlen(h) as payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int + 1, 1)), '') as payload_digest,
case when page_id = own then 'response' else 'revisit' end as record_type, case when page_id <> own then own end as refers_to from p"""

OP9 = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from w union select r.a, l.b from reach r join links l on l.a = r.b)
select r.a as doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.b) as component_id, r.a = min(r.b) as kept from reach r left join n on n.doc_id = r.a group by r.a"""

OP10 = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
l as (select *, 10 + 2 * length(role || text) - length(translate(role || text, '\<', '')) as chars, row_number() over (partition by conv_id order by turn desc) = 1 as last from c),
u as (select *, sum(chars) over (partition by conv_id order by turn) as upto from l)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256, coalesce(sum(upto) filter (where role = 'assistant' or last), 0)::bigint as formatted_chars from u group by conv_id"""

CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, u: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::bigint)"

OP11 = f"""with t as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first) as n from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base, {CRC32.format("conv_id::varchar")} % 9 as h from (select distinct conv_id from t)),
lent as (select c.conv_id, n as d, r, x from c join t on t.conv_id = c.base and t.n <= c.h),
many as (select conv_id, count(*) as n from lent group by 1),
turns as (select * from lent union all select c.conv_id, t.n - c.h + coalesce(many.n, 0), r, x from c join t on t.conv_id = c.conv_id and t.n > c.h left join many on many.conv_id = c.conv_id),
p as (select conv_id, d, sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '') over (partition by conv_id order by d)) as k, strlen(x) as size from turns union all select conv_id, 0, '', 0 from c),
q as (select *, lag(k) over (partition by conv_id order by d) as up, d = max(d) over (partition by conv_id) as last from p),
nodes as (select d, k, any_value(up) as up, min(conv_id) as conv, count(*) as n, any_value(size) as size, sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (where last), '')) as ends from q group by d, k),
kids as (select d - 1 as d, up as k, count(*) as n from nodes where d > 0 group by 1, 2),
own as (select nodes.*, coalesce(kids.n, 0) as children from nodes left join kids on kids.d = nodes.d and kids.k = nodes.k),
below as (select p.d, p.k, sum((own.n - 1) * own.size) as saved, count(*) filter (where own.children = 0) as leaves from own join p on p.conv_id = own.conv and p.d <= own.d group by 1, 2)
select own.conv as conv_id, own.d::bigint as depth, above.conv as parent_conv_id, own.n as n_convs, own.children as n_children, below.leaves as n_leaves, below.saved::bigint as saved_tokens, own.ends as ends_sha256
from own join below on below.d = own.d and below.k = own.k left join own above on above.d = own.d - 1 and above.k = own.up"""

OP12 = rf"""with d as (select doc_id, {WORDS} as w from documents),
e as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
g as (select doc_id, i, word, list(word) over (partition by doc_id order by i rows between current row and 12 following) as g from e),
f as (select g, min(doc_id) as least from g where len(g) = 13 group by g having min(doc_id) < max(doc_id)),
c as (select distinct g.doc_id, g.i + k as i from g join f on f.g = g.g, range(13) r(k) where f.least < g.doc_id),
k as (select e.doc_id, string_agg(word, ' ' order by e.i) as kept, count(*) as n from e left join c on c.doc_id = e.doc_id and c.i = e.i where c.i is null group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k on k.doc_id = d.doc_id"""

OP13 = rf"""with d as (select doc_id, {WORDS} as w, {CRC32.format("doc_id::varchar")} as h from documents),
z as (select *, len(w) as n, h // 10 as g from d),
y as (select *, case when n > 0 then g % n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from z),
e as (select doc_id, n, i, case when h % 10 = 0 and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as word from (select *, unnest(range(n)) as i from y)),
s as (select doc_id, n, i, list(word) over (partition by doc_id order by i rows between current row and 4 following) as g from e),
k as (select doc_id, n, i, md5(array_to_string(g, ' ')) as g from s where len(g) = 5),
t as (select l.doc_id, r.i - l.i as q, l.i from k l join k r on r.doc_id = l.doc_id and r.g = l.g and r.i > l.i and 3 * (r.i - l.i) <= l.n),
u as (select doc_id, q, min(i) as b, count(*) + 4 + q as m from (select *, i - row_number() over (partition by doc_id, q order by i) as part from t) group by doc_id, q, part having count(*) + 4 + q >= greatest(24, 3 * q)),
r as (select * from u where not exists (select 1 from u v where v.doc_id = u.doc_id and v.q < u.q and v.b <= u.b and v.b + v.m >= u.b + u.m)),
best as (select *, row_number() over (partition by doc_id order by m::double / q desc, b, q) as rank from r),
told as (select doc_id, count(*) as n_runs, sha256(string_agg(b || ',' || m || ',' || q || chr(10), '' order by b, q)) as runs_sha256 from r group by 1),
gone as (select distinct doc_id, unnest(range(b + q, b + m)) as i from r),
kept as (select e.doc_id, string_agg(word, ' ' order by e.i) as text from e left join gone on gone.doc_id = e.doc_id and gone.i = e.i where gone.i is null group by 1)
select d.doc_id, coalesce(told.n_runs, 0) as n_runs, best.b::bigint as start, best.m::bigint as length, best.q::bigint as period, (1000 * best.m // best.q)::bigint as exponent_milli, coalesce(told.runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join told on told.doc_id = d.doc_id left join best on best.doc_id = d.doc_id and best.rank = 1 left join kept on kept.doc_id = d.doc_id"""

ORACLES = {"op5_quality_rules": OP5, "op6_warc": OP6, "op9_near_dedup": OP9, "op10_chat_formatting": OP10, "op11_prefix_trie": OP11, "op12_substring_dedup": OP12, "op13_periodic_runs": OP13}
