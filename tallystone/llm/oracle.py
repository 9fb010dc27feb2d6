"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RAW_WORDS = f"list_filter(regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_PLAIN_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _components(edges: str) -> str:
    """Least node that each node of ``edges(a, b)``, both ways, reaches: CTEs ending in ``comp(node, root)``."""
    return f"""links as (select a, b from {edges} union select b, a from {edges}),
reach as (select a as node, a as root from links union select l.a, r.root from links l join reach r on l.b = r.node),
comp as (select node, min(root) as root from reach group by node)"""


ORACLE_SQL = {
    "op1_line_dedup": """
with l as (select doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13)) as k from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) x),
c as (select source, k, count(distinct doc_id) as n from l where k <> '' and source is not null group by all),
t as (select source, count(*) as total from documents where source is not null group by source),
b as (select c.source, c.k from c join t on c.source = t.source where n >= 5 and n > 1e-1 * total),
j as (select l.doc_id, l.i, l.line, b.k is not null as bad from l left join b on l.source = b.source and l.k = b.k),
g as (select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where not bad), '') as text, count(*) as n, count(*) filter (where bad) as dropped from j group by doc_id)
select d.doc_id, g.text, coalesce(g.n, 0) as n_lines, coalesce(g.dropped, 0) as n_dropped from documents d left join g on d.doc_id = g.doc_id""",
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as payload from pages),
r as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as h, max(page_id) over (partition by payload) as top from p)
select page_id, payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as int), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31) + 1 as int), 1)), '') as payload_digest,
case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from r""",
    "op5_embedding_near_dedup": f"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null),
n as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
pairs as (select x.vec_id as a, y.vec_id as b from n x join n y on x.label = y.label and x.vec_id < y.vec_id where x.norm > 0 and y.norm > 0 and len(x.e) = len(y.e) and list_sum(list_transform(list_zip(x.e, y.e), lambda z: z[1] * z[2])) / (x.norm * y.norm) >= 0.93e0),
{_components("pairs")}, counts as (select a, count(*) as n from links group by a)
select v.vec_id, coalesce(k.n, 0) as n_links, coalesce(c.root, v.vec_id) as component_id, coalesce(c.root, v.vec_id) = v.vec_id as kept from embeddings v left join comp c on v.vec_id = c.node left join counts k on v.vec_id = k.a""",
    "op6_benchmark_decontamination": f"""
with iw as (select item_id, {_PLAIN_WORDS} as w from benchmark), it as (select cast(item_id as varchar) as item_id, w, least(len(w), 10) as n from iw where len(w) > 0),
win as (select item_id, n, array_to_string(w[i:i + n - 1], ' ') as span from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from it) x),
dw as (select doc_id, {_PLAIN_WORDS} as w from documents),
runs as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as span from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from it) s where len(w) >= n) x),
hits as (select r.doc_id, r.i, r.n, w.item_id from runs r join win w on r.n = w.n and r.span = w.span),
words as (select doc_id, count(distinct i + k) as n_hit from (select doc_id, i, unnest(range(0, n)) as k from (select distinct doc_id, i, n from hits) y) x group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits where item_id is not null) x group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items, sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from dw d left join words h on d.doc_id = h.doc_id left join items i on d.doc_id = i.doc_id""",
    "op7_ngram_jaccard_join": f"""
with recursive w as (select doc_id, {_RAW_WORDS} as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
t as (select doc_id, len(s) as n, unnest(s) as g from s),
pairs as (select x.doc_id as a, y.doc_id as b from t x join t y on x.g = y.g and x.doc_id < y.doc_id where least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 90 group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
{_components("pairs")}, counts as (select a, count(*) as n from links group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.root, s.doc_id) as component_id, coalesce(k.n, 0) as n_links from s left join comp c on s.doc_id = c.node left join counts k on s.doc_id = k.a""",
    "op8_suffix_array_dedup": f"""
with w as (select doc_id, {_RAW_WORDS} as w from documents),
r as (select doc_id, i - 1 as p, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w) x),
k as (select h, min(doc_id) as lo, max(doc_id) as hi from r group by h having min(doc_id) <> max(doc_id)),
m as (select r.doc_id, r.p, k.lo, k.hi from r join k on r.h = k.h),
o as (select *, case when p > lag(p, 1, -51) over (partition by doc_id order by p) + 50 then 1 else 0 end as fresh from m),
g as (select *, sum(fresh) over (partition by doc_id order by p) as part from o),
a as (select doc_id, part, min(p) as first_word, max(p) + 50 - min(p) as n_words, arg_min(lo, p) as lo, arg_min(hi, p) as hi from g group by doc_id, part)
select doc_id, first_word, n_words, case when doc_id = lo then hi else lo end as other_doc_id from a""",
    "op12_phrase_collocations": f"""
with d as (select row_number() over () as id, coalesce(lang, 'und') as lang, regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]') as ps from documents),
p as (select id, lang, unnest(ps) as piece, generate_subscripts(ps, 1) as j from d),
w as (select id, lang, j, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
x as (select id, lang, j, unnest(w) as w1, generate_subscripts(w, 1) as i from w),
y as (select lang, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3, lead(w1, 3) over o as w4 from x window o as (partition by id, j order by i)),
g as (select lang, 1 as n, w1 as phrase from y union all select lang, 2, w1 || ' ' || w2 from y where w2 is not null union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from y where w3 is not null union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from y where w4 is not null),
f as (select lang, n as words, phrase, count(*) as a from g group by all),
t as (select lang, sum(a) as n from f where words = 1 group by lang),
c as (select *, string_split(phrase, ' ') as w from f where words > 1 and a >= 30),
cuts as (select lang, phrase, a, k, lang || chr(1) || array_to_string(w[1:k], ' ') as l_key, lang || chr(1) || array_to_string(w[k + 1:], ' ') as r_key from (select *, unnest(range(1, words)) as k from c) x),
keyed as (select lang || chr(1) || phrase as key, a as n from f where a >= 30),
s as (select lang, phrase, a, k, x.n as l, y.n as r, cast(a as hugeint) * 2000000 // (x.n + y.n) as score from cuts join keyed x on x.key = l_key join keyed y on y.key = r_key),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as rn from s) x where rn = 1),
sub as (select lang, phrase, max(a) as longer from (select lang, a, array_to_string(w[i:i + n - 1], ' ') as phrase from (select *, unnest(range(1, words - n + 2)) as i from c, (values (2), (3)) v(n) where n < words) x) y group by all),
k as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank from b left join sub on b.lang = sub.lang and b.phrase = sub.phrase where not coalesce(100 * cast(longer as hugeint) >= 80 * cast(a as hugeint), false))
select k.lang, cast(rank as bigint) as rank, k.phrase, k.a, l, r, cast(t.n as bigint) as n, cast(score as bigint) as score from k join t on k.lang = t.lang where rank <= 2000""",
}
