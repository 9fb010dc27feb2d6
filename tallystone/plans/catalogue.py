"""One query for each operator of the library over the driver tables, and the DuckDB SQL for the same rows."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import text as tx
from tallystone.functions import json_text as js
from tallystone.functions.json_text import or_default, strict_json
from tallystone.operators import extraction as ex
from tallystone.operators import monitoring as mon
from tallystone.operators import relational as rel
from tallystone.operators import retrieval as ret
from tallystone.plans.views import table, view, with_views
from tallystone.schema import ALERT_ROLES, BASELINE_TYPES, GATES, MASTER_TYPES, MONITORING_TYPES, PROJECT_STEPS, REQUEST_STEPS, RESOLVER_ROLES
from tallystone.sources import answers, changelog, files, filters, postings, store, vectors
from tallystone.sources.shared import folder, settle
from tallystone.streaming import documents, ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PROJECT, USER, NEW_PROJECT, ACTOR = 5, 7, 1000, 9
#: A query for retrieval; repeated words count.
QUERY = "the then la de the erthan"
_TERMS = "(values ('the', 2), ('then', 1), ('la', 1), ('de', 1), ('erthan', 1))"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


# Lookups and joins


@query("select id, name, role from v_users")
def scan_users(spark, d):
    return view(spark, d, "v_users")


@query(f"select id, name, role from v_users where id <> {USER}")
def users_except(spark, d):
    return view(spark, d, "v_users").where(F.col("id") != USER)


@query("select id, project_id, document_type, document_name from v_documents where id = 3 and project_id = 3")
def doc_by_key(spark, d):
    return view(spark, d, "v_documents").where("id = 3 and project_id = 3").select("id", "project_id", "document_type", "document_name")


@query(f"select id, document_name, document_type from v_documents where project_id = {PROJECT}")
def project_documents(spark, d):
    return view(spark, d, "v_documents").where(F.col("project_id") == PROJECT).select("id", "document_name", "document_type")


@query(f"select p.id, p.project_name from v_projects p where exists (select 1 from v_users u where u.id = {USER} and u.role = 'ADMIN') or p.id in (select project_id from v_project_users where user_id = {USER})")
def visible_projects(spark, d):
    return rel.visible_projects(view(spark, d, "v_projects"), view(spark, d, "v_project_users"), view(spark, d, "v_users"), USER)


@query(f"select u.id, u.name, u.role from v_users u join v_project_users m on u.id = m.user_id where m.project_id = {PROJECT}")
def project_members(spark, d):
    return rel.members(view(spark, d, "v_users"), view(spark, d, "v_project_users"), PROJECT)


@query(f"select id, name, role from v_users where id in (select user_id from v_project_users where project_id = {PROJECT})")
def members_semi(spark, d):
    return rel.members_semi(view(spark, d, "v_users"), view(spark, d, "v_project_users"), PROJECT)


@query("select distinct s_nationkey as project_id, s_suppkey as user_id from supplier s where not exists (select 1 from v_project_users m where m.project_id = s.s_nationkey and m.user_id = s.s_suppkey)")
def insert_if_absent(spark, d):
    incoming = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("user_id"))
    return rel.absent(incoming, view(spark, d, "v_project_users"), ["project_id", "user_id"])


@query(f"select cast({NEW_PROJECT} as int) as project_id, u.id as user_id from v_users u where not exists (select 1 from v_project_users m where m.project_id = {NEW_PROJECT} and m.user_id = u.id)")
def membership_fanout(spark, d):
    return rel.fan_out(view(spark, d, "v_users"), view(spark, d, "v_project_users"), NEW_PROJECT)


@query("select id, document_type, case when document_type in ('EL', 'IFA') then 'BASELINE' else 'MONITORING' end as gate from v_documents where document_type in ('EL', 'IFA', 'STATUS_REPORT', 'MOM')")
def doc_type_gate(spark, d):
    kind = F.col("document_type")
    rows = view(spark, d, "v_documents").where(kind.isin(BASELINE_TYPES + MONITORING_TYPES))
    return rows.select("id", "document_type", F.when(kind.isin(BASELINE_TYPES), "BASELINE").otherwise("MONITORING").alias("gate"))


_NAMES = "concat('file', cast(doc_id as string), case doc_id % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.TXT' else '.md' end)"


@query(f"select doc_id, lower(regexp_extract(name, '[^./][^/]*(\\.[^./]*)$', 1)) as ext, lower(regexp_extract(name, '[^./][^/]*(\\.[^./]*)$', 1)) in ('.pdf', '.docx', '.txt') as accepted from (select doc_id, {_NAMES.replace('string', 'varchar')} as name from documents) t")
def ext_gate(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(_NAMES).alias("name"))
    return rows.select("doc_id", tx.extension(F.col("name")).alias("ext"), files.accepted(F.col("name")).alias("accepted"))


_MASTER = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in MASTER_TYPES)


@query(f"select * from (values {_MASTER}) t(name, label, description) union all select c_mktsegment as name, c_mktsegment as label, cast(null as varchar) as description from (select distinct c_mktsegment from customer) c")
def doc_types_union(spark, d):
    own = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_mktsegment").alias("label"), F.lit(None).cast("string").alias("description")).distinct()
    return spark.createDataFrame(MASTER_TYPES, "name string, label string, description string").unionByName(own)


@query("select project_id, id, status, version from (select *, row_number() over (partition by project_id order by version desc) rn from v_baselines) t where rn = 1")
def latest_version(spark, d):
    return rel.latest(view(spark, d, "v_baselines"), "project_id", F.desc("version"))


@query("select project_id, id, status, version from (select *, row_number() over (partition by project_id order by id desc) rn from v_baselines where status = 'APPROVED') t where rn = 1")
def latest_approved(spark, d):
    return rel.latest(view(spark, d, "v_baselines").where("status = 'APPROVED'"), "project_id", F.desc("id"))


@query("select b.project_id, b.id, case when b.id = l.draft_id then 'APPROVED' else b.status end as status, b.version from v_baselines b left join (select project_id, max(id) as draft_id from v_baselines where status = 'DRAFT' group by project_id) l on b.project_id = l.project_id")
def status_latest(spark, d):
    return rel.approve_latest_draft(view(spark, d, "v_baselines"))


@query("select o.o_orderkey as baseline_id, coalesce(i.n, 0) as n_items, coalesce(e.n, 0) as n_deliverables from orders o left join (select l_orderkey, count(*) n from lineitem where l_returnflag = 'A' group by 1) i on o.o_orderkey = i.l_orderkey left join (select l_orderkey, count(*) n from lineitem where l_returnflag <> 'A' group by 1) e on o.o_orderkey = e.l_orderkey")
def baseline_counts(spark, d):
    lines = table(spark, d, "lineitem")
    both = lines.groupBy(F.col("l_orderkey").alias("baseline_id")).agg(F.count_if(F.col("l_returnflag") == "A").alias("n_items"), F.count_if(F.col("l_returnflag") != "A").alias("n_deliverables"))
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("baseline_id")).join(both, "baseline_id", "left")
    return out.na.fill(0, ["n_items", "n_deliverables"])


@query("select b.project_id, b.id as baseline_id, coalesce(i.items, '') as items, coalesce(e.deliverables, '') as deliverables from (select * from (select *, row_number() over (partition by project_id order by id desc) rn from v_baselines where status = 'APPROVED') t where rn = 1) b left join (select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_partkey) items from lineitem where l_returnflag = 'A' group by 1) i on b.id = i.l_orderkey left join (select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_partkey) deliverables from lineitem where l_returnflag <> 'A' group by 1) e on b.id = e.l_orderkey")
def baseline_nested(spark, d):
    parents = latest_approved(spark, d).select("project_id", F.col("id").alias("baseline_id"))
    lines = table(spark, d, "lineitem")
    items, deliverables = ((lines.where(w), "l_orderkey", F.col("l_partkey")) for w in ("l_returnflag = 'A'", "l_returnflag <> 'A'"))
    out = rel.nest(parents, "baseline_id", items=items, deliverables=deliverables)
    return out.select("project_id", "baseline_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("items", "deliverables")))


_TRACKER = f"select ti.*, case when ti.item_type = 'ACTIVITY' then a.activity_name else r.request_name end as item_name, d.document_name from v_tracker ti left join v_activities a on ti.item_type = 'ACTIVITY' and ti.reference_id = a.id left join v_requests r on ti.item_type = 'NEW_REQUEST' and ti.reference_id = r.id left join v_documents d on ti.source_document_id = d.id where ti.project_id = {PROJECT} order by ti.risk_score desc"


@query(_TRACKER)
def tracker_view(spark, d):
    items = view(spark, d, "v_tracker").where(F.col("project_id") == PROJECT)
    return rel.tracker_view(items, view(spark, d, "v_activities"), view(spark, d, "v_requests"), view(spark, d, "v_documents")).orderBy(F.desc("risk_score"))


@query("select * from (select project_id, id, event_type, cast(row_number() over (partition by project_id order by created_at desc, id desc) as bigint) rn from v_events) t where rn <= 20")
def recent_events(spark, d):
    out = rel.newest(view(spark, d, "v_events"), "project_id", mon.RECENT, F.desc("created_at"), F.desc("id"))
    return out.select("project_id", "id", "event_type", F.col("rn").cast("long").alias("rn"))


_DIGEST = "select project_id, string_agg('- [' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '] ' || event_type || ': ' || coalesce(event_summary, ''), chr(10) order by rn) as digest from (select *, row_number() over (partition by project_id order by created_at desc, id desc) rn from v_events) t where rn <= 20 group by project_id"


@query(_DIGEST)
def event_digest(spark, d):
    return mon.event_lines(view(spark, d, "v_events"))


@query("select project_id, count(*) as n_events, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as oldest, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as newest from v_events group by project_id")
def compaction_stats(spark, d):
    out = mon.compaction_stats(view(spark, d, "v_events"))
    return out.select("project_id", "n_events", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("oldest", "newest")))


# Chunks and tokens

_CHUNKS = "select doc_id, project_id, cast(row_number() over (partition by doc_id order by i) - 1 as bigint) as chunk_index, ch as text from (select id as doc_id, project_id, i, substring(text, cast(i + 1 as int), 1000) ch from (select id, project_id, text, unnest(range(0, length(text), 800)) i from v_documents) x) y where regexp_matches(ch, '\\S')"


@query(f"select doc_id, chunk_index, text from ({_CHUNKS}) c")
def chunk_docs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("i", "text"))
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_index"), "text")


@query(f"select 'proj_' || project_id || '_doc_' || doc_id || '_chunk_' || chunk_index as chunk_id, project_id, doc_id as document_id, cast(-1 as int) as page_number, chunk_index, cast(length(text) as bigint) as n_chars from ({_CHUNKS}) c")
def chunk_catalog(spark, d):
    rows = view(spark, d, "v_documents").select("project_id", F.col("id").alias("document_id"), F.lit(0).alias("page_number"), F.posexplode(tx.chunks(F.col("text"))).alias("i", "text"))
    out = store.catalogue(rows.withColumn("chunk_index", F.col("i").cast("long")))
    return out.select("chunk_id", "project_id", "document_id", "page_number", "chunk_index", F.length("text").cast("long").alias("n_chars"))


@query("select doc_id, page_number, cast(row_number() over (partition by doc_id order by page_number, i) - 1 as bigint) as chunk_index, ch as text from (select doc_id, page_number, i, substring(line, cast(i + 1 as int), 1000) ch from (select doc_id, page_number, line, unnest(range(0, length(line), 800)) i from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as page_number from documents) p where regexp_matches(line, '\\S')) x) y where regexp_matches(ch, '\\S')")
def chunk_pages(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).withColumn("page_number", (F.col("p") + 1).cast("long"))
    out = files.page_chunks(pages, "doc_id")
    return out.select("doc_id", "page_number", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query("select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where regexp_matches(line, '\\S')), '') as text from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) t group by doc_id")
def docx_join(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(F.split("text", "\n", -1), tx.not_blank), "\n").alias("text"))


@query("select doc_id, substring(text, 1, 8000) as text from documents")
def prefix_8000(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.prompt_prefix(F.col("text")).alias("text"))


_TOK = "tok as (select source, doc_id, t from (select source, doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) t from documents) x where t <> '')"


@query(f"with {_TOK} select source, t, count(distinct doc_id) as df from tok group by source, t")
def token_df(spark, d):
    return ret.document_frequency(table(spark, d, "documents"))


@query(f"with {_TOK} select source, count(*) as n, round(avg(dl), 6) as avgdl from (select source, doc_id, count(*) dl from tok group by all) t group by source")
def corpus_stats(spark, d):
    return ret.corpus_stats(table(spark, d, "documents")).withColumn("avgdl", F.round("avgdl", 6))


# Ranking

_BM25 = f"""tf as (select source, doc_id, t, count(*) tf from tok group by all), dl as (select source, doc_id, count(*) dl from tok group by all),
st as (select source, count(*) n, avg(dl) avgdl from dl group by source), q as (select * from {_TERMS} v(t, qtf)),
raw as (select tf.source, tf.t, ln(max(n) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) i0 from tf join st on tf.source = st.source group by tf.source, tf.t),
ep as (select source, 0.25e0 * avg(i0) eps from raw group by source),
s as (select tf.source, tf.doc_id, sum(qtf * (case when i0 < 0 then eps else i0 end) * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))) score from tf join q on tf.t = q.t join raw on raw.source = tf.source and raw.t = tf.t join ep on ep.source = tf.source join dl on dl.source = tf.source and dl.doc_id = tf.doc_id join st on st.source = tf.source group by tf.source, tf.doc_id)"""


@query(f"with {_TOK}, {_BM25} select source, doc_id, rn as rank, round(score, 6) as score from (select *, cast(row_number() over (partition by source order by round(score, 9) desc, doc_id) as bigint) rn from s where score > 0) t where rn <= 10")
def bm25_topk(spark, d):
    scored = ret.bm25(table(spark, d, "documents"), QUERY).withColumn("exact", F.col("score")).withColumn("score", F.round("score", 9))
    return ret.top(scored, "doc_id", 10, by="source").select("source", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("exact", 6).alias("score"))


_VECTOR = [0.125 if i % 2 else -0.125 for i in range(64)]
_DIST = f"list_sum(list_transform(list_zip(embedding, {_VECTOR}), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double))))"


def _dense_sql(where: str = "true") -> str:
    return f"select vec_id, round(distance, 6) as distance, cast(row_number() over (order by round(distance, 9), vec_id) as bigint) as rank from (select vec_id, {_DIST} as distance from embeddings where {where}) t order by round(distance, 9), vec_id limit 10"


def _dense(spark, d, where=None):
    near = ret.dense(table(spark, d, "embeddings"), _VECTOR, where)
    return near.select("vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_dense_sql())
def dense_topk(spark, d):
    return _dense(spark, d)


@query(_dense_sql("label = 3 or (label in (4, 5) and vec_id > 10)"))
def dense_topk_filtered(spark, d):
    own = ret.metadata(F.col("label"), 3) | (F.col("label").isin(4, 5) & (F.col("vec_id") > 10))
    return _dense(spark, d, own)


_SPARSE = f"with {_TOK.replace('source, doc_id, t from', 'source, doc_id, t from')}, {_BM25}, sp as (select doc_id as id, rank from (select doc_id, cast(row_number() over (order by round(score, 9) desc, doc_id) as bigint) rank from s where score > 0) t where rank <= 10), de as (select vec_id as id, rank from ({_dense_sql()}) t), fu as (select coalesce(d.id, s.id) as id, d.rank as d_rank, s.rank as s_rank, coalesce(1.0e0 / (60 + d.rank), 0e0) + coalesce(1.0e0 / (60 + s.rank), 0e0) as score from de d full outer join sp s on d.id = s.id)"


def _fused(spark, d):
    scored = ret.bm25(table(spark, d, "documents"), QUERY).withColumn("score", F.round("score", 9))
    sparse = ret.top(scored, "doc_id", 10).select(F.col("doc_id").alias("id"), F.col("rank").cast("long").alias("rank"))
    return ret.fuse(_dense(spark, d).select(F.col("vec_id").alias("id"), "rank"), sparse)


@query(f"{_SPARSE} select id, d_rank, s_rank, round(score, 9) as score from fu")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("id", "d_rank", "s_rank", F.round("score", 9).alias("score"))


_WORDS = sorted(set(QUERY.split()))
_OVERLAP = f"(len(list_filter({_WORDS}, lambda w: list_contains(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), w))) / {len(_WORDS)}e0)"


@query(f"{_SPARSE}, ten as (select * from fu order by score desc, d_rank nulls last, s_rank nulls last limit 10) select ten.id, round(score, 9) as score, round({_OVERLAP}, 6) as rerank_score from ten left join documents d on ten.id = d.doc_id order by rerank_score desc, score desc, ten.id limit 8")
def hybrid_topk(spark, d):
    ten = ret.first_fused(_fused(spark, d), 10).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "left")
    best = ret.rerank(ten, ret.overlap_scorer(F.coalesce("text", F.lit("")), QUERY), 8)
    return best.select("id", F.round("score", 9).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))


@query(f"select doc_id as id, round({_OVERLAP}, 6) as rerank_score from documents order by rerank_score desc, doc_id limit 8")
def rerank_stub(spark, d):
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0.0).alias("score"), "text")
    return ret.rerank(hits, ret.overlap_scorer(F.col("text"), QUERY), 8).select("id", F.round("rerank_score", 6).alias("rerank_score"))


_ASKED = [(1, "the then la the"), (2, "De erthan"), (3, "nothingofthekind")]
_BATCH = "q as (select s.number * 10 + v.i as query_id, s.source, v.t, v.qtf from (select source, cast(substr(source, 4) as int) as number from (select distinct source from documents) x) s, (values (1, 'the', 2), (1, 'then', 1), (1, 'la', 1), (2, 'de', 1), (2, 'erthan', 1)) v(i, t, qtf))"


_STATS = _BM25.replace(f"q as (select * from {_TERMS} v(t, qtf))", _BATCH).rsplit(",\ns as", 1)[0]


@query(f"""with {_TOK}, {_STATS},
b as (select q.query_id, tf.doc_id, sum(qtf * (case when i0 < 0 then eps else i0 end) * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))) score from tf join q on tf.t = q.t and tf.source = q.source join raw on raw.source = tf.source and raw.t = tf.t join ep on ep.source = tf.source join dl on dl.source = tf.source and dl.doc_id = tf.doc_id join st on st.source = tf.source group by q.query_id, tf.doc_id)
select query_id, doc_id, rank, round(score, 6) as score from (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as bigint) rank from b where score > 0) t where rank <= 10""")
def bm25_queries(spark, d):
    docs = table(spark, d, "documents")
    sources = docs.select("source").distinct()
    asked = [sources.select((F.expr("cast(substr(source, 4) as int)") * 10 + i).alias("query_id"), "source", F.lit(t).alias("text")) for i, t in _ASKED]
    scored = ret.bm25_batch(docs, functools.reduce(DataFrame.unionByName, asked)).withColumn("exact", F.col("score")).withColumn("score", F.round("score", 9))
    return ret.top(scored, "doc_id", 10, by="query_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("exact", 6).alias("score"))


def _postings(spark, d):
    """An index of stored postings, appended to three times; the last append repeats units of the second."""
    at = folder(spark, "postings")
    rows = view(spark, d, "v_documents").select("project_id", F.col("id").alias("unit"), F.col("document_type").alias("kind"), "text")
    for part in ("unit % 3 = 0", "unit % 3 = 1", "unit % 3 > 0"):
        postings.append(spark, at, rows.where(part))
    return at


@query(ORACLE_SQL["bm25_queries"])
def bm25_stored(spark, d):
    projects = view(spark, d, "v_documents").select("project_id").distinct()
    asked = [projects.select((F.col("project_id") * 10 + i).alias("query_id"), "project_id", F.lit(t).alias("text")) for i, t in _ASKED]
    hits = postings.Search(spark, _postings(spark, d), functools.reduce(DataFrame.unionByName, asked), k=10).hits
    return hits.select("query_id", F.col("unit").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"with {_TOK}, {_STATS} select cast(substr(st.source, 4) as int) as project_id, st.n, cast(round(st.n * st.avgdl) as bigint) as words, r.n_terms, round(ep.eps, 6) as eps from st join ep on st.source = ep.source join (select source, count(*) as n_terms from raw group by source) r on st.source = r.source")
def postings_statistics(spark, d):
    found = postings.statistics(spark, _postings(spark, d))
    return found.select("project_id", "n", "words", "n_terms", F.round("eps", 6).alias("eps"))


_PAIR = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double))))"


@query(f"select query_id, vec_id, round(distance, 6) as distance, rank from (select *, cast(row_number() over (partition by query_id order by round(distance, 9), vec_id) as bigint) as rank from (select q.vec_id as query_id, e.vec_id, {_PAIR} as distance from embeddings q join embeddings e on e.label % 2 = q.label % 2 and e.label > 1 where q.vec_id % 100 = 0) t) u where rank <= 10")
def vector_lists(spark, d):
    at = folder(spark, "vectors")
    rows = table(spark, d, "embeddings").select((F.col("label") % 2).alias("by"), F.col("vec_id").alias("unit"), F.col("label").cast("string").alias("kind"), "embedding")
    vectors.fit(spark, at, rows)
    for part in ("unit % 2 = 0", "unit % 2 = 1"):
        vectors.append(spark, at, rows.where(part))
    asked = rows.where("unit % 100 = 0").select(F.col("unit").alias("query_id"), "by", F.col("embedding").alias("vector"))
    hits = vectors.Search(spark, at, asked, where=F.col("kind").cast("int") > 1).hits
    return hits.select("query_id", F.col("unit").alias("vec_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


_BASE = "kind in ('EL', 'IFA')"


@query(f"""with u as (select d.id as unit, d.project_id, d.document_type as kind, d.text, e.embedding from v_documents d join embeddings e on d.id = e.vec_id),
tok as (select project_id, unit, kind, t from (select project_id, unit, kind, unnest(regexp_split_to_array(lower(text), '\\s+')) t from u) x where t <> ''),
tf as (select project_id, unit, kind, t, count(*) tf from tok group by all), dl as (select project_id, unit, count(*) dl from tok group by all), st as (select project_id, count(*) n, avg(dl) avgdl from dl group by project_id),
q as (select * from {_TERMS} v(t, qtf)), raw as (select tf.project_id, tf.t, ln(max(n) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) i0 from tf join st on tf.project_id = st.project_id group by tf.project_id, tf.t), ep as (select project_id, 0.25e0 * avg(i0) eps from raw group by project_id),
s as (select tf.project_id, tf.unit, sum(qtf * (case when i0 < 0 then eps else i0 end) * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))) score from tf join q on tf.t = q.t join raw on raw.project_id = tf.project_id and raw.t = tf.t join ep on ep.project_id = tf.project_id join dl on dl.project_id = tf.project_id and dl.unit = tf.unit join st on st.project_id = tf.project_id where {_BASE} group by tf.project_id, tf.unit),
sp as (select * from (select project_id, unit, row_number() over (partition by project_id order by round(score, 9) desc, unit) s_rank from s where score > 0) t where s_rank <= 10),
de as (select * from (select project_id, unit, row_number() over (partition by project_id order by {_DIST}, unit) d_rank from u where {_BASE}) t where d_rank <= 10),
fu as (select coalesce(de.project_id, sp.project_id) as project_id, coalesce(de.unit, sp.unit) as unit, d_rank, s_rank, coalesce(1.0e0 / (60 + d_rank), 0e0) + coalesce(1.0e0 / (60 + s_rank), 0e0) as score from de full join sp on de.unit = sp.unit),
pl as (select * from (select *, row_number() over (partition by project_id order by score desc, d_rank nulls last, s_rank nulls last) place from fu) t where place <= 10),
rr as (select pl.*, {_OVERLAP} as rerank_score from pl join u on pl.unit = u.unit)
select project_id as query_id, unit, round(score, 9) as score, round(rerank_score, 6) as rerank_score, rank from (select *, cast(row_number() over (partition by project_id order by rerank_score desc, place) as bigint) rank from rr) t where rank <= 8""")
def search_baseline(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), "embedding")
    units = view(spark, d, "v_documents").select(F.col("id").alias("unit"), "project_id", F.col("document_type").alias("kind"), "text").join(vectors, "unit")
    units = settle(units, "units")
    vector = F.array(*(F.lit(x) for x in _VECTOR))
    asked = units.select("project_id").distinct().select(F.col("project_id").alias("query_id"), "project_id", F.lit(QUERY).alias("text"), vector.alias("vector"))
    found = ret.search_baseline(units, asked, scorer=ret.shared_words)
    return found.select("query_id", "unit", F.round("score", 9).alias("score"), F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


def _faulty():
    """A model that likes short texts, and fails on queries that name an odd number."""

    def score(queries, texts):
        if any(int(q.rsplit(" ", 1)[1]) % 2 for q in queries):
            raise RuntimeError("no model")
        return [1 / (1 + len(t)) for t in texts]

    return score


@query(f"""with u as (select id as unit, project_id, length(text) as n, row_number() over (partition by project_id order by id) as place, embedding from v_documents d join embeddings e on d.id = e.vec_id),
de as (select * from (select project_id, unit, n, row_number() over (partition by project_id order by {_DIST}, unit) place from u) t where place <= 10)
select project_id as query_id, unit, cast(row_number() over (partition by project_id order by case when project_id % 2 = 0 then n end, place) as bigint) as rank from de qualify rank <= 8""")
def rerank_failing(spark, d):
    units = view(spark, d, "v_documents").select(F.col("id").alias("unit"), "project_id", F.col("document_type").alias("kind"), "text").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), "embedding"), "unit")
    units = settle(units, "units")
    asked = units.select("project_id").distinct().select(F.col("project_id").alias("query_id"), "project_id", F.concat(F.lit("zzzz "), (F.col("project_id") + 1_000_000).cast("string")).alias("text"), F.array(*(F.lit(x) for x in _VECTOR)).alias("vector"))
    return ret.search_documents(units, asked, scorer=ret.model_scorer(_faulty)).select("query_id", "unit", F.col("rank").cast("long").alias("rank"))


def _counting():
    return lambda texts: [[float(len(t)), float(len(t.split(" ")))] for t in texts]


@query("select doc_id, cast(length(text) as float) as letters, cast(len(string_split(text, ' ')) as float) as words from documents")
def embed_docs(spark, d):
    found = ret.embed(table(spark, d, "documents").select("doc_id", "text"), "text", _counting)
    return found.select("doc_id", F.col("embedding")[0].alias("letters"), F.col("embedding")[1].alias("words"))


# Extraction

_SCOPE = "concat('Result: {\"scope_items\": [{\"name\": \"', p_name, '\", \"scope_type\": \"IN_SCOPE\"}, {\"description\": null}], \"deliverables\": []} end')"


@query("select p_partkey as id, pos, case when pos = 0 then p_name else 'Unknown' end as name, case when pos = 0 then '' end as description, case when pos = 0 then 'IN_SCOPE' else 'UNCERTAIN' end as scope_type, '' as evidence_text from part, (values (0), (1)) v(pos)")
def scope_explode(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), strict_json(F.expr(_SCOPE)).alias("payload"))
    return ex.explode_items(rows, F.col("payload"), "scope_items", ["id"]).select("id", "pos", *ex.filled(F.col("item"), ex.SCOPE_ITEM))


@query(ORACLE_SQL["scope_explode"])
def scope_variant(spark, d):
    """The rows of scope_explode from payloads that are parsed once."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), js.payload(F.expr(_SCOPE)).alias("payload"))
    found = ex.variant_rows(rows, "payload", {"scope_items": ex.SCOPE_ITEM, "deliverables": ex.DELIVERABLE, "stakeholders": ex.STAKEHOLDER}, ["id"])
    return found.where("list = 'scope_items'").select("id", "pos", *(F.col("fields")[k].alias(k) for k in ex.SCOPE_ITEM))


@query("select conv_id, turn, kind, role as name from (select conv_id, turn, role, unnest(['activity', 'request']) as kind from conversations) t")
def status_explode(spark, d):
    text = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("activity_name"))).alias("activities"), F.array(F.struct(F.col("role").alias("request_name"))).alias("new_requests")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.alias("payload"))
    parts = [ex.explode_items(rows, F.col("payload"), f, ["conv_id", "turn"]).select("conv_id", "turn", F.lit(k).alias("kind"), or_default(F.col("item"), n, "Unknown").alias("name")) for f, k, n in (("activities", "activity", "activity_name"), ("new_requests", "request", "request_name"))]
    return parts[0].unionByName(parts[1])


@query("select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k, 'Unknown' as name, case when event_type = 'view' then null else event_type end as deadline from events")
def default_fill(spark, d):
    deadline = F.nullif(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")), F.lit(""))
    return table(spark, d, "events").select("event_id", or_default(F.col("props"), "k", "none").alias("k"), or_default(F.col("props"), "name", "Unknown").alias("name"), deadline.alias("deadline"))


@query("select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k, 'Unknown' as name from events")
def default_variant(spark, d):
    rows = table(spark, d, "events").select("event_id", js.payload(F.col("props")).alias("p"))
    return rows.select("event_id", js.field(F.col("p"), "k", "none").alias("k"), js.field(F.col("p"), "name", "Unknown").alias("name"))


@query("select p_partkey as id, case p_partkey % 3 when 0 then p_name when 1 then p_brand else '' end as query_text from part")
def risk_query_text(spark, d):
    item = F.expr("""case p_partkey % 3 when 0 then to_json(named_struct('activity_name', p_name)) when 1 then to_json(named_struct('request_name', p_brand)) else '{}' end""")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ex.first_named(item, "activity_name", "request_name").alias("query_text"))


@query("select o_custkey, string_agg('- ' || o_orderpriority || ' (Order: ' || o_orderkey || ')', chr(10) order by o_orderkey) as evidence from orders group by o_custkey")
def evidence_digest(spark, d):
    line = F.concat(F.lit("- "), "o_orderpriority", F.lit(" (Order: "), F.col("o_orderkey").cast("string"), F.lit(")"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("ls"))
    return rows.select("o_custkey", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("evidence"))


def _reader(prompts):
    """A model that says how long the text is, null without one."""
    lengths = [str(len(text[0])) if text else None for _, *text in (p.split("\n\nText:\n", 1) for p in prompts)]
    return [json.dumps({"scope_items": [{"name": n}, {"name": "rest", "scope_type": "IN_SCOPE"}], "activities": [{"activity_name": n}], "new_requests": []}) for n in lengths]


@query("select id, pos, case when pos = 0 then cast(length(text) as varchar) else 'rest' end as name, case when pos = 0 then 'UNCERTAIN' else 'IN_SCOPE' end as scope_type from v_documents, (values (0), (1)) v(pos)")
def scope_extract(spark, d):
    docs = view(spark, d, "v_documents").select("id", "text")
    return ex.scope_rows(ex.extract_scope(docs, _reader), ["id"])["scope_items"].select("id", "pos", "name", "scope_type")


@query("select id, 0 as pos, cast(least(length(text), 8000) as varchar) as activity_name, 'UNKNOWN' as activity_status from v_documents")
def status_extract(spark, d):
    docs = view(spark, d, "v_documents").select("id", "text")
    return ex.status_rows(ex.extract_status(docs, _reader), ["id"])["activities"].select("id", "pos", "activity_name", "activity_status")


# Risk, alerts, memory


@query("select 'ACTIVITY' as item_type, id as reference_id, activity_name as item_name, (id % 11) / 10e0 as risk_score, 'OPEN' as status from v_activities union all select 'NEW_REQUEST', id, request_name, (id % 7) / 10e0, 'OPEN' from v_requests")
def tracker_build(spark, d):
    def risk(kind, id_):
        return F.when(kind == "ACTIVITY", (id_ % 11) / F.lit(10.0)).otherwise((id_ % 7) / F.lit(10.0))

    return mon.tracker_rows(view(spark, d, "v_activities"), view(spark, d, "v_requests"), risk)


_ROLES = ", ".join(f"'{r}'" for r in ALERT_ROLES)


@query(f"select t.project_id, t.item_type, t.reference_id, s.email, s.role, 'High Risk Item Detected - Project ' || t.project_id as subject from v_tracker t join v_stakeholders s on t.project_id = s.project_id where t.item_type = 'NEW_REQUEST' and (t.requires_escalation or t.risk_score >= 0.8e0) and s.role in ({_ROLES})")
def alert_outbox(spark, d):
    return mon.alerts(view(spark, d, "v_tracker"), view(spark, d, "v_stakeholders"))


_RULES = " || chr(10) || ".join("'" + r.replace("'", "''") + "'" for r in mon.RULES)


@query(f"with di as ({_DIGEST}), ba as (select * from (select project_id, id, row_number() over (partition by project_id order by id desc) rn from v_baselines where status = 'APPROVED') t where rn = 1), it as (select l_orderkey, count(*) n from lineitem group by 1) select coalesce(ba.project_id, di.project_id) as project_id, ba.id as baseline_id, case when ba.id is not null then coalesce(it.n, 0) end as n_items, coalesce(di.digest, 'No recent events.') as digest, {_RULES} as rules from ba left join it on ba.id = it.l_orderkey full join di on ba.project_id = di.project_id")
def project_context(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("baseline_id"), F.col("l_partkey").cast("string").alias("name"))
    out = mon.context(view(spark, d, "v_baselines"), items, view(spark, d, "v_events"))
    return out.select("project_id", "baseline_id", F.when(F.col("baseline_id").isNotNull(), F.size("items").cast("long")).alias("n_items"), "digest", "rules")


@query("select item_type, reference_id, count(*) as n from v_tracker t where not exists (select 1 from v_requests r where r.id = t.reference_id) group by all")
def fk_orphans(spark, d):
    bad = rel.orphans(view(spark, d, "v_tracker"), F.col("reference_id"), view(spark, d, "v_requests"), "id")
    return bad.groupBy("item_type", "reference_id").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def uk_violations(spark, d):
    return rel.repeated_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def _assessor(prompts):
    """A model that goes by the length of an item's name, and is sure of what has evidence."""
    out = []
    for p in prompts:
        if "\n\nDraft:\n" in p:
            draft, evidence = p.split("\n\nDraft:\n")[1].split("\n\nAnswer")[0].split("\n\nEvidence:\n")
            risk = json.loads(draft)["risk_score"]
            out.append({"is_out_of_scope": risk > 0.5, "risk_score": risk, "reasoning": evidence.split("\n")[0], "confidence": 0.9 if evidence else 0.4, "requires_escalation": risk >= 0.8})
        else:
            name = json.loads(p.split("\n\nItem:\n")[1].split("\n\nEvidence:\n")[0])["request_name"]
            out.append({"is_out_of_scope": False, "risk_score": len(name) % 10 / 10, "reasoning": name})
    return [json.dumps(x) for x in out]


@query("""with e as (select l_partkey as id, arg_min('- order ' || l_orderkey || ' (Score: ' || printf('%.2f', l_discount) || ')', l_orderkey * 100 + l_linenumber) as line from (select distinct l_partkey, l_orderkey, l_linenumber, l_discount from (select *, row_number() over (partition by l_partkey, l_orderkey, l_linenumber order by l_discount) rn from lineitem) x where rn = 1) y group by l_partkey)
select r.id as item_id, length(request_name) % 10 / 10e0 > 0.5e0 as is_out_of_scope, length(request_name) % 10 / 10e0 as risk_score, coalesce(e.line, '') as reasoning, case when e.line is not null then 0.9e0 else 0.4e0 end as confidence, length(request_name) % 10 / 10e0 >= 0.8e0 as requires_escalation, cast(null as varchar) as error from v_requests r left join e on r.id = e.id""")
def risk_assess(spark, d):
    items = view(spark, d, "v_requests").select(F.col("id").alias("item_id"), (F.col("id") % 25).alias("project_id"), F.to_json(F.struct("request_name")).alias("item"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id"), "l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("rerank_score"))
    evidence = lines.select("item_id", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("rank"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("text"), F.lit(0.0).alias("score"), "rerank_score")
    return mon.assess(items, mon.evidence_lines(evidence), _assessor).drop("project_id", "item")


@query(f"select t.project_id, t.item_type, t.reference_id, s.email, s.role, 'High Risk Item Detected - Project ' || t.project_id as subject, 'A high-risk item was detected.' || chr(10) || chr(10) || 'Item: ' || coalesce(r.request_name, '') || chr(10) || 'Reasoning: ' || 'risk ' || t.risk_score || chr(10) || chr(10) || 'Please review it in the tracker.' as body from v_tracker t left join v_requests r on t.reference_id = r.id join v_stakeholders s on t.project_id = s.project_id where t.item_type = 'NEW_REQUEST' and (t.requires_escalation or t.risk_score >= 0.8e0) and s.role in ({_ROLES})")
def alert_mail(spark, d):
    names = view(spark, d, "v_requests").select(F.col("id").alias("reference_id"), F.col("request_name").alias("item_name"))
    items = view(spark, d, "v_tracker").join(names, "reference_id", "left").withColumn("reasoning", F.concat(F.lit("risk "), F.col("risk_score").cast("string")))
    return mon.alerts(items, view(spark, d, "v_stakeholders"))


_NOW = "2026-01-02 03:04:05"
_RESOLVERS = ", ".join(f"'{r}'" for r in RESOLVER_ROLES)


@query(f"select e.id, e.project_id, case when a.id is not null then e.event_summary end as resolution, case when a.id is not null then 'RESOLVED' else 'OPEN' end as status, a.id as resolved_by, case when a.id is not null then '{_NOW}' end as resolved_at from v_events e left join v_users a on a.id = {ACTOR} and a.role in ({_RESOLVERS}) and e.event_type = 'error'")
def tracker_resolve(spark, d):
    events = view(spark, d, "v_events")
    blank = [F.lit(None).cast(k).alias(c) for c, k in (("resolution", "string"), ("resolved_by", "bigint"), ("resolved_at", "timestamp_ntz"))]
    items = events.select("id", "project_id", F.lit("OPEN").alias("status"), *blank)
    changes = events.where("event_type = 'error'").select("id", "project_id", F.col("event_summary").alias("resolution"), F.lit("RESOLVED").alias("status"))
    out = rel.resolve(items, changes, rel.allowed(view(spark, d, "v_users"), ACTOR, RESOLVER_ROLES), F.lit(_NOW).cast("timestamp_ntz"))
    return out.select("id", "project_id", "resolution", "status", "resolved_by", F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss").alias("resolved_at"))


@query(f"select b.id, case when b.id = l.draft_id then 'APPROVED' else b.status end as status, case when b.id = l.draft_id then cast({USER} as bigint) end as approved_by, case when b.id = l.draft_id then '{_NOW}' end as approved_at from v_baselines b left join (select project_id, max(id) as draft_id from v_baselines where status = 'DRAFT' group by project_id) l on b.project_id = l.project_id")
def baseline_approve(spark, d):
    out = rel.approve_latest_draft(view(spark, d, "v_baselines"), USER, F.lit(_NOW).cast("timestamp_ntz"))
    return out.select("id", "status", "approved_by", F.date_format("approved_at", "yyyy-MM-dd HH:mm:ss").alias("approved_at"))


_STATES = list(PROJECT_STEPS)
_MOVES = " or ".join(f"(b = '{x}' and e in ({', '.join(repr(y) for y in ys)}))" for x, ys in PROJECT_STEPS.items())


@query(f"select id, case when {_MOVES} then e else b end as monitoring_status, coalesce({_MOVES}, false) as moved from (select c_custkey as id, list_extract({_STATES}, cast(c_custkey % 4 + 1 as int)) as b, case when c_custkey % 5 > 0 then list_extract({_STATES}, cast(c_custkey // 4 % 4 + 1 as int)) end as e from customer) t")
def project_moves(spark, d):
    states = F.array(*(F.lit(x) for x in _STATES))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    begin = rows.select("id", F.get(states, (F.col("id") % 4).cast("int")).alias("monitoring_status"))
    changes = rows.where("id % 5 > 0").select("id", F.get(states, F.expr("cast(id div 4 % 4 as int)")).alias("to"))
    return rel.move(begin, "monitoring_status", changes, PROJECT_STEPS)


_REQUEST_STATES = [*REQUEST_STEPS, "APPROVED_CHANGE", "REJECTED"]
_REQUEST_MOVES = " or ".join(f"(b = '{x}' and e in ({', '.join(repr(y) for y in ys)}))" for x, ys in REQUEST_STEPS.items())


@query(f"select id, case when {_REQUEST_MOVES} then e else b end as request_status, coalesce({_REQUEST_MOVES}, false) as moved from (select id, list_extract({_REQUEST_STATES}, cast(id % 4 + 1 as int)) as b, case when id % 5 > 0 then list_extract({_REQUEST_STATES}, cast(id // 4 % 4 + 1 as int)) end as e from v_requests) t")
def request_moves(spark, d):
    states = F.array(*(F.lit(x) for x in _REQUEST_STATES))
    rows = view(spark, d, "v_requests").select("id")
    begin = rows.select("id", F.get(states, (F.col("id") % 4).cast("int")).alias("request_status"))
    changes = rows.where("id % 5 > 0").select("id", F.get(states, F.expr("cast(id div 4 % 4 as int)")).alias("to"))
    return rel.move(begin, "request_status", changes, REQUEST_STEPS)


_GATE_ROWS = ", ".join(f"('{a}', '{r}')" for a, rs in GATES.items() for r in rs)


@query(f"select u.id as user_id, g.action from v_users u join (values {_GATE_ROWS}) g(action, role) on u.role = g.role where u.id % 3 <> 0")
def permissions(spark, d):
    return rel.permissions(view(spark, d, "v_users").withColumn("is_active", F.col("id") % 3 != 0), GATES)


_GATED = " or ".join(f"(action = '{a}' and role in ({', '.join(repr(r) for r in rs)}))" for a, rs in GATES.items())
_ACTIONS = [*GATES, "delete_project"]


@query(f"select event_id, user_id, action, case when role is null then 'unknown user' when user_id % 3 = 0 then 'inactive user' when not ({_GATED}) then 'not permitted' end as error from (select e.*, u.role from (select event_id, user_id, list_extract({_ACTIONS}, cast(event_id % {len(_ACTIONS)} + 1 as int)) as action from events) e left join v_users u on e.user_id = u.id) t")
def gate_attempts(spark, d):
    actions = F.array(*(F.lit(x) for x in _ACTIONS))
    attempts = table(spark, d, "events").select("event_id", "user_id", F.get(actions, (F.col("event_id") % len(_ACTIONS)).cast("int")).alias("action"))
    return rel.refused(attempts, view(spark, d, "v_users").withColumn("is_active", F.col("id") % 3 != 0), GATES)


@query(f"select (select max(id) from v_events) + row_number() over (order by c_nationkey, c_mktsegment, c_name) as id, cast(c_nationkey as int) as project_id, c_mktsegment as event_type, c_name as event_summary, case when c_custkey % 2 = 0 then 0.25e0 else 0.5e0 end as importance_score, '{_NOW}' as created_at from customer")
def event_append(spark, d):
    new = table(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("event_type"), F.col("c_name").alias("event_summary"), F.when(F.col("c_custkey") % 2 == 0, 0.25).alias("importance_score"))
    out = mon.new_events(new, view(spark, d, "v_events"), F.lit(_NOW).cast("timestamp_ntz"))
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) + 1000 as bigint) as id, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem")
def line_ids(spark, d):
    lines = table(spark, d, "lineitem")
    out = store.with_ids(lines, spark.createDataFrame([(1000,)], "id long"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _resolved_log(spark, d, compacted):
    """Tracker items as a log: two appends of resolutions, the second over rows of the first, with or without compaction between."""
    log = changelog.ChangeLog(spark, folder(spark, "tracker"))
    events = view(spark, d, "v_events")
    blank = [F.lit(None).cast(k).alias(c) for c, k in (("resolution", "string"), ("resolved_by", "bigint"), ("resolved_at", "timestamp_ntz"))]
    log.create(events.select("id", "project_id", F.lit("OPEN").alias("status"), *blank))
    actor = rel.allowed(view(spark, d, "v_users"), ACTOR, RESOLVER_ROLES)
    for kinds, how in ((["error", "view"], F.lit("first")), (["error"], F.col("event_summary"))):
        changes = events.where(F.col("event_type").isin(kinds)).select("id", "project_id", how.alias("resolution"), F.lit("RESOLVED").alias("status"))
        items = log.read()
        after = rel.resolve(items, changes, actor, F.lit(_NOW).cast("timestamp_ntz"))
        log.append(after.join(changes.select("id"), "id", "left_semi").where("resolved_by is not null").select(items.columns))
        if compacted:
            log.compact()
    return log.read().select("id", "project_id", "resolution", "status", "resolved_by", F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss").alias("resolved_at"))


_LOGGED = f"select e.id, e.project_id, case when a.id is not null then case e.event_type when 'error' then e.event_summary else 'first' end end as resolution, case when a.id is not null then 'RESOLVED' else 'OPEN' end as status, a.id as resolved_by, case when a.id is not null then '{_NOW}' end as resolved_at from v_events e left join v_users a on a.id = {ACTOR} and a.role in ({_RESOLVERS}) and e.event_type in ('error', 'view')"


@query(_LOGGED)
def tracker_log(spark, d):
    return _resolved_log(spark, d, False)


@query(_LOGGED)
def tracker_log_compacted(spark, d):
    return _resolved_log(spark, d, True)


@query("select * from (select project_id, id, event_type, cast(row_number() over (partition by project_id order by created_at desc, id desc) as bigint) rn from v_events) t where rn <= 20")
def recent_kept(spark, d):
    """The newest events of each project from a state that four appends have built, the last of them again."""
    events = view(spark, d, "v_events")
    state = changelog.Recent(spark, folder(spark, "recent"), "project_id", mon.RECENT, F.desc("created_at"), F.desc("id"))
    for part in ("id % 4 = 2", "id % 4 = 0", "id % 4 = 3", "id % 4 = 1", "id % 4 = 1"):
        state.append(events.where(part))
    return state.read().select("project_id", "id", "event_type", F.col("rn").cast("long").alias("rn"))


# Stores and files


def _chunk_index(spark, d):
    """An index written in two batches that overlap."""
    at = folder(spark, "index")
    rows = view(spark, d, "v_documents").select("project_id", F.col("id").alias("document_id"), F.lit(None).cast("int").alias("page_number"), F.posexplode(tx.chunks(F.col("text"))).alias("chunk_index", "text"))
    chunks = store.catalogue(rows)
    for part in (chunks.where("project_id % 2 = 0"), chunks):
        store.index(spark, at, part, lambda df: ret.embed(df, "text", _counting))
    return store.open_index(spark, at)


@query(f"select 'proj_' || project_id || '_doc_' || doc_id || '_chunk_' || chunk_index as chunk_id, cast(length(text) as float) as letters from ({_CHUNKS}) c")
def index_chunks(spark, d):
    return _chunk_index(spark, d)[0].select("chunk_id", F.col("embedding")[0].alias("letters"))


@query(f"select 'proj_' || project_id || '_doc_' || doc_id || '_chunk_' || chunk_index as chunk_id, cast(length(text) as bigint) as n_chars, case when project_id % 2 = 0 then 'first' else 'second' end as batch from ({_CHUNKS}) c")
def chunks_by_filter(spark, d):
    """Chunks appended in two batches that overlap, through filters of the stored keys."""
    at = folder(spark, "filtered")
    rows = view(spark, d, "v_documents").select("project_id", F.col("id").alias("document_id"), F.lit(None).cast("int").alias("page_number"), F.posexplode(tx.chunks(F.col("text"))).alias("chunk_index", "text"))
    chunks = store.catalogue(rows)
    for part, name in ((chunks.where("project_id % 2 = 0"), "first"), (chunks, "second")):
        filters.append(spark, at, part.withColumn("batch", F.lit(name)))
    return spark.read.parquet(at).select("chunk_id", F.length("text").cast("long").alias("n_chars"), "batch")


@query(f"with tok as (select project_id, doc_id, chunk_index, unnest(regexp_split_to_array(lower(text), '\\s+')) t from ({_CHUNKS}) c) select project_id, t, count(distinct doc_id * 1000 + chunk_index) as df, cast(null as bigint) as words from tok where t <> '' group by project_id, t union all select project_id, null, count(distinct doc_id * 1000 + chunk_index), count(*) from tok where t <> '' group by project_id")
def index_terms(spark, d):
    return _chunk_index(spark, d)[1].select("project_id", "t", "df", "words")


@query("select r_name as name from region where r_name is not null")
def text_files(spark, d):
    at = folder(spark, "texts")
    table(spark, d, "region").select("r_name").coalesce(1).write.text(at)
    return files.read_files(spark, at).where("processing_status = 'COMPLETED'").select(F.explode(F.split("text", "\n")).alias("name")).where("name <> ''")


def _stubborn(prompts):
    """A model that gives JSON to even ids at once, to ids of three when asked again, and to others never."""
    out = []
    for p in prompts:
        n = int(p.split()[0])
        out.append(json.dumps({"n": n}) if n % 2 == 0 or (n % 3 == 0 and "valid JSON" in p) else "I would rather not")
    return out


@query("select c_custkey as id, case when c_custkey % 2 = 0 or c_custkey % 3 = 0 then cast(c_custkey as varchar) end as n, case when c_custkey % 2 <> 0 and c_custkey % 3 <> 0 then 'no JSON' end as payload_error from customer")
def json_retry(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_custkey").cast("string"), F.lit(" please")).alias("prompt"))
    return ex.generate_json(rows, "prompt", _stubborn).select("id", F.get_json_object("payload", "$.n").alias("n"), "payload_error")


def _moody():
    """A client that counts the words of a prompt, answers in prose first if there are many, and fails on every seventh length."""

    def ask(prompt):
        lines = prompt.split("\n")
        n = len(lines[0].split(" "))
        if n % 7 == 0:
            raise RuntimeError(f"overloaded by {n}")
        return "Let me see" if n % 5 == 0 and len(lines) == 1 else json.dumps({"n": n})

    return ask


@query("select conv_id, turn, case when n % 7 <> 0 then cast(n as varchar) end as n, case when n % 7 = 0 then 'overloaded by ' || n end as error from (select conv_id, turn, len(string_split(replace(text, chr(10), ' '), ' ')) as n from conversations) t")
def answers_resumed(spark, d):
    """Half of the prompts are asked in a first run, as if it had been cut short; the second asks for the rest and what failed."""
    at = folder(spark, "answers")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n", " ").alias("prompt"))
    for part in ("conv_id % 2 = 0", "true"):
        answers.ask(spark, at, rows.where(part), "prompt", _moody, as_json=True, batch=50_000)
    out = answers.answered(spark, at, rows, "prompt")
    return out.select("conv_id", "turn", F.get_json_object("payload", "$.n").alias("n"), F.col("payload_error").alias("error"))


def _picky():
    def send(row):
        if row["email"].startswith("supplier#000000003"):
            raise ConnectionError("mailbox full")

    return send


@query(f"select project_id, item_type, reference_id, email, not starts_with(email, 'supplier#000000003') as sent, case when starts_with(email, 'supplier#000000003') then 'mailbox full' end as error from (select distinct t.project_id, t.item_type, t.reference_id, s.email from v_tracker t join v_stakeholders s on t.project_id = s.project_id where t.item_type = 'NEW_REQUEST' and t.risk_score >= 0.99e0 and s.role in ({_ROLES})) x")
def alert_ledger(spark, d):
    """Alerts of the highest risk as two batches of which the second repeats the first; each is sent once."""
    at = folder(spark, "ledger")
    items = view(spark, d, "v_tracker").where("risk_score >= 0.99")
    for number, part in enumerate(("project_id % 2 = 0", "true")):
        kinds = ledger.send_alerts(items.where(part), view(spark, d, "v_stakeholders"), number, at, _picky)
    return ledger.entries(spark, at, *kinds).select("project_id", "item_type", "reference_id", "email", "sent", "error")


@query("select project_id, doc_id as document_id, case when doc_id % 4 = 3 or (doc_id % 4 = 1) then 'FAILED' else 'COMPLETED' end as processing_status, case doc_id % 4 when 3 then 'Unsupported file format' when 1 then 'not a document' end as error_message, case when doc_id % 4 in (0, 2) then strlen(coalesce(text, '')) end as n_bytes from (select doc_id, cast(substr(source, 4) as bigint) as project_id, text from documents) t")
def document_machine(spark, d):
    """Documents landed as files of four types and followed by a stream in two runs; the parsers are the caller's."""
    at = folder(spark, "machine")
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.element_at(F.array(*(F.lit(x) for x in (".txt", ".docx", ".TXT", ".md"))), (F.col("doc_id") % 4 + 1).cast("int")))
    rows = table(spark, d, "documents").select(F.expr("cast(substr(source, 4) as bigint)").alias("project_id"), F.col("doc_id").alias("document_id"), name.alias("document_name"), F.lit("EL").alias("document_type"), F.lit(USER).cast("long").alias("uploaded_by"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))

    def refuse(_):
        raise ValueError("not a document")

    for part in ("document_id % 2 = 0", "document_id % 2 = 1"):
        documents.land(rows.where(part), f"{at}/landed")
        documents.start_documents(spark, f"{at}/landed", f"{at}/states", f"{at}/checkpoint", {".docx": refuse}).awaitTermination()
    found = spark.read.parquet(f"{at}/states")
    last = documents.final_states(found).select("project_id", "document_id", "processing_status", "error_message", "storage_key")
    texts = found.where("text is not null").groupBy("storage_key").agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))
    return last.join(texts, "storage_key", "left").select(F.col("project_id").cast("long").alias("project_id"), "document_id", "processing_status", "error_message", "n_bytes")


@query("select 'nation' as name, cast(0 as bigint) as n union all select 'region', count(*) from region")
def truncated(spark, d):
    at = {t: folder(spark, t) for t in ("nation", "region")}
    for t, path in at.items():
        table(spark, d, t).write.parquet(path)
    store.truncate(spark, at, keep=("region",))
    return functools.reduce(DataFrame.unionByName, (spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t, path in at.items()))
