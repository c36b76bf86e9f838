"""Named queries of full-text, vector and hybrid search. The questions are the whole benchmark table."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions import documents as D
from opsloom.functions import vectors as V
from opsloom.operators import filters as FL
from opsloom.operators import clusters as leaders
from opsloom.operators import search as S
from opsloom.plans import bindings as B
from opsloom.plans.sqltext import any_like

c = F.col
K = 10


def _kb(spark, d):
    return B.documents(spark, d)


def _vec(spark, d):
    return B.doc_vectors(spark, d)


def _ask_vec(spark, d):
    return B.ask_vectors(spark, d)


def _bm25_sql(name: str, docs: str, asks: str = "v_ask", query: str = "query") -> str:
    """CTEs that leave ``name`` (query_id, doc_id, score)."""
    w = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    return f"""{name}_tok as (select doc_id, {w.format('content')} as w from {docs}),
{name}_stat as (select count(*) as n, avg(len(w)) as avgdl from {name}_tok),
{name}_cnt as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as term
  from {name}_tok) group by 1, 2, 3),
{name}_idf as (select term, ln(1.0 + ((select n from {name}_stat) - count(*) + 0.5) / (count(*) + 0.5)) as idf
  from {name}_cnt group by 1),
{name}_ask as (select distinct query_id, unnest({w.format(query)}) as term from {asks}),
{name} as (select query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl /
  (select avgdl from {name}_stat)))), 9) as score
  from {name}_cnt join {name}_idf using (term) join {name}_ask using (term) group by 1, 2)"""


def _top_sql(name: str, source: str, k: int = K, score: str = "score", where: str = "") -> str:
    return (f"{name} as (select * from (select *, row_number() over (partition by query_id "
            f"order by {score} desc, doc_id) as rank from {source} {where}) where rank <= {k})")


_VEC = """vec as (select query_id, doc_id, round(list_cosine_similarity(q.vector, x.vector), 9) as score
  from v_ask_vec q, v_doc_vec x)"""
BASE = f"with {B.DOCUMENTS}, {B.ASKS}, {_bm25_sql('bm', 'v_kb')}, {_VEC}"
_R6 = "round({}, 6)"


def _r(name):
    return F.round(name, 6).alias(name)


# ------------------------------------------------------------------ single lists
def bm25_top(spark, d):
    return S.bm25_search(_kb(spark, d), B.asks(spark, d), K).select("query_id", "doc_id", _r("score"), "rank")


def bm25_titled(spark, d):
    """Relevance over title and content of one source with a positive score."""
    docs = _kb(spark, d).filter(FL.search_filter(source_type="gitlab")).withColumn(
        "content", F.concat_ws(" ", "title", "content"))
    return S.bm25_search(docs, B.asks(spark, d), 5).filter("score > 0").select("query_id", "doc_id", _r("score"))


def bm25_filtered(spark, d):
    docs = _kb(spark, d).filter(FL.search_filter(
        service=["service-b", "service-a"], level="ERROR", log_file="incident_00*.log", lines=(20, 60)))
    return S.bm25_search(docs, B.asks(spark, d), K).select("query_id", "doc_id", _r("score"), "rank")


def vector_top(spark, d):
    return S.vector_search(_vec(spark, d), _ask_vec(spark, d), K, 0.1).select(
        "query_id", "doc_id", _r("score"), _r("certainty"), "rank")


def vector_filtered(spark, d):
    docs = _vec(spark, d).join(_kb(spark, d).filter(FL.search_filter(source_type="wiki")).select("doc_id"), "doc_id")
    return S.vector_search(docs, _ask_vec(spark, d), K, 0.6).select("query_id", "doc_id", _r("certainty"))


def vector_threshold(spark, d):
    return S.similar_rows(_vec(spark, d), _ask_vec(spark, d), least=0.25).select("query_id", "doc_id", _r("score"))


def euclidean_nearest(spark, d):
    return S.similar_rows(_vec(spark, d), _ask_vec(spark, d), 5, metric="euclidean").select(
        "query_id", "doc_id", _r("score"))


def similar_documents(spark, d):
    """Five nearest other documents of every document."""
    docs = _vec(spark, d)
    return S.similar_rows(docs, docs.withColumnRenamed("doc_id", "query_id"), 5, not_self=True).select(
        "query_id", "doc_id", _r("score"), "rank")


def pair_similarity(spark, d):
    """Cosine and distance of each question vector with the document of the same id, as columns."""
    both = _ask_vec(spark, d).join(_vec(spark, d).select("doc_id", c("vector").alias("other")),
                                  (c("query_id") * 7 + 3) == c("doc_id"))
    mixed = V.weighted_mean(c("vector"), c("other"))
    return both.select("query_id", "doc_id", F.round(V.cosine(c("vector"), c("other")), 6).alias("cosine"),
                       F.round(V.euclidean(c("vector"), c("other")), 6).alias("distance"),
                       F.round(V.cosine(mixed, c("other")), 6).alias("mixed_cosine"))


PAIR_SQL = f"""with {B.ASKS}, p as (select query_id, doc_id, q.vector as a, x.vector as b from v_ask_vec q
  join v_doc_vec x on q.query_id * 7 + 3 = doc_id),
m as (select *, list_transform(list_zip(a, b), lambda z: 0.3 * z[1] + 0.7 * z[2]) as mix from p)
select query_id, doc_id, round(list_cosine_similarity(a, b), 6) as cosine, round(list_distance(a, b), 6) as distance,
  round(list_cosine_similarity(mix, b), 6) as mixed_cosine from m"""


# ------------------------------------------------------------------ hybrid
def _lists(spark, d, k):
    v = S.similar_rows(_vec(spark, d), _ask_vec(spark, d), k)
    t = S.bm25_search(_kb(spark, d), B.asks(spark, d), k)
    sure = v.withColumn("score", F.round(V.certainty(c("score")), 9))
    return sure, t


def hybrid_by_id(spark, d):
    v, t = _lists(spark, d, K)
    return S.fuse_by_id(v, t, K).select("query_id", "doc_id", _r("embedding_score"), _r("fulltext_score"),
                                        _r("final_score"), "search_source", "rank")


_LISTS = f"""{_top_sql('vt0', 'vec')}, vt as (select query_id, doc_id, round((score + 1) / 2, 9) as score, rank from vt0),
{_top_sql('bt', 'bm')}"""
_HYBRID = f"""fused as (select query_id, doc_id, coalesce(vt.score, 0.0) as embedding_score,
  coalesce(bt.score, 0.0) as fulltext_score, case when bt.score is null then 'embedding' when vt.score is null then
  'fulltext' else 'hybrid' end as search_source,
  round(coalesce(vt.score, 0.0) * 0.7::double + coalesce(bt.score, 0.0) * (1 - 0.7::double), 9) as final_score
  from vt full outer join bt using (query_id, doc_id))"""


def _content_lists(spark, d, k):
    v, t = _lists(spark, d, k)
    kb = _kb(spark, d).select("doc_id", "content", "title", "service_name")
    return v.join(kb, "doc_id"), t.join(kb, "doc_id")


def hybrid_by_content(spark, d):
    v, t = _content_lists(spark, d, K)
    return S.fuse_by_content(v, t, 20).select("query_id", "doc_id", _r("vector_score"), _r("bm25_score"),
                                              _r("hybrid_score"), "rank")


_CONTENT = """vc as (select query_id, content, last(score order by rank, doc_id) as vs, first(doc_id order by rank, doc_id)
  as vd from vt join v_kb using (doc_id) group by 1, 2),
bc as (select query_id, content, last(score order by rank, doc_id) as bs, first(doc_id order by rank, doc_id) as bd
  from bt join v_kb using (doc_id) group by 1, 2),
cf as (select query_id, coalesce(vd, bd) as doc_id, content, coalesce(vs, 0.0) as vector_score,
  coalesce(bs, 0.0) as bm25_score, round(least(coalesce(vs, 0.0), 1.0) * 0.6::double +
  least(coalesce(bs, 0.0) / 3.0::double, 1.0) * (1 - 0.6::double), 9) as hybrid_score
  from vc full outer join bc using (query_id, content))"""


def service_first(spark, d):
    v, t = _content_lists(spark, d, K)
    fused = S.fuse_by_content(v, t, K).join(
        B.asks(spark, d).select("query_id", c("asked_service").alias("query")), "query_id")
    hits = fused.join(_kb(spark, d).select("doc_id", "service_name"), "doc_id")
    return S.service_first(hits, K).select("query_id", "doc_id", "service_name", "named", _r("hybrid_score"), "rank")


def rank_fusion(spark, d):
    v, t = _lists(spark, d, K)
    return S.rank_fusion(v, t, 0.7).select("query_id", "doc_id", "hybrid_score")


def capped_fusion_unique(spark, d):
    """Capped score fusion, then one hit per title and content."""
    v, t = _lists(spark, d, K)
    both = v.select("query_id", "doc_id", c("score").alias("v")).join(
        t.select("query_id", "doc_id", c("score").alias("b")), ["query_id", "doc_id"], "full_outer").na.fill(0.0)
    scored = both.withColumn("final_score", F.round(S.capped_score(c("v"), c("b")), 9)).join(
        _kb(spark, d).select("doc_id", "title", "content"), "doc_id")
    return S.best_per_text(scored, ["query_id"]).select("query_id", "content_hash", "doc_id", _r("final_score"))


CAPPED_SQL = f"""{BASE}, {_LISTS},
f as (select query_id, doc_id, round(coalesce(vt.score, 0.0) * 0.7::double +
  least(coalesce(bt.score, 0.0) / 10.0::double, 1.0) * 0.3::double, 9) as s
  from vt full outer join bt using (query_id, doc_id)),
h as (select f.*, md5(concat(title, ':', content)) as content_hash from f join v_kb using (doc_id))
select query_id, content_hash, first(doc_id order by s desc, doc_id) as doc_id, round(max(s), 6) as final_score
from h group by 1, 2"""


def retrieval_quality(spark, d):
    """Hybrid list against the documents that share the asked service."""
    v, t = _lists(spark, d, K)
    fused = S.fuse_by_id(v, t, K)
    wanted = B.asks(spark, d).join(_kb(spark, d).select("doc_id", "service_name"),
                                  c("asked_service") == c("service_name")).select("query_id", "doc_id")
    return S.retrieval_quality(fused, wanted, K)


QUALITY_SQL = f"""{BASE}, {_LISTS}, {_HYBRID}, {_top_sql('ranked', 'fused', K, 'final_score')},
wanted as (select query_id, doc_id from v_ask join v_kb on asked_service = service_name),
n as (select query_id, count(*) as w from wanted group by 1),
g as (select query_id, count(wanted.doc_id)::double as f,
  sum(case when wanted.doc_id is not null then 1 / log2(rank + 1) else 0 end) as dcg
  from ranked left join wanted using (query_id, doc_id) group by 1),
s as (select query_id, coalesce(f, 0) / 10 as p, coalesce(f, 0) / w as r, coalesce(dcg, 0) /
  list_sum(list_transform(range(1, least(w, 10) + 1), lambda i: 1 / log2(i + 1))) as nd from n left join g using (query_id))
select query_id, round(p, 6) as precision, round(r, 6) as recall,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, round(nd, 6) as ndcg from s"""


def error_first_logs(spark, d):
    """Half the hits from ERROR rows, half from any level, in one list that keeps repeats."""
    kb, asks = _kb(spark, d), B.asks(spark, d)
    errors = S.bm25_search(kb.filter(FL.search_filter(level="ERROR")), asks, 5)
    any_level = S.bm25_search(kb, asks, 5)
    return errors.withColumn("part", F.lit("error")).unionByName(any_level.withColumn("part", F.lit("any"))).select(
        "query_id", "doc_id", "part", _r("score"), "rank")


def knowledge_hits(spark, d):
    """Vector hits, then hits of the widened question, first row per document."""
    kb, asks = _kb(spark, d).filter(FL.search_filter(source_type="wiki")), B.asks(spark, d)
    wide = asks.withColumn("query", F.concat("query", F.lit(R.KNOWLEDGE_QUERY_SUFFIX)))
    docs = _vec(spark, d).join(kb.select("doc_id"), "doc_id")
    v = S.similar_rows(docs, _ask_vec(spark, d), 5).withColumn("source", F.lit(0))
    t = S.bm25_search(kb, wide, 5).withColumn("source", F.lit(1))
    both = v.unionByName(t)
    return S.best_per(both, ["query_id", "doc_id"], [F.asc("source"), F.asc("rank")], 1, "n").select(
        "query_id", "doc_id", "source", _r("score"))


def similar_cases(spark, d):
    """Past cases near each question: nearest five documents that tell of a solution."""
    hits = S.similar_rows(_vec(spark, d), _ask_vec(spark, d), 5).join(_kb(spark, d), "doc_id")
    return hits.filter(D.is_case(c("title"), c("content"))).select("query_id", "doc_id", _r("score"))


def log_search_plain(spark, d):
    """Filters without a question: newest lines of the asked services and levels."""
    kb = _kb(spark, d).filter(FL.search_filter(service=["service-a", "service-b"], level=["ERROR", "WARN"]))
    return kb.orderBy(F.desc("line_number"), "doc_id").limit(100).select("doc_id", "service_name", "log_level",
                                                                         "line_number")


def filtered_hybrid(spark, d):
    """One call: filters on level and source, then vector and text hits fused."""
    rows = _kb(spark, d).join(_vec(spark, d), "doc_id", "left")
    hits = S.search_rows(rows, K, "hybrid", FL.search_filter(source_type=["wiki", "jira"], level=["ERROR", "WARN"]),
                         B.asks(spark, d), _ask_vec(spark, d))
    return hits.select("query_id", "doc_id", _r("final_score"), "search_source", "rank")


FILTERED_HYBRID_SQL = f"""{BASE}, kept as (select doc_id, content from v_kb where source_type in ('wiki', 'jira') and log_level in
  ('ERROR', 'WARN')), {_bm25_sql('bk', 'kept')}, vk as (select vec.* from vec join kept using (doc_id)),
{_LISTS.replace("from vec ", "from vk ").replace("from bm ", "from bk ")}, {_HYBRID}, {_top_sql('t', 'fused', K, 'final_score')}
select query_id, doc_id, round(final_score, 6) as final_score, search_source, rank from t"""


def leader_clusters(spark, d):
    items = B.table(spark, d, "embeddings").select(c("vec_id").alias("item_id"), c("embedding").alias("vector"))
    return leaders.leader_clusters(items, 0.3)


def text_clusters(spark, d):
    """Near copies of whole texts: leader clusters over hashed term vectors."""
    docs = B.table(spark, d, "documents").select(c("doc_id").alias("item_id"), c("text").alias("content"))
    return leaders.leader_clusters(V.encode_texts(docs)).groupBy("leader_id").agg(F.count("*").alias("n"))


def text_vectors(spark, d):
    docs = _kb(spark, d).withColumn("content", V.document_text(c("title"), c("content")))
    return V.encode_texts(docs).select("doc_id", F.size("vector").alias("dims"),
                                       F.round(V.norm(c("vector")), 4).alias("length"))


LEADER_SQL = """with recursive it as (select row_number() over (order by vec_id) as k, vec_id, embedding::double[] as v from embeddings),
r as (select cast(0 as bigint) as k, cast(null as bigint) as item_id, cast(null as bigint) as leader_id, cast([] as struct(id bigint, v double[])[]) as ls
  union all select k, vec_id, coalesce(f, vec_id), case when f is null then list_append(ls, {'id': vec_id, 'v': v}) else ls end from (
    select it.k, vec_id, it.v as v, ls, (list_filter(ls, lambda z: round(list_cosine_similarity(z.v, it.v), 9) > 0.3))[1].id as f
    from r join it on it.k = r.k + 1))
select item_id, leader_id from r where item_id is not null"""


QUERIES = {
    "bm25_top": (bm25_top, f"{BASE}, {_top_sql('t', 'bm')} select query_id, doc_id, round(score, 6) as score, rank from t"),
    "bm25_titled": (bm25_titled, f"""with {B.DOCUMENTS}, {B.ASKS}, docs as (select doc_id,
      concat_ws(' ', title, content) as content from v_kb where source_type = 'gitlab'), {_bm25_sql('bm', 'docs')},
      {_top_sql('t', 'bm', 5)} select query_id, doc_id, round(score, 6) as score from t where score > 0"""),
    "bm25_filtered": (bm25_filtered, f"""with {B.DOCUMENTS}, {B.ASKS}, docs as (select doc_id, content from v_kb where
      service_name in ('service-b', 'service-a') and log_level = 'ERROR' and log_file like 'incident\\_00%.log' escape '\\'
      and line_number between 20 and 60), {_bm25_sql('bm', 'docs')}, {_top_sql('t', 'bm')}
      select query_id, doc_id, round(score, 6) as score, rank from t"""),
    "vector_top": (vector_top, f"""{BASE}, {_top_sql('t', 'vec')} select query_id, doc_id, round(score, 6) as score,
      round((score + 1) / 2, 6) as certainty, rank from t where (score + 1) / 2 >= 0.1"""),
    "vector_filtered": (vector_filtered, f"""{BASE}, f as (select vec.* from vec join v_kb using (doc_id)
      where source_type = 'wiki'), {_top_sql('t', 'f')} select query_id, doc_id, round((score + 1) / 2, 6) as certainty
      from t where round((score + 1) / 2, 9) >= 0.6"""),
    "vector_threshold": (vector_threshold, f"{BASE} select query_id, doc_id, round(score, 6) as score from vec "
                         "where score >= 0.25"),
    "euclidean_nearest": (euclidean_nearest, f"""with {B.ASKS}, e as (select query_id, doc_id,
      round(list_distance(q.vector, x.vector), 9) as score from v_ask_vec q, v_doc_vec x)
      select query_id, doc_id, round(score, 6) as score from (select *, row_number() over (partition by query_id
      order by score, doc_id) as r from e) where r <= 5"""),
    "similar_documents": (similar_documents, f"""with {B.ASKS}, e as (select a.doc_id as query_id, b.doc_id,
      round(list_cosine_similarity(a.vector, b.vector), 9) as score from v_doc_vec a join v_doc_vec b
      on a.doc_id <> b.doc_id), {_top_sql('t', 'e', 5)}
      select query_id, doc_id, round(score, 6) as score, rank from t"""),
    "pair_similarity": (pair_similarity, PAIR_SQL),
    "hybrid_by_id": (hybrid_by_id, f"""{BASE}, {_LISTS}, {_HYBRID}, {_top_sql('t', 'fused', K, 'final_score')}
      select query_id, doc_id, round(embedding_score, 6) as embedding_score, round(fulltext_score, 6) as fulltext_score,
      round(final_score, 6) as final_score, search_source, rank from t"""),
    "hybrid_by_content": (hybrid_by_content, f"""{BASE}, {_LISTS}, {_CONTENT}, {_top_sql('t', 'cf', 20, 'hybrid_score')}
      select query_id, doc_id, round(vector_score, 6) as vector_score, round(bm25_score, 6) as bm25_score,
      round(hybrid_score, 6) as hybrid_score, rank from t"""),
    "service_first": (service_first, f"""{BASE}, {_LISTS}, {_CONTENT}, {_top_sql('t', 'cf', K, 'hybrid_score')},
      n as (select query_id, doc_id, service_name, contains(service_name, asked_service) as named, hybrid_score
        from t join v_ask using (query_id) join v_kb using (doc_id))
      select query_id, doc_id, service_name, named, round(hybrid_score, 6) as hybrid_score, row_number() over
        (partition by query_id order by named desc, hybrid_score desc, doc_id) as rank from n"""),
    "rank_fusion": (rank_fusion, f"""{BASE}, {_LISTS}, u as (select query_id, doc_id, 0.7 / (60 + rank) as p from vt
      union all select query_id, doc_id, 0.3 / (60 + rank) from bt)
      select query_id, doc_id, round(sum(p::double), 9) as hybrid_score from u group by 1, 2"""),
    "capped_fusion_unique": (capped_fusion_unique, CAPPED_SQL),
    "retrieval_quality": (retrieval_quality, QUALITY_SQL),
    "error_first_logs": (error_first_logs, f"""{BASE}, err as (select doc_id, content from v_kb where log_level = 'ERROR'),
      {_bm25_sql('be', 'err')}, {_top_sql('t1', 'be', 5)}, {_top_sql('t2', 'bm', 5)}
      select query_id, doc_id, 'error' as part, round(score, 6) as score, rank from t1
      union all select query_id, doc_id, 'any', round(score, 6), rank from t2"""),
    "knowledge_hits": (knowledge_hits, f"""{BASE}, wiki as (select doc_id, content from v_kb where source_type = 'wiki'),
      wide as (select query_id, concat(query, '{R.KNOWLEDGE_QUERY_SUFFIX}') as query from v_ask),
      {_bm25_sql('bw', 'wiki', 'wide')}, wv as (select vec.* from vec join wiki using (doc_id)),
      {_top_sql('t1', 'wv', 5)}, {_top_sql('t2', 'bw', 5)},
      u as (select query_id, doc_id, 0 as source, score, rank from t1
        union all select query_id, doc_id, 1, score, rank from t2)
      select query_id, doc_id, source, round(score, 6) as score from (select *, row_number() over
        (partition by query_id, doc_id order by source, rank) as n from u) where n = 1"""),
    "similar_cases": (similar_cases, f"""{BASE}, {_top_sql('t', 'vec', 5)} select query_id, doc_id,
      round(score, 6) as score from t join v_kb using (doc_id)
      where {any_like("concat(lower(title), lower(content))", R.CASE_WORDS)}"""),
    "log_search_plain": (log_search_plain, f"""with {B.DOCUMENTS} select doc_id, service_name, log_level, line_number
      from v_kb where service_name in ('service-a', 'service-b') and log_level in ('ERROR', 'WARN')
      order by line_number desc, doc_id limit 100"""),
    "filtered_hybrid": (filtered_hybrid, FILTERED_HYBRID_SQL),
    "leader_clusters": (leader_clusters, LEADER_SQL),
    "text_clusters": (text_clusters, None),
    "text_vectors": (text_vectors, None),
}
