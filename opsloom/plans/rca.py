"""Named queries of root-cause analysis: questions with evidence from search and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions import requests as Q
from opsloom.operators import graph as G
from opsloom.operators import rca as C
from opsloom.operators import search as S
from opsloom.plans import bindings as B
from opsloom.plans.logs import as_of
from opsloom.plans.search import _CONTENT, _LISTS, BASE, _bm25_sql, _content_lists, _top_sql
from opsloom.plans.sqltext import any_like, quote

c = F.col


# ------------------------------------------------------------------ symptoms of questions
def symptoms(spark, d):
    return Q.symptom_rows(B.questions(spark, d)).select("query_id", "symptom_type", "keyword", "confidence")


_SYM = " union all ".join(f"select query_id, '{k}' as symptom_type, '{w}' as keyword from v_question "
                          f"where contains(lower(query), '{w}')" for k, ws in R.SYMPTOM_WORDS for w in ws)


def symptom_levels(spark, d):
    q = c("query")
    return B.questions(spark, d).select("query_id", Q.symptom_severity(q).alias("severity"),
                                        Q.symptom_category(q).alias("category"),
                                        F.size(Q.question_symptoms(q)).alias("named"))


_W = dict(R.SYMPTOM_WORDS)
_LOWQ = "lower(query)"
_CATEGORY = (f"case when {any_like(_LOWQ, _W['performance'])} then 'performance' when {any_like(_LOWQ, _W['error'])} then "
             f"'functional' when {any_like(_LOWQ, _W['availability'])} then 'availability' else 'general' end")
LEVEL_SQL = f"""with {B.QUESTIONS} select query_id, case when {any_like(_LOWQ, R.HIGH_SEVERITY_WORDS)} then 'high'
  when {any_like(_LOWQ, R.MEDIUM_SEVERITY_WORDS)} then 'medium' else 'low' end as severity, {_CATEGORY} as category,
  {' + '.join(f"contains({_LOWQ}, '{w}')::int" for w, *_ in R.QUESTION_SYMPTOMS)} as named from v_question"""


def symptom_causes(spark, d):
    return C.symptom_cause_table(B.questions(spark, d))


_CAUSES = ", ".join(f"('{k}', '{n}', {v}::double, '{t}')" for k, n, v, t in R.CAUSES_OF_SYMPTOM)
CAUSE_CTE = f"""{B.QUESTIONS}, sym as (select distinct query_id, symptom_type from ({_SYM})),
rule(symptom_type, cause, conf, cause_type) as (values {_CAUSES}),
causes as (select query_id, cause, first(cause_type order by conf desc) as cause_type, max(conf) as confidence
  from sym join rule using (symptom_type) group by 1, 2)"""


def solution_ranking(spark, d):
    return C.solution_scores(C.symptom_cause_table(B.questions(spark, d))).select(
        "query_id", "cause", "solution", F.round("score", 6).alias("score"), "rank", "priority")


_SOL = ", ".join(f"('{t}', '{s}', {f}::double, {i}::double, {r}::double, {h}::double)"
                 for t, s, f, i, r, h in R.SOLUTIONS_OF_CAUSE)
SOLUTION_CTE = f"""{CAUSE_CTE}, opt(kind, solution, f, i, r, h) as (values {_SOL}),
sc as (select query_id, cause, solution, r as risk, round((f * 0.3::double + i * 0.4::double + (1 - r) * 0.2::double +
  (1 - least(h / 24, 1.0)) * 0.1::double) * confidence, 9) as score from causes join opt on kind = case when cause_type in
  ('resource', 'configuration', 'software') then cause_type else '' end),
ranked as (select * from (select *, row_number() over (partition by query_id order by score desc, solution, cause) as rank
  from sc) where rank <= 5)"""


def recommendations(spark, d):
    q = B.questions(spark, d)
    return C.recommendations(q, C.solution_scores(C.symptom_cause_table(q))).select(
        "query_id", "recommendation", F.round("confidence", 6).alias("confidence"), "risk_assessment", "alternatives",
        "success_metrics")


_METRICS = " ".join(f"when '{k}' then '{'|'.join(v)}'" for k, v in R.SUCCESS_METRICS.items() if k)
RECOMMEND_SQL = f"""with {SOLUTION_CTE}, alt as (select query_id, string_agg(solution, '|' order by rank) as alternatives
  from ranked where rank between 2 and 4 group by 1)
select r.query_id, solution as recommendation, round(score, 6) as confidence, case when risk > 0.7 then
  '{R.RISK_BANDS[0][1]}' when risk > 0.4 then '{R.RISK_BANDS[1][1]}' else '{R.RISK_BANDS[2][1]}' end as risk_assessment,
  alternatives, case {_CATEGORY} {_METRICS} else '{'|'.join(R.SUCCESS_METRICS[''])}' end as success_metrics
from ranked r join v_question using (query_id) left join alt using (query_id) where rank = 1"""


# ------------------------------------------------------------------ causes from evidence
def _evidence(spark, d):
    v, t = _content_lists(spark, d, 7)
    fused = S.fuse_by_content(v, t, 15)
    return fused.join(B.documents(spark, d).select("doc_id", "service_name", "log_level", "log_file", "line_number",
                                                   "source_type", "title", "category"), "doc_id")


def log_causes(spark, d):
    return C.log_causes(_evidence(spark, d)).select("query_id", F.md5("cause").alias("cause_md5"),
                                                   F.round("confidence", 6).alias("confidence"), "source")


def _any(words, text="lower(content)"):
    return any_like(text, words)


_FAIL = _any(R.FAILURE_WORDS)
_CPU = f"(contains(lower(content), 'cpu') and {_any(['high', 'critical', '过高'])})"
_MEM = _any(["memory", "内存"])
_USE = f"({_any(['usage', '使用'])} or {any_like('content', ['MB', 'GB', '%'])})"
_NET = _any(["timeout", "connection"])
_IO = _any(["disk", "io"])
_LISTS7 = _LISTS.replace("rank <= 10", "rank <= 7")
EVIDENCE_CTE = f"""{_LISTS7}, {_CONTENT}, {_top_sql('ev0', 'cf', 15, 'hybrid_score')},
ev as (select ev0.query_id, ev0.doc_id, ev0.content, hybrid_score, rank, service_name, log_level, log_file, line_number,
  source_type, title, category from ev0 join v_kb using (doc_id)),
lc as (select query_id, case when {_FAIL} then concat(service_name, '服务出现故障: ', substr(content, 1, 50), '...')
    when {_CPU} then concat(service_name, '服务CPU资源不足')
    when {_MEM} and {_USE} then concat(service_name, '服务内存使用情况: ', content)
    when {_MEM} then concat(service_name, '服务内存相关问题') when {_NET} then concat(service_name, '服务连接超时')
    when {_IO} then concat(service_name, '服务磁盘IO问题')
    when hybrid_score > 0.7 then concat(service_name, '服务可能存在问题: ', substr(content, 1, 50), '...') end as cause,
  round(case when {_FAIL} or {_CPU} or {_MEM} or {_NET} or {_IO} then hybrid_score else hybrid_score * 0.8::double end, 9)
    as confidence, 'log' as evidence_type, service_name as source
  from ev where trim(service_name) not in ('', 'unknown', 'documentation')),
logcause as (select * from lc where cause is not null)"""


def _asked_relations(spark, d):
    """Relations of the service each question asks about, from deployments and calls."""
    rel = B.edges(spark, d).filter("type in ('CALLS', 'DEPLOYED_ON')").select(
        c("src").alias("from_service"), c("dst").alias("to_service"),
        F.when(c("type") == "CALLS", "DEPENDS_ON").otherwise(c("type")).alias("relation"))
    named = B.asks(spark, d).select("query_id", F.concat(F.lit("service-"), c("query_id") % 50).alias("from_service"))
    return named.join(rel, "from_service")


_REL = f"""rel as (select item_id as query_id, src as from_service, dst as to_service, case type when 'CALLS' then
  'DEPENDS_ON' else type end as relation from benchmark join v_edge on src = concat('service-', item_id % 50)
  where type in ('CALLS', 'DEPLOYED_ON')),
rc as (select query_id, case relation when 'DEPENDS_ON' then concat(from_service, '依赖的', to_service, '服务问题')
    else concat(to_service, '主机资源问题') end as cause, case relation when 'DEPENDS_ON' then 0.7::double else 0.6 end
    as confidence, case relation when 'DEPENDS_ON' then 'dependency' else 'deployment' end as evidence_type,
  from_service as source from (select *, row_number() over (partition by query_id order by from_service, to_service,
    relation) as n from rel) where n <= 3)"""


def relation_causes(spark, d):
    return C.relation_causes(_asked_relations(spark, d))


def _root_causes(spark, d):
    return C.rank_causes(B.asks(spark, d), C.log_causes(_evidence(spark, d)),
                         C.relation_causes(_asked_relations(spark, d)))


def root_causes(spark, d):
    """End to end: questions, hybrid search, topology, causes in order."""
    return _root_causes(spark, d).select("query_id", "rank", F.md5("cause").alias("cause_md5"),
                                         F.round("confidence", 6).alias("confidence"), "evidence_type", "source")


RANKED = f"""{EVIDENCE_CTE}, {B.EDGES}, {_REL}, allc as (select * from logcause union all select * from rc),
causes as (select *, row_number() over (partition by query_id order by confidence desc, cause, evidence_type) as rank
  from allc where not (contains(cause, 'None') or contains(cause, 'unknown') or source in ('None', 'unknown')
  or trim(cause) = ''))"""


def cause_solutions(spark, d):
    return C.cause_solutions(_root_causes(spark, d)).select("query_id", "rank", "solution", "priority", "minutes")


def _solution_case(i):
    arms = []
    for word, *values in R.CAUSE_SOLUTIONS:
        mem = "(contains(cause, '内存') or contains(lower(cause), 'memory'))"
        test = {"内存": mem, "内存使用情况": f"({mem} and (contains(cause, '使用情况') or contains(lower(cause), 'usage')))"}.get(
            word, f"contains(cause, {quote(word)})")
        arms.append(f"when {test} then {quote(values[i]) if isinstance(values[i], str) else values[i]}")
    return "case " + " ".join(arms) + " end"


def evidence_mismatch(spark, d):
    asks = B.asks(spark, d).withColumn("query", F.concat("query", F.lit(" service-d1")))
    return C.evidence_mismatch(asks, _evidence(spark, d))


def evidence_files(spark, d):
    """First five log hits per question with file, line and score, and counts by type."""
    ev = _evidence(spark, d).filter("source_type = 'wiki'")
    return S.best_per(ev.drop("rank"), ["query_id"], [F.desc("hybrid_score"), F.asc("doc_id")], 5).select(
        "query_id", "rank", "log_file", "line_number", F.round("hybrid_score", 6).alias("score"))


def evidence_types(spark, d):
    """Distinct evidence files and hits by source type."""
    return _evidence(spark, d).select("query_id", "source_type", "log_file").distinct().groupBy("source_type").agg(
        F.count("*").alias("files"), F.countDistinct("query_id").alias("questions"))


# ------------------------------------------------------------------ relevance and balanced merge
def _relevance(spark, d):
    asks = B.asks(spark, d)
    kb = B.documents(spark, d)
    bm = S.bm25_search(kb, asks, 10).join(asks.select("query_id", "query"), "query_id").join(kb, "doc_id")
    when = (as_of().cast("double") - (c("doc_id") % 60) * 3600).cast("timestamp")
    logs = bm.select("query_id", F.lit("log").alias("result_type"), c("doc_id").cast("string").alias("item_id"), "log_level",
                     C.log_relevance(c("query"), c("log_level"), when, c("content"), c("service_name"), c("score") / 100,
                                     as_of()).alias("relevance"))
    docs = bm.select("query_id", F.lit("knowledge").alias("result_type"), c("doc_id").cast("string").alias("item_id"),
                     F.lit(None).cast("string").alias("log_level"),
                     C.knowledge_relevance(c("query"), c("category"), c("title"), c("content"), c("score") / 100)
                     .alias("relevance"))
    named = asks.select("query_id", "query", F.concat(F.lit("service-"), c("query_id") % 7).alias("name"))
    load = B.mentions(spark, d).filter("type = 'Service'").groupBy("name").agg(F.count("*").alias("related"))
    ents = named.join(load, "name").select(
        "query_id", F.lit("entity").alias("result_type"), c("name").alias("item_id"), F.lit(None).cast("string").alias("log_level"),
        C.entity_relevance(c("query"), F.lit("Service"), c("name"), F.least(c("related"), F.lit(5)), F.lit(0.5))
        .alias("relevance"))
    return logs.unionByName(docs).unionByName(ents)


def relevance_scores(spark, d):
    return _relevance(spark, d).select("query_id", "result_type", "item_id", F.round("relevance", 6).alias("relevance"))


def _sum(words, text, each):
    return " + ".join(f"(case when contains({text}, '{w}') then {each}::double else 0 end)" for w in words)


_BOTH = " + ".join(f"(case when contains(lower(content), '{w}') or contains(lower(query), '{w}') then 0.1::double else 0 end)"
                   for w in R.RELEVANCE_WORDS)
_QW = r"list_filter(regexp_split_to_array(trim(lower(query)), '\s+'), lambda w: length(w) > 2)"
RELEVANCE_CTE = f"""{_top_sql('bt', 'bm')}, hit as (select bt.query_id, bt.doc_id, score / 100 as score, query, content, title,
  category, service_name, log_level, (doc_id % 60) * 3600.0::double as age from bt join v_ask using (query_id)
  join v_kb using (doc_id)), {B.MENTIONS},
rel as (select query_id, 'log' as result_type, cast(doc_id as varchar) as item_id, log_level, round(least(1.0::double,
    (case log_level when 'ERROR' then 0.4::double when 'WARN' then 0.2 else 0 end) + (case when age < 86400 then
    0.2::double * (1 - age / 86400) else 0 end) + {_BOTH} + (case when service_name <> '' and
    contains(lower(query), lower(service_name)) then 0.3::double else 0 end) + score * 0.3::double), 9) as relevance from hit
  union all select query_id, 'knowledge', cast(doc_id as varchar), null, round(least(1.0::double,
    {_sum(R.KNOWLEDGE_TERMS, 'lower(title)', 0.2)} + {_sum(R.KNOWLEDGE_TERMS, 'lower(content)', 0.1)} +
    coalesce(list_sum(list_transform({_QW}, lambda w: (case when contains(lower(title), w) then 0.15::double else 0 end) +
      (case when contains(lower(content), w) then 0.1::double else 0 end))), 0) + score * 0.4::double), 9) from hit
  union all select query_id, 'entity', name, null, round(least(1.0::double, 0.4::double + (case when contains(lower(query), name)
    then 0.4::double when len(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '' and contains(name, w)))
    > 0 then 0.2 else 0 end) + least(least(n, 5) * 0.05::double, 0.2) + 0.1::double), 9)
    from (select query_id, query, concat('service-', query_id % 7) as name from v_ask) join (select name, count(*) as n
    from v_mention where type = 'Service' group by 1) using (name))""".replace("\\\\s", "\\s")


def balanced_evidence(spark, d):
    return C.merge_evidence(_relevance(spark, d), 12).select("query_id", "result_type", "item_id", "in_quota", "rank")


BALANCED_SQL = f"""{BASE}, {RELEVANCE_CTE}, t as (select *, row_number() over (partition by query_id, result_type order by
  relevance desc, item_id) as tr from rel), q as (select *, tr <= case result_type when 'log' then 6 when 'knowledge' then 4
  else 2 end as in_quota from t)
select query_id, result_type, item_id, in_quota, rank from (select *, row_number() over (partition by query_id order by
  in_quota desc, relevance desc, result_type, item_id) as rank from q) where rank <= 12"""


def best_evidence(spark, d):
    return C.merge_evidence(_relevance(spark, d), 12, "as_written").select("query_id", "result_type", "item_id", "rank")


def first_recommendations(spark, d):
    return C.first_recommendations(_relevance(spark, d))


def evidence_package(spark, d):
    """Ten logs, five documents and five entities of each question by relevance."""
    few = F.when(c("result_type") == "log", 10).otherwise(5)
    rows = S.best_per(_relevance(spark, d), ["query_id", "result_type"], [F.desc("relevance"), F.asc("item_id")], 10)
    return rows.filter(c("rank") <= few).select("query_id", "result_type", "item_id", "rank")


def key_information(spark, d):
    asks, kb = B.asks(spark, d), B.documents(spark, d)
    hits = S.bm25_search(kb, asks, 5).join(kb.select("doc_id", "title", "content"), "doc_id")
    ents = G.entities_by_word(B.nodes(spark, d).filter("type = 'Service'"), asks)
    info = C.key_information(hits, ents)
    return info.select("query_id", F.array_join("points", "|").alias("points"), F.size("solutions").alias("n_solutions"),
                       F.size("practices").alias("n_practices"), F.array_join("topics", "|").alias("topics"), "confidence")


def incident_timeline(spark, d):
    """Lines of the last two hours before the newest one that match the words, oldest first, fifty at most."""
    lines = B.log_lines(spark, d)
    newest = lines.agg(F.max("ts")).scalar()
    docs = lines.filter(c("ts") >= newest - F.expr("interval 2 hours")).select(
        c("line_number").alias("doc_id"), c("raw_line").alias("content"), "ts")
    asked = B.table(spark, d, "region").selectExpr("r_regionkey as query_id",
                                                   "element_at(array('timeout', 'database', 'memory', 'disk', 'redis'), r_regionkey + 1) as query")
    hits = S.bm25_search(docs.select("doc_id", "content"), asked, 50)
    return hits.join(docs.select("doc_id", "ts"), "doc_id").select(
        "query_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "doc_id").orderBy("query_id", "ts")


TIMELINE_SQL = f"""with {B.LOG_LINES}, docs as (select line_number as doc_id, raw_line as content, ts from v_log_line where
  ts >= (select max(ts) from v_log_line) - interval 2 hours), q as (select r_regionkey as query_id, ['timeout', 'database',
  'memory', 'disk', 'redis'][r_regionkey + 1] as query from region), {_bm25_sql('bm', 'docs', 'q')}, {_top_sql('t', 'bm', 50)}
select query_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as ts, doc_id from t join docs using (doc_id)"""


QUERIES = {
    "question_symptoms": (symptoms, f"with {B.QUESTIONS} select *, cast(0.8 as double) as confidence from ({_SYM})"),
    "symptom_levels": (symptom_levels, LEVEL_SQL),
    "symptom_causes": (symptom_causes, f"with {CAUSE_CTE} select * from causes"),
    "solution_ranking": (solution_ranking, f"""with {SOLUTION_CTE} select query_id, cause, solution, round(score, 6) as score,
      rank, case when score > 0.7 then '高' when score > 0.5 then '中' else '低' end as priority from ranked"""),
    "recommendations": (recommendations, RECOMMEND_SQL),
    "log_causes": (log_causes, f"""{BASE}, {EVIDENCE_CTE} select query_id, md5(cause) as cause_md5,
      round(confidence, 6) as confidence, source from logcause"""),
    "relation_causes": (relation_causes, f"with {B.EDGES}, {_REL} select * from rc"),
    "root_causes": (root_causes, f"""{BASE}, {RANKED} select query_id, rank, md5(cause) as cause_md5,
      round(confidence, 6) as confidence, evidence_type, source from causes where rank <= 3"""),
    "cause_solutions": (cause_solutions, f"""{BASE}, {RANKED}, s as (select query_id, rank, {_solution_case(0)} as solution,
      {_solution_case(1)} as priority, {_solution_case(2)} as minutes from causes where rank <= 2)
      select * from s where solution is not null"""),
    "evidence_mismatch": (evidence_mismatch, f"""{BASE}, {EVIDENCE_CTE}, s as (select query_id,
      bool_or(contains(lower(content), 'memory')) as m, bool_or({_IO}) as i from ev group by 1)
      select query_id, {any_like('lower(query)', ['内存', 'memory'])} and coalesce(i, false) and not coalesce(m, false)
      as mismatch from v_ask left join s using (query_id)"""),
    "evidence_files": (evidence_files, f"""{BASE}, {EVIDENCE_CTE} select query_id, r as rank, log_file, line_number,
      round(hybrid_score, 6) as score from (select *, row_number() over (partition by query_id order by hybrid_score desc,
      doc_id) as r from ev where source_type = 'wiki') where r <= 5"""),
    "evidence_types": (evidence_types, f"""{BASE}, {EVIDENCE_CTE} select source_type, count(*) as files,
      count(distinct query_id) as questions from (select distinct query_id, source_type, log_file from ev) group by 1"""),
    "relevance_scores": (relevance_scores, f"""{BASE}, {RELEVANCE_CTE} select query_id, result_type, item_id,
      round(relevance, 6) as relevance from rel"""),
    "balanced_evidence": (balanced_evidence, BALANCED_SQL),
    "best_evidence": (best_evidence, f"""{BASE}, {RELEVANCE_CTE} select query_id, result_type, item_id, rank from (select *,
      row_number() over (partition by query_id order by relevance desc, result_type, item_id) as rank from rel)
      where rank <= 12"""),
    "first_recommendations": (first_recommendations, f"""{BASE}, {RELEVANCE_CTE}, n as (select query_id,
      sum((result_type = 'log' and log_level = 'ERROR')::int)::int as e, sum((result_type = 'knowledge')::int)::int as k,
      sum((result_type = 'entity')::int)::int as t from rel group by 1)
      select query_id, '检查错误日志' as action, 'high' as priority, e as found from n where e > 0
      union all select query_id, '参考相关文档', 'medium', k from n where k > 0
      union all select query_id, '检查相关组件', 'medium', t from n where t > 0"""),
    "evidence_package": (evidence_package, f"""{BASE}, {RELEVANCE_CTE} select query_id, result_type, item_id, rank from (select *,
      row_number() over (partition by query_id, result_type order by relevance desc, item_id) as rank from rel)
      where rank <= case result_type when 'log' then 10 else 5 end"""),
    "key_information": (key_information, None),
    "incident_timeline": (incident_timeline, TIMELINE_SQL),
}
