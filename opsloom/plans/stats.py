"""Named queries of statistics, sessions, tasks, quality and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import graph as G
from opsloom.operators import stats as ST
from opsloom.plans import bindings as B
from opsloom.plans.logs import DERIVED_SQL, LINES_SQL, as_of, enriched, parsed_lines
from opsloom.plans.sqltext import any_like

c = F.col


def run_statistics(spark, d):
    rows = parsed_lines(spark, d).withColumn("source", F.substring_index("log_file", "_", 2))
    return ST.run_statistics(rows, "source", "log_file", c("pattern_used") == "fallback")


def table_counts(spark, d):
    return ST.table_counts({t: B.table(spark, d, t) for t in B.TABLES})


def document_counts(spark, d):
    return ST.document_counts(B.table(spark, d, "documents").select("source", c("lang").alias("category")))


def _entities(spark, d):
    return B.table(spark, d, "lineitem").select(
        F.concat(F.lit("part-"), "l_partkey").alias("name"), c("l_returnflag").alias("type"),
        c("l_shipdate").cast("timestamp").alias("ts"), c("l_discount").alias("confidence"))


def mention_counts(spark, d):
    """Mention statistics: first half of the lines is the snapshot, the rest the delta."""
    seen = _entities(spark, d)
    old = ST.add_mentions(seen.filter("confidence < 0.05"), ["name", "type"])
    out = ST.add_mentions(seen.filter("confidence >= 0.05"), ["name", "type"], old)
    return out.select("name", "type", "mention_count", F.date_format("last_mentioned", "yyyy-MM-dd").alias("last"), "confidence")


_ENT = """e as (select concat('part-', l_partkey) as name, l_returnflag as type, count(*) as mention_count,
  max(l_shipdate) as last_mentioned, first(l_discount order by l_shipdate desc, l_discount desc) as confidence
  from lineitem group by 1, 2)"""


def entity_statistics(spark, d):
    return ST.usage_by_type(ST.add_mentions(_entities(spark, d), ["name", "type"]), "mention_count")


def top_entities(spark, d):
    return ST.top_entities(ST.add_mentions(_entities(spark, d), ["name", "type"])).select("name", "type", "mention_count")


def relation_usage(spark, d):
    """Usage per (source, target, type), then per type."""
    seen = B.table(spark, d, "lineitem").select(
        c("l_suppkey").alias("source"), c("l_partkey").alias("target"), c("l_linestatus").alias("type"),
        c("l_shipdate").cast("timestamp").alias("ts"), c("l_discount").alias("confidence"))
    return ST.usage_by_type(ST.add_mentions(seen, ["source", "target", "type"]), "mention_count")


def service_impact(spark, d):
    return ST.service_impact(enriched(spark, d))


def error_progression(spark, d):
    return ST.error_progression(enriched(spark, d)).select("service_name", "line_number", "message")


def critical_events(spark, d):
    return ST.critical_events(enriched(spark, d)).select("service_name", "line_number", "event")


def system_totals(spark, d):
    t = {n: B.table(spark, d, n) for n in ("conversations", "documents", "orders", "events")}
    users = t["events"].agg(F.countDistinct("user_id")).scalar()
    return t["conversations"].agg(F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages")).select(
        users.alias("users"), "sessions", "messages",
        t["documents"].agg(F.count("*")).scalar().alias("documents"),
        t["orders"].filter("o_orderstatus = 'O'").agg(F.count("*")).scalar().alias("active_tasks"),
        t["orders"].filter("o_orderstatus = 'F'").agg(F.count("*")).scalar().alias("failed_tasks"),
        F.round(t["events"].agg(F.avg("value")).scalar(), 6).alias("mean_response"))


def session_page(spark, d):
    """Third page of twenty sessions by size, with the total."""
    sessions = B.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return ST.page(sessions, [F.desc("n"), F.asc("conv_id")], 3, 20)


def message_order(spark, d):
    m = B.table(spark, d, "conversations").select(c("conv_id").alias("session_id"), "turn", "role")
    return ST.message_order(m)


def session_messages(spark, d):
    """Messages joined to their session's first speaker and size."""
    conv = B.table(spark, d, "conversations")
    sessions = conv.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.count("*").alias("n"))
    return conv.join(sessions, "conv_id").filter("first_role = 'user'").select("conv_id", "turn", "role", "n")


def session_spans(spark, d):
    e = B.events(spark, d).select(c("user_id").alias("session_id"), c("ts").alias("created_at"))
    return ST.session_span(e).select("session_id", "messages", F.round("seconds", 3).alias("seconds"))


def _tasks(spark, d):
    return B.table(spark, d, "orders").select(
        c("o_orderkey").alias("task_id"), F.when(c("o_orderstatus") == "O", "pending").otherwise("done").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), c("o_orderdate").cast("timestamp").alias("created_at"),
        (c("o_orderdate").cast("timestamp") + F.make_dt_interval(c("o_custkey") % 100)).alias("scheduled_at"))


def ready_tasks(spark, d):
    return ST.ready_tasks(_tasks(spark, d), F.lit("1999-01-01").cast("timestamp"), 50).select("task_id", "priority")


def fresh_tasks(spark, d):
    at = F.lit("1998-06-02").cast("timestamp")
    return ST.fresh_tasks(_tasks(spark, d).filter(c("created_at") <= at), at, 24 * 30).groupBy("status").agg(F.count("*").alias("n"))


def _labelled(spark, d):
    rows = B.documents(spark, d).join(B.table(spark, d, "labels"), "doc_id", "left")
    return rows, [x for x in rows.columns if x != "doc_id"]


_FIELDS = [x for x in B._DOC if x != "doc_id"] + ["quality", "toxic"]
_NULLS = "(" + " + ".join(f"({x} is null)::int" for x in _FIELDS) + ")"


def quality_report(spark, d):
    """Rules over every field of the rows."""
    rows, fields = _labelled(spark, d)
    return ST.quality_report(rows, fields, "doc_id")["counts"]


def quality_first_rows(spark, d):
    rows, fields = _labelled(spark, d)
    return ST.quality_report(rows, fields, "doc_id")["first"]


def null_cells(spark, d):
    rows, fields = _labelled(spark, d)
    return ST.null_cells(rows, fields)


def distinct_values(spark, d):
    """Distinct services, levels and keywords of the log."""
    e = enriched(spark, d)
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    one = e.select(F.inline_outer(F.concat(
        F.array(pair("service", c("service_name")), pair("level", c("log_level"))),
        F.transform("keywords", lambda k: pair("keyword", k)))))
    return one.distinct()


def retention_actions(spark, d):
    rows = B.table(spark, d, "orders").select(
        F.element_at(F.array(*[F.lit(x) for x in ("chat_messages", "task_executions", "log_entries", "knowledge_documents")]),
                     (c("o_orderkey") % 4 + 1).cast("int")).alias("data_type"), c("o_orderdate").alias("created_at"))
    out = ST.retention(rows, F.lit("2000-06-01").cast("date"))
    return out.groupBy("data_type", "action").agg(F.count("*").alias("n"))


def lineage_upstream(spark, d):
    """Which tables each derived table comes from within three steps, over lineage records."""
    rec = B.table(spark, d, "nation").selectExpr("concat('t', n_nationkey) as src", "concat('t', (n_nationkey * 2 + 1) % 25) as dst",
                                                 "'transform' as type")
    starts = B.table(spark, d, "nation").selectExpr("concat('t', n_nationkey) as start")
    return G.reachable(rec, starts, 3, "in").select("start", "name", "distance")


LINEAGE_SQL = """with r as (select concat('t', n_nationkey) as s, concat('t', (n_nationkey * 2 + 1) % 25) as t from nation),
p1 as (select t as start, s as node, [s || t] as e from r), p2 as (select start, r.s as node, list_append(e, r.s || r.t) as e
  from p1 join r on r.t = node and not list_contains(e, r.s || r.t)),
p3 as (select start, r.s as node from p2 join r on r.t = node and not list_contains(e, r.s || r.t))
select distinct start, node as name, 1 as distance from p1 where start <> node union all
select distinct start, node, 2 from p2 where start <> node union all select distinct start, node, 3 from p3 where start <> node"""


def fault_spread(spark, d):
    """Services reached within three calls from those with a severe issue, with the impact distance."""
    severe = B.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("l_orderkey"))
    hit = B.table(spark, d, "lineitem").join(severe, "l_orderkey", "left_semi").select(
        F.concat(F.lit("service-"), "l_suppkey").alias("start")).distinct()
    out = G.reachable(B.edges(spark, d, True), hit, 3, "out", ["CALLS"])
    return out.groupBy("name").agg(F.min("distance").alias("distance"), F.countDistinct("start").alias("sources"))


SPREAD_SQL = f"""with {B.EDGES}, hit as (select distinct concat('service-', l_suppkey) as start from lineitem join orders on
  l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'), a as (select src, dst from v_edge where type = 'CALLS'),
p1 as (select start, dst as node, [src || '>' || dst] as e from hit join a on src = start),
p2 as (select start, dst as node, list_append(e, src || '>' || dst) as e from p1 join a on src = node
  and not list_contains(e, src || '>' || dst)),
p3 as (select start, dst as node from p2 join a on src = node and not list_contains(e, src || '>' || dst)),
u as (select start, node, 1 as d from p1 union all select start, node, 2 from p2 union all select start, node, 3 from p3)
select node as name, min(d) as distance, count(distinct start) as sources from u where start <> node group by 1"""


def cause_frequency(spark, d):
    """Ten components most often named as the cause of an issue."""
    return B.affects(spark, d).groupBy(c("component").alias("cause")).agg(F.count("*").alias("frequency")).orderBy(
        F.desc("frequency"), "cause").limit(10)


def similar_problem_solutions(spark, d):
    """Solutions of problems that share a part with the problem, best effect first, three per problem."""
    lines = B.table(spark, d, "lineitem")
    solved = lines.groupBy(c("l_partkey").alias("problem"), c("l_suppkey").alias("solution")).agg(F.max("l_discount").alias("effect"))
    like = B.table(spark, d, "part").select(c("p_partkey").alias("asked"), ((c("p_partkey") * 3 + 1) % 2000).alias("problem"))
    from opsloom.operators.search import best_per
    return best_per(like.join(solved, "problem"), ["asked"], [F.desc("effect"), F.asc("solution")], 3).select(
        "asked", "solution", "effect", "rank")


def store_differences(spark, d):
    """Whole documents against a copy with other languages, texts cut by a letter, missing and extra rows."""
    docs = B.table(spark, d, "documents")
    copy = docs.filter("doc_id % 11 <> 3").withColumn("lang", F.when(c("doc_id") % 7 == 0, "xx").otherwise(c("lang"))).unionByName(
        docs.filter("doc_id % 50 = 1").withColumn("doc_id", c("doc_id") + 1000000))
    copy = copy.withColumn("text", F.when(c("doc_id") % 13 == 5, F.expr("substr(text, 2)")).otherwise(c("text")))
    return ST.store_differences(docs, copy, "doc_id", [x for x in docs.columns if x != "doc_id"])


def erased_messages(spark, d):
    users = B.table(spark, d, "region").select(c("r_regionkey").cast("bigint").alias("conv_id"))
    rows = B.table(spark, d, "conversations").select("conv_id", "turn")
    kept = ST.erase_user(rows, users, "conv_id").withColumn("part", F.lit("kept"))
    return kept.unionByName(ST.export_user(rows, users, "conv_id").withColumn("part", F.lit("exported")))


def bulk_update(spark, d):
    """Key update and delete over a snapshot of suppliers."""
    s = B.table(spark, d, "supplier")
    new = s.filter("s_suppkey % 3 = 0").select("s_suppkey", (c("s_acctbal") + 1).alias("s_acctbal"))
    out = G.update_rows(s, new, "s_suppkey")
    return G.delete_rows(out, s.filter("s_suppkey % 7 = 6"), "s_suppkey").select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))


def model_quality(spark, d):
    rows = B.table(spark, d, "labels").withColumn("predicted", F.when(c("doc_id") % 6 == 0, 1 - c("quality")).otherwise(c("quality")))
    return ST.model_quality(rows, "predicted", "quality").withColumn("accuracy", F.round("accuracy", 6))


def parity(spark, d):
    rows = B.table(spark, d, "labels").join(B.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return ST.parity_difference(rows, "lang", "quality").withColumn("difference", F.round("difference", 6))


def benchmark_summary(spark, d):
    out = ST.benchmark_summary(B.events(spark, d), ["event_type"], "value", c("user_id") % 20 != 0)
    return out.select("event_type", "runs", *[F.round(x, 6).alias(x) for x in ("success", "mean", "p95", "per_second")])


def retrain_decisions(spark, d):
    names = ["performance_degradation", "data_drift", "knowledge_update", "scheduled_refresh"]
    m = B.table(spark, d, "customer").select(
        "c_nationkey", F.element_at(F.array(*[F.lit(n) for n in names]), (c("c_custkey") % 4 + 1).cast("int")).alias("trigger"),
        (c("c_acctbal") / 30000.0).alias("value"))
    return ST.retrain_decision(m, ["c_nationkey"])


def search_quality_means(spark, d):
    e = B.events(spark, d)
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("latency"),
                                       F.round(F.avg(c("user_id") / 150.0), 6).alias("relevance"),
                                       F.round(F.avg(F.when(c("value") < 50, 1.0).otherwise(0.0)), 6).alias("coverage"))


def dependency_guesses(spark, d):
    logs = enriched(spark, d).withColumn("message", F.concat(F.lit("call to "), F.lower("message")))
    return ST.dependency_guesses(logs)


def _stages(spark, d):
    names = ["ner_extraction", "hybrid_search", "topology_query", "agent_reasoning", "result_formatting"]
    return B.events(spark, d).select(
        c("user_id").alias("task_id"), F.element_at(F.array(*[F.lit(n) for n in names]), (c("event_id") % 5 + 1).cast("int")).alias("stage"),
        F.when(c("event_type") == "error", "pending").when(c("event_type") == "view", "in_progress").otherwise("completed").alias("status"),
        (c("value") / 500.0).alias("progress"), F.struct("ts", "event_id").alias("ts"), c("ts").alias("created_at"))


def task_progress(spark, d):
    return ST.task_progress(_stages(spark, d), as_of()).select(
        "task_id", F.round("progress", 6).alias("progress"), F.round("remaining_seconds", 2).alias("remaining_seconds"))


PROGRESS_SQL = """with s as (select user_id as task_id, ['ner_extraction', 'hybrid_search', 'topology_query', 'agent_reasoning',
  'result_formatting'][event_id % 5 + 1] as stage, case event_type when 'error' then 'pending' when 'view' then 'in_progress'
  else 'completed' end as status, value / 500 as progress, ts, event_id from events),
l as (select task_id, stage, last(status order by ts, event_id) as status, last(progress order by ts, event_id) as progress,
  min(ts) as c from s group by 1, 2),
p as (select task_id, sum(case stage when 'ner_extraction' then 0.1::double when 'hybrid_search' then 0.3 when 'topology_query' then 0.2
  when 'agent_reasoning' then 0.3 else 0.1 end * case status when 'completed' then 1.0::double when 'in_progress' then progress
  else 0 end) as p, epoch(timestamp '2024-02-01') - epoch(min(c)) as e from l group by 1)
select task_id, round(p, 6) as progress, round(case when p > 0 then greatest(0, e / p - e) end, 2) as remaining_seconds from p"""


def agent_progress(spark, d):
    agents = B.events(spark, d).groupBy(c("user_id").alias("task_id"), F.element_at(F.array(
        *[F.lit(a) for a in ("planner", "knowledge", "reasoning", "executor", "reviewer")]), (c("event_id") % 5 + 1).cast("int"))
        .alias("agent_id")).agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("s"))
    status = F.when(c("s.event_type") == "view", "working").when(c("s.event_type") == "error", "failed").otherwise("done")
    out = ST.agent_progress(agents.select("task_id", "agent_id", status.alias("status"), (c("s.value") / 500).alias("progress")))
    return out.select("task_id", F.round("progress", 6).alias("progress"), "completed")


AGENT_SQL = """with a as (select user_id as task_id, event_id % 5 as agent, last(event_type order by ts, event_id) as t,
  last(value order by ts, event_id) as v from events group by 1, 2)
select task_id, round(sum(case when t = 'view' then v / 500 else 1 end) / count(*), 6) as progress,
  coalesce(bool_and(t <> 'view') filter (agent <> 4), true) as completed from a group by 1"""


QUERIES = {
    "run_statistics": (run_statistics, f"""with {LINES_SQL}, s as (select *, split_part(log_file, '_', 1) || '_' ||
      split_part(log_file, '_', 2) as source from lines) select source, count(distinct log_file) as files, count(*) as rows,
      cast(sum((pattern_used = 'fallback')::int) as bigint) as errors from s group by 1"""),
    "table_counts": (table_counts, " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in B.TABLES)),
    "document_counts": (document_counts, """select source, lang as category, count(*) as n, grouping(source, lang) as level
      from documents group by grouping sets ((), (source), (lang))"""),
    "mention_counts": (mention_counts, f"""with {_ENT} select name, type, mention_count, strftime(last_mentioned, '%Y-%m-%d')
      as last, confidence from e"""),
    "entity_statistics": (entity_statistics, f"""with {_ENT} select type, count(*) as n, cast(sum(mention_count) as bigint)
      as mention_count from e group by 1"""),
    "top_entities": (top_entities, f"""with {_ENT} select name, type, mention_count from e order by mention_count desc,
      last_mentioned desc, name, type limit 10"""),
    "relation_usage": (relation_usage, """with r as (select l_linestatus as type, count(*) as m from lineitem group by l_suppkey,
      l_partkey, l_linestatus) select type, count(*) as n, cast(sum(m) as bigint) as mention_count from r group by 1"""),
    "service_impact": (service_impact, f"""with {DERIVED_SQL} select service_name, count(*) as total, cast(sum((log_level =
      'ERROR')::int) as bigint) as errors, cast(sum((log_level = 'WARN')::int) as bigint) as warnings from derived group by 1"""),
    "error_progression": (error_progression, f"""with {DERIVED_SQL} select service_name, line_number, substr(message, 1, 100)
      as message from derived where log_level = 'ERROR' order by ts_text, line_number limit 10"""),
    "critical_events": (critical_events, f"""with {DERIVED_SQL} select service_name, line_number, substr(message, 1, 150) as event
      from derived where {any_like('lower(message)', ['crash', 'fail', 'timeout', 'exception', 'down'])}"""),
    "system_totals": (system_totals, """select (select count(distinct user_id) from events) as users, count(distinct conv_id) as
      sessions, count(*) as messages, (select count(*) from documents) as documents, (select count(*) from orders where
      o_orderstatus = 'O') as active_tasks, (select count(*) from orders where o_orderstatus = 'F') as failed_tasks,
      (select round(avg(value), 6) from events) as mean_response from conversations"""),
    "session_page": (session_page, """with s as (select conv_id, count(*) as n from conversations group by 1)
      select *, (select count(*) from s) as total from s order by n desc, conv_id limit 20 offset 40"""),
    "message_order": (message_order, """select conv_id as session_id, turn, role, row_number() over (partition by conv_id order by turn)
      as position from conversations"""),
    "session_messages": (session_messages, """with s as (select conv_id, first(role order by turn) as r, count(*) as n from
      conversations group by 1) select conv_id, turn, role, n from conversations join s using (conv_id) where r = 'user'"""),
    "session_spans": (session_spans, """select user_id as session_id, count(*) as messages, round((epoch_us(max(ts)) -
      epoch_us(min(ts))) / 1e6, 3) as seconds from events group by 1"""),
    "ready_tasks": (ready_tasks, """select o_orderkey as task_id, substr(o_orderpriority, 1, 1)::int as priority from orders
      where o_orderstatus = 'O' and o_orderdate + to_days((o_custkey % 100)::int) <= timestamp '1999-01-01'
      order by priority desc, o_orderdate, o_orderkey limit 50"""),
    "fresh_tasks": (fresh_tasks, """select case when o_orderstatus = 'O' then 'pending' else 'done' end as status, count(*) as n
      from orders where o_orderdate <= timestamp '1998-06-02' and o_orderdate >= timestamp '1998-06-02' - interval 30 days group by 1"""),
    "quality_report": (quality_report, f"""with {B.DOCUMENTS}, j as (select *, {_NULLS} as k from v_kb left join labels using (doc_id)),
      u as (select 'unknown service' as issue, k from j where service_name = 'unknown' union all select 'blank content', k from j
      where trim(coalesce(content, '')) = '' union all select 'null cell', k from j where k > 0)
      select issue, count(*) as rows, cast(sum(k) as bigint) as null_cells from u group by 1"""),
    "quality_first_rows": (quality_first_rows, f"""with {B.DOCUMENTS}, u as (select 'unknown service' as issue, doc_id from v_kb
      where service_name = 'unknown' union all select 'blank content', doc_id from v_kb where trim(content) = ''
      union all select 'null cell', v_kb.doc_id from v_kb left join labels using (doc_id) where {_NULLS} > 0)
      select * from (select *, row_number() over (partition by issue order by doc_id) as rank from u) where rank <= 5"""),
    "null_cells": (null_cells, f"""with {B.DOCUMENTS}, j as (select * from v_kb left join labels using (doc_id)) """ + " union all ".join(
        f"""select '{x}' as "column", count(*) - count({x}) as nulls from j""" for x in _FIELDS)),
    "distinct_values": (distinct_values, f"""with {DERIVED_SQL} select distinct 'service' as kind, service_name as value from derived
      union select 'level', log_level from derived union select 'keyword', unnest(string_split(keywords, ',')) from derived
      where keywords <> ''"""),
    "retention_actions": (retention_actions, """with r as (select ['chat_messages', 'task_executions', 'log_entries',
      'knowledge_documents'][o_orderkey % 4 + 1] as data_type, date_diff('day', o_orderdate::date, date '2000-06-01') as age from orders)
      select data_type, case data_type when 'knowledge_documents' then 'keep' else case when age >= case data_type when 'log_entries'
      then 1095 else 2555 end then 'delete' when age >= case data_type when 'chat_messages' then 90 else 30 end then 'archive'
      else 'keep' end end as action, count(*) as n from r group by 1, 2"""),
    "lineage_upstream": (lineage_upstream, LINEAGE_SQL),
    "fault_spread": (fault_spread, SPREAD_SQL),
    "cause_frequency": (cause_frequency, f"""with {B.AFFECTS} select component as cause, count(*) as frequency from v_affects
      group by 1 order by 2 desc, 1 limit 10"""),
    "similar_problem_solutions": (similar_problem_solutions, """with s as (select l_partkey as problem, l_suppkey as solution,
      max(l_discount) as effect from lineitem group by 1, 2) select asked, solution, effect, rank from (select p_partkey as asked,
      solution, effect, row_number() over (partition by p_partkey order by effect desc, solution) as rank from part
      join s on problem = (p_partkey * 3 + 1) % 2000) where rank <= 3"""),
    "store_differences": (store_differences, """select doc_id, case when doc_id % 11 = 3 then 'missing' else 'changed' end as difference
      from documents where doc_id % 11 = 3 or (doc_id % 7 = 0 and lang <> 'xx') or (doc_id % 13 = 5 and text <> '') union all
      select doc_id + 1000000, 'extra' from documents where doc_id % 50 = 1"""),
    "erased_messages": (erased_messages, """select conv_id, turn, case when conv_id in (select r_regionkey from region) then 'exported'
      else 'kept' end as part from conversations"""),
    "bulk_update": (bulk_update, """select s_suppkey, round(case when s_suppkey % 3 = 0 then s_acctbal + 1 else s_acctbal end, 2)
      as s_acctbal from supplier where s_suppkey % 7 <> 6"""),
    "model_quality": (model_quality, """with a as (select avg((case when doc_id % 6 = 0 then 1 - quality else quality end = quality)::int
      ::double) as x from labels) select round(x, 6) as accuracy, x < 0.85 as degraded, x < 0.8 as retrain from a"""),
    "parity_difference": (parity, """with r as (select lang, avg(quality::double) as r from labels join documents using (doc_id) group by 1),
      x as (select max(r) - min(r) as d from r) select round(d, 6) as difference, d > 0.1 as biased,
      case when d < 0.05 then 'LOW' when d < 0.15 then 'MEDIUM' else 'HIGH' end as severity from x"""),
    "benchmark_summary": (benchmark_summary, """select event_type, count(*) as runs, round(avg((user_id % 20 <> 0)::int::double), 6) as
      success, round(avg(value), 6) as mean, round(quantile_cont(value, 0.95), 6) as p95, round(count(*) / sum(value), 6) as per_second
      from events group by 1"""),
    "retrain_decisions": (retrain_decisions, """with m as (select c_nationkey, c_custkey % 4 as t, c_acctbal / 30000.0::double as v
      from customer), h as (select *, v > [0.05, 0.3, 0.2, 180.0][t + 1] as hit from m)
      select c_nationkey, bool_or(hit) as retrain, cast(sum(hit::int) as bigint) as reasons,
      ['low', 'medium', 'high'][max(case when hit then [2, 1, 0, 1][t + 1] else 0 end) + 1] as priority from h group by 1"""),
    "search_quality_means": (search_quality_means, """select event_type, round(avg(value), 6) as latency, round(avg(user_id / 150.0::double), 6)
      as relevance, round(avg((value < 50)::int::double), 6) as coverage from events group by 1"""),
    "dependency_guesses": (dependency_guesses, f"""with {DERIVED_SQL}, t as (select service_name, concat('call to ', lower(message)) as m
      from derived) select distinct service_name, 'database' as depends_on from t where regexp_matches(m, 'call.*database')
      union select distinct service_name, 'redis' from t where regexp_matches(m, 'redis.*connection')"""),
    "task_progress": (task_progress, PROGRESS_SQL),
    "agent_progress": (agent_progress, AGENT_SQL),
}
