"""Named queries of whole incident searches, and of metrics at the windows that dashboards and alert rules state."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions import privacy as P
from opsloom.functions import vectors as V
from opsloom.operators import filters as FL
from opsloom.operators import graph as G
from opsloom.operators import metrics as M
from opsloom.operators import rca as C
from opsloom.operators import search as S
from opsloom.operators import series as T
from opsloom.plans import bindings as B
from opsloom.plans.graph import WORDS_SQL, _word_asks
from opsloom.plans.search import _bm25_sql, _HYBRID, _LISTS, _top_sql, BASE

c = F.col
AS_OF = "2024-06-01"


# ------------------------------------------------------------------ incident search
def _rows(spark, d):
    """Documents with vectors where there are any, and a time of the last 60 hours."""
    when = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=(c("doc_id") % 60).cast("int"))
    return B.documents(spark, d).join(B.doc_vectors(spark, d), "doc_id", "left").withColumn("timestamp", when)


def incident_logs(spark, d):
    """Vector and text fused on ERROR rows and on rows of any level, five each; both scored for the incident; ten best."""
    rows, asks, vec = _rows(spark, d), B.asks(spark, d), B.ask_vectors(spark, d)
    halves = [S.search_rows(rows, 5, "hybrid", where, asks, vec).select("query_id", "doc_id", "final_score").withColumn("half", F.lit(n))
              for n, where in enumerate((FL.search_filter(level="ERROR"), None))]
    hits = halves[0].unionByName(halves[1]).join(rows.drop("vector"), "doc_id").join(asks.select("query_id", "query"), "query_id")
    score = C.log_relevance(c("query"), c("log_level"), c("timestamp"), c("content"), c("service_name"), c("final_score"),
                            F.lit(AS_OF).cast("timestamp"))
    return S.best_per(hits.withColumn("relevance", score), ["query_id"], [F.desc("relevance"), F.asc("half"), F.asc("doc_id")], 10).select(
        "query_id", "doc_id", "half", F.round("relevance", 6).alias("relevance"), "rank")


def _half(name: str, docs: str) -> str:
    """CTEs that leave ``name``_top: five fused hits of ``docs``."""
    text = f"""{_bm25_sql('bk', docs)}, vk as (select vec.* from vec join {docs} using (doc_id)),
    {_LISTS.replace('from vec ', 'from vk ').replace('from bm ', 'from bk ')}, {_HYBRID}, {_top_sql('best', 'fused', 5, 'final_score')}"""
    for word in ("bk_tok", "bk_stat", "bk_cnt", "bk_idf", "bk_ask", "bk", "vk", "vt0", "vt", "bt", "fused", "best"):
        text = re.sub(rf"\b{word}\b", f"{name}_{word}", text)
    # five in each list, not ten
    return text.replace("rank <= 10", "rank <= 5")


_WORDS = " + ".join(f"(case when contains(lower(content), '{w}') or contains(lower(query), '{w}') then 0.1::double else 0 end)"
                    for w in R.RELEVANCE_WORDS)
INCIDENT_SQL = f"""{BASE}, errors as (select doc_id, content from v_kb where log_level = 'ERROR'), anyrow as (select doc_id, content from v_kb),
{_half('e', 'errors')}, {_half('a', 'anyrow')},
hits as (select query_id, doc_id, final_score, 0 as half from e_best union all select query_id, doc_id, final_score, 1 from a_best),
sc as (select query_id, doc_id, half, round(least(1.0::double, (case log_level when 'ERROR' then 0.4::double when 'WARN' then 0.2 else 0 end)
  + (case when age < 86400 then 0.2::double * (1 - age / 86400) else 0 end) + {_WORDS}
  + (case when service_name <> '' and contains(lower(query), lower(service_name)) then 0.3::double else 0 end)
  + final_score * 0.3::double), 9) as relevance
  from (select *, (doc_id % 60) * 3600.0::double as age from hits join v_kb using (doc_id)) join v_ask using (query_id))
select query_id, doc_id, half, round(relevance, 6) as relevance, rank from (select *, row_number() over (partition by query_id
  order by relevance desc, half, doc_id) as rank from sc) where rank <= 10"""


def knowledge_search(spark, d):
    """Vector hits, then hits of the widened question, first row per document, scored as knowledge, five best."""
    kb, asks = B.documents(spark, d).filter(FL.search_filter(source_type="wiki")), B.asks(spark, d)
    wide = asks.withColumn("query", F.concat("query", F.lit(R.KNOWLEDGE_QUERY_SUFFIX)))
    docs = B.doc_vectors(spark, d).join(kb.select("doc_id"), "doc_id")
    near = S.similar_rows(docs, B.ask_vectors(spark, d), 5)
    near = near.withColumns({"score": F.round(V.certainty(c("score")), 9), "source": F.lit(0)})
    both = near.unionByName(S.bm25_search(kb, wide, 5).withColumn("source", F.lit(1)))
    first = S.best_per(both, ["query_id", "doc_id"], [F.asc("source"), F.asc("rank")], 1, "n").select("query_id", "doc_id", "score")
    hits = first.join(kb, "doc_id").join(asks.select("query_id", "query"), "query_id")
    scored = hits.withColumn("relevance", C.knowledge_relevance(c("query"), c("category"), c("title"), c("content"), c("score")))
    return S.best_per(scored, ["query_id"], [F.desc("relevance"), F.asc("doc_id")], 5).select(
        "query_id", "doc_id", F.round("relevance", 6).alias("relevance"), "rank")


def _sum(words, text, each):
    return " + ".join(f"(case when contains({text}, '{w}') then {each}::double else 0 end)" for w in words)


KNOWLEDGE_SQL = rf"""{BASE}, wiki as (select doc_id, content from v_kb where source_type = 'wiki'),
wide as (select query_id, concat(query, '{R.KNOWLEDGE_QUERY_SUFFIX}') as query from v_ask),
{_bm25_sql('bw', 'wiki', 'wide')}, wv as (select vec.* from vec join wiki using (doc_id)), {_top_sql('t1', 'wv', 5)}, {_top_sql('t2', 'bw', 5)},
u as (select query_id, doc_id, 0 as source, round((score + 1) / 2, 9) as score, rank from t1 union all select query_id, doc_id, 1, score, rank from t2),
f as (select query_id, doc_id, score from (select *, row_number() over (partition by query_id, doc_id order by source, rank) as n from u) where n = 1),
sc as (select query_id, doc_id, round(least(1.0::double,
  (case when contains(lower(category), '故障') or contains(lower(category), 'troubleshooting') then 0.3::double else 0 end)
  + (case when contains(lower(category), '排查') or contains(lower(category), 'diagnostic') then 0.3::double else 0 end)
  + {_sum(R.KNOWLEDGE_TERMS, 'lower(title)', 0.2)} + {_sum(R.KNOWLEDGE_TERMS, 'lower(content)', 0.1)}
  + coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(trim(lower(query)), '\s+'), lambda w: length(w) > 2),
    lambda w: (case when contains(lower(title), w) then 0.15::double else 0 end) + (case when contains(lower(content), w) then 0.1::double
    else 0 end))), 0) + score * 0.4::double), 9) as relevance from f join v_kb using (doc_id) join v_ask using (query_id))
select query_id, doc_id, round(relevance, 6) as relevance, rank from (select *, row_number() over (partition by query_id
  order by relevance desc, doc_id) as rank from sc) where rank <= 5"""


def graph_search(spark, d):
    """Entities that a question names, then three documents of each."""
    ents = G.entities_by_word(B.nodes(spark, d), _word_asks(spark, d)).select("query_id", "name", "type")
    docs = G.documents_of_entities(ents.select("name", "type").distinct(), B.mentions(spark, d), B.documents(spark, d).select("doc_id", "title"), 3)
    return ents.join(docs.select("name", "type", "doc_id", "title"), ["name", "type"]).select(
        "query_id", "name", "type", "doc_id", "title", F.lit(R.GRAPH_HIT_SCORE).alias("score"))


GRAPH_SEARCH_SQL = f"""with asked as ({WORDS_SQL}), {B.NODES}, {B.MENTIONS}, {B.DOCUMENTS},
three as (select * from (select name, type, doc_id, title, row_number() over (partition by name, type order by doc_id) as n
  from (select distinct name, type from asked) join v_mention using (name, type) join v_kb using (doc_id)) where n <= 3)
select query_id, name, type, doc_id, title, cast(0.7 as double) as score from asked join three using (name, type)"""


def search_modes(spark, d):
    """The filtered log search in its three modes, with the rows that the filters leave."""
    where = FL.search_filter(source_type=["wiki", "jira"], level=["ERROR", "WARN"])
    rows, asks, vec = _rows(spark, d), B.asks(spark, d), B.ask_vectors(spark, d)
    left = rows.filter(where).agg(F.count("*").alias("total_rows"))
    out = None
    for mode in ("vector", "fulltext", "hybrid"):
        hits = S.search_rows(rows, 5, mode, where, asks, vec)
        one = hits.select(F.lit(mode).alias("mode"), "query_id", "doc_id", F.round("final_score" if mode == "hybrid" else "score", 6).alias("score"), "rank")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("filters", F.lit("source_type, log_level")).withColumn("total_rows", left.scalar())


MODES_SQL = f"""{BASE}, kept as (select doc_id, content from v_kb where source_type in ('wiki', 'jira') and log_level in ('ERROR', 'WARN')),
{_half('k', 'kept')},
u as (select 'vector' as mode, query_id, doc_id, score, rank from k_vt union all select 'fulltext', query_id, doc_id, score, rank from k_bt
  union all select 'hybrid', query_id, doc_id, final_score, rank from k_best)
select mode, query_id, doc_id, round(score, 6) as score, rank, 'source_type, log_level' as filters, (select count(*) from kept) as total_rows from u"""


# ------------------------------------------------------------------ metrics at their windows
def increase_by_labels(spark, d):
    """Errors of the hour before the newest sample, summed by endpoint and error type."""
    e = B.events(spark, d).select("event_id", "ts", "event_type", (c("user_id") % 10).alias("endpoint"))
    labels = ["event_type", "endpoint"]
    inc = M.rate(M.counter_series(e, labels, ["ts", "event_id"]), labels, ["ts", "event_id"], "counter", 3600)
    newest = e.agg(F.max("ts")).scalar()
    last = inc.filter(c("ts") > newest - F.expr("interval 1 hour")).groupBy(*labels).agg(F.max_by("increase", F.struct("ts", "event_id")).alias("increase"))
    return last.groupBy("endpoint", "event_type").agg(F.sum("increase").alias("increase"))


INCREASE_SQL = """with k as (select event_id, ts, event_type, user_id % 10 as endpoint, row_number() over (partition by event_type, user_id % 10
  order by ts, event_id) as counter from events), dl as (select *, case when counter = 1 then 0 else 1 end as delta from k),
i as (select *, sum(delta) over (partition by event_type, endpoint order by ts range between interval 1 hour preceding and current row)
  as increase from dl),
l as (select * from i where ts > (select max(ts) from events) - interval 1 hour qualify row_number() over (partition by event_type, endpoint
  order by ts desc, event_id desc) = 1)
select endpoint, event_type, cast(sum(increase) as bigint) as increase from l group by 1, 2"""

BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 200.0]


def rate_quantiles(spark, d):
    """95th and 50th percentile from the five-minute rates of the bucket counters, at every sample."""
    e = B.events(spark, d)
    marks = {f"le_{i}": F.when(c("value") <= b, 1).otherwise(0) for i, b in enumerate(BOUNDS)} | {"le_inf": F.when(c("value").isNotNull(), 1).otherwise(0)}
    first = T.previous(e.withColumns(marks), ["event_type"], T.time_bucket("ts", M.HOUR), ["ts", "event_id"], "event_id", "_p")
    grown = first.withColumns({n: F.when(c("_p").isNull(), 0).otherwise(c(n)) for n in marks})  # a counter's first sample is no increase
    rates = T.sums_over_last(grown, ["event_type"], "ts", 300, **{f"r_{n}": c(n) for n in marks})
    bounds = F.array(*[F.lit(b) for b in BOUNDS], F.lit(float("inf")))
    buckets = F.array(*[c(f"r_{n}") / 300.0 for n in marks])
    return rates.select("event_type", "event_id", F.round(M.quantile(bounds, buckets, 0.95), 6).alias("q95"),
                        F.round(M.quantile(bounds, buckets, 0.5), 6).alias("q50"))


def _rate_sql():
    counts = ", ".join(f"sum(case when first then 0 else (value <= {b})::int end) over w / 300.0::double" for b in BOUNDS)

    def q(p):
        return f"""(select case when total = 0 then null when {p} * total > n[6] then 200.0 else
          (select case when cnt = below then lo else lo + (hi - lo) * ({p} * total - below) / (cnt - below) end
          from (select unnest(bs) as hi, unnest(n[1:6]) as cnt, unnest(list_concat([0.0], bs[1:5])) as lo,
          unnest(list_concat([0.0], n[1:5])) as below) b where cnt >= {p} * total order by hi limit 1) end)"""
    return f"""with f as (select *, row_number() over (partition by event_type order by ts, event_id) = 1 as first from events),
      h as (select event_type, event_id, [{counts}] as n, sum(case when first then 0 else 1 end) over w / 300.0::double as total, {BOUNDS} as bs from f
      window w as (partition by event_type order by ts range between interval 300 seconds preceding and current row))
      select event_type, event_id, round({q(0.95)}, 6) as q95, round({q(0.5)}, 6) as q50 from h"""


_MONITORS = [("accuracy_drift", "24 hours", "6 hours"), ("response_time_degradation", "1 hour", "30 minutes"),
             ("error_rate_spike", "10 minutes", "5 minutes"), ("resource_consumption", "30 minutes", "15 minutes")]


def model_monitors(spark, d):
    """Four monitors at their own sliding windows against the value over all samples, with their thresholds."""
    e = B.events(spark, d)
    failed = c("event_type") == "error"
    base = e.agg(F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("error"), F.avg("value").alias("mean"))
    out = None
    for name, size, slide in _MONITORS:
        w = M.sliding_monitor(e, size, slide, failed=failed, quantile=0.95 if name == "response_time_degradation" else None)
        error, mean = base.select("error").scalar(), base.select("mean").scalar()
        value, alert = {
            "accuracy_drift": (error - c("error_ratio"), error - c("error_ratio") < -0.05),
            "response_time_degradation": (c("p95") if "p95" in w.columns else F.lit(None), c("p95") - mean > 2.0 if "p95" in w.columns else F.lit(None)),
            "error_rate_spike": (c("error_ratio") - error, c("error_ratio") - error > 0.02),
            "resource_consumption": (c("mean") / mean, c("mean") / mean > 1.5)}[name]
        one = w.select(F.lit(name).alias("monitor"), F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"),
                       F.round(value, 6).alias("value"), alert.alias("alert"))
        out = one if out is None else out.unionByName(one)
    return out


def _monitor_sql():
    parts = []
    values = {"accuracy_drift": ("be - er", "be - er < -0.05"), "response_time_degradation": ("p95", "p95 - bm > 2.0"),
              "error_rate_spike": ("er - be", "er - be > 0.02"), "resource_consumption": ("mn / bm", "mn / bm > 1.5")}
    for name, size, slide in _MONITORS:
        seconds = {"hours": 3600, "hour": 3600, "minutes": 60}
        n, step = (int(x.split()[0]) * seconds[x.split()[1]] for x in (size, slide))
        value, alert = values[name]
        parts.append(f"""select '{name}' as monitor, strftime(start, '%Y-%m-%d %H:%M') as start, round({value}, 6) as value, {alert} as alert from (
          select start, avg((event_type = 'error')::int::double) as er, avg(value) as mn, quantile_cont(value, 0.95) as p95
          from (select time_bucket(interval {step} seconds, ts) - k * interval {step} seconds as start, value, event_type
          from events, unnest(range({n // step})) t(k)) group by 1) cross join base""")
    return "with base as (select avg((event_type = 'error')::int::double) as be, avg(value) as bm from events) " + " union all ".join(parts)


#: rule, seconds of the rate window, threshold, seconds of hold, severity
_RULES = [("api error rate", 300, 0.05, 120, "warning"), ("task failure rate", 600, 0.1, 300, "critical"), ("high latency", 300, 30.0, 180, "warning")]


def held_rules(spark, d):
    """Three rules, each a value over its own window that must stay over its threshold for its own time."""
    e = B.events(spark, d).withColumns({"bad": F.when(c("event_type") == "error", 1).otherwise(0), "failed": F.when(c("event_type") == "view", 1).otherwise(0)})
    out = None
    for rule, window, limit, hold, severity in _RULES:
        samples = e.withColumn("rule", F.lit(rule))
        if rule == "high latency":
            seen = T.max_over_last(samples, ["rule"], "ts", window, "value", "_v")
        else:
            share = c("bad") if rule == "api error rate" else c("failed")
            seen = T.sums_over_last(samples, ["rule"], "ts", window, _s=share, _n=F.lit(1)).withColumn("_v", c("_s") / c("_n"))
        # one sample a time: rows of one time see the same window
        states = seen.groupBy("rule", "ts").agg(F.max("_v").alias("v")).withColumn("firing", c("v") > limit)
        one = M.held(states, ["rule"], hold).filter("alert").select(
            "rule", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.round("v", 6).alias("value"), F.lit(severity).alias("severity"))
        out = one if out is None else out.unionByName(one)
    return out


def _rules_sql():
    parts = []
    for i, (rule, window, limit, hold, severity) in enumerate(_RULES):
        value = ["avg((event_type = 'error')::int::double)", "avg((event_type = 'view')::int::double)", "max(value)"][i]
        parts.append(f"""select '{rule}' as rule, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, round(v, 6) as value, '{severity}' as severity from (
          select *, min(ts) over (partition by firing, quiet) as since from (select *, coalesce(max(case when not firing then ts end) over (order by ts),
          timestamp '1900-01-01') as quiet from (select distinct ts, v, v > {limit} as firing from (select ts, {value} over (order by ts
          range between interval {window} seconds preceding and current row) as v from events))))
          where firing and ts - since >= interval {hold} seconds""")
    return " union all ".join(parts)


# ------------------------------------------------------------------ lineage, fields, service rows
def lineage_downstream(spark, d):
    """Which tables are made from each table within three steps."""
    rec = B.table(spark, d, "nation").selectExpr("concat('t', n_nationkey) as src", "concat('t', (n_nationkey * 2 + 1) % 25) as dst", "'transform' as type")
    starts = B.table(spark, d, "nation").selectExpr("concat('t', n_nationkey) as start")
    return G.reachable(rec, starts, 3, "out").select("start", "name", "distance")


DOWNSTREAM_SQL = """with recursive r as (select concat('t', n_nationkey) as s, concat('t', (n_nationkey * 2 + 1) % 25) as t from nation),
p as (select s as start, t as node, 1 as distance, [s || t] as e from r union all
  select start, t, distance + 1, list_append(e, s || t) from p join r on s = node and not list_contains(e, s || t) where distance < 3)
select distinct start, node as name, distance from p where start <> node"""


def masked_fields(spark, d):
    docs = B.table(spark, d, "documents")
    return docs.select("doc_id", *[P.mask_field(c(x)).alias(x) for x in ("lang", "source")], P.mask_field(F.substr("text", F.lit(1), F.lit(20))).alias("head"))


def _mask(x):
    return f"case when length({x}) > 4 then concat(left({x}, 2), repeat('*', length({x}) - 4), right({x}, 2)) else '***' end"


def service_timeline(spark, d):
    """Lines of one service between two times, oldest first."""
    rows = B.log_lines(spark, d).select("line_number", c("ts").alias("timestamp"), F.concat(F.lit("service-"), F.char(97 + c("user_id") % 6)).alias("service_name"))
    return FL.timeline(rows, "service-b", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-09").cast("timestamp")).select(
        "line_number", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


QUERIES = {
    "incident_log_search": (incident_logs, INCIDENT_SQL),
    "knowledge_search": (knowledge_search, KNOWLEDGE_SQL),
    "graph_search": (graph_search, GRAPH_SEARCH_SQL),
    "search_modes": (search_modes, MODES_SQL),
    "increase_by_labels": (increase_by_labels, INCREASE_SQL),
    "rate_quantiles": (rate_quantiles, _rate_sql()),
    "model_monitors": (model_monitors, _monitor_sql()),
    "held_rules": (held_rules, _rules_sql()),
    "lineage_downstream": (lineage_downstream, DOWNSTREAM_SQL),
    "masked_fields": (masked_fields, f"select doc_id, {_mask('lang')} as lang, {_mask('source')} as source, {_mask('substr(text, 1, 20)')} as head from documents"),
    "service_timeline": (service_timeline, """select event_id as line_number, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as at from events
      where user_id % 6 = 1 and ts > timestamp '2024-01-05' and ts < timestamp '2024-01-09'"""),
}
