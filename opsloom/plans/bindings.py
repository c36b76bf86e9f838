"""Views over the given tables that stand in for the operations data.

Each view exists twice, as a DataFrame and as SQL, from the same expressions:
the SQL text is what another engine runs to check a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ log lines from events
_MESSAGES = [
    "concat('CPU: ', v, '%, memory: ', vi, ' MB, request timeout occurred after ', vi, 'ms')",
    "concat('Database connection failed, pool exhausted, error code: DB_', event_id % 7)",
    "concat('OutOfMemoryError: Java heap space, memory: ', vi, ' GB')",
    "concat('request_id: req-', event_id, ' completed in ', v, ' ms, response success')",
    "concat('Connection refused from 10.', event_id % 4, '.', user_id % 200, '.', event_id % 250,"
    " ' to mysql, 3/5 retries, critical')",
    "concat('Disk i/o wait high: ', vi, '% on host-', event_id % 9, ', unable to write batch queue')",
    "concat('Service started, init of redis and nginx done in ', vi, 'ms')",
    "concat('Slow query took ', v, ' ms, trace 3f2a9c1e-0b1d-4c5e-8f90-', lpad(cast(event_id as @str), 12, '0'),"
    " ' permission denied for service_', chr(cast(97 + user_id % 6 as int)))",
]


def _line_sql(ts_ms: str, string: str) -> str:
    """The one expression text both engines use for a raw line."""
    message = "case event_id % 8 " + " ".join(f"when {i} then {m}" for i, m in enumerate(_MESSAGES)) + " end"
    message = message.replace("@str", string)
    level = ("case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' "
             "when 'purchase' then 'CRITICAL' else 'INFO' end")
    service = "concat('service-', chr(cast(97 + user_id % 6 as int)))"
    infix = ("case event_id % 5 when 1 then concat('@10.1.0.', user_id % 200, ': ') "
             "when 2 then ': worker.pool: ' else ': ' end")
    thread = "case event_id % 5 when 2 then concat('[thread-', event_id % 4, '] ') else '' end"
    return (
        "case when event_id % 50 = 0 then concat('# rotated ', event_id) "
        "when event_id % 50 = 25 then concat('kernel panic dump ', event_id) "
        f"else concat({ts_ms}, 'Z [', {level}, '] ', {thread}, {service}, {infix}, {message}) end"
    )


def _values(string: str):
    return [("v", f"cast(cast(value as decimal(12,2)) as {string})"), ("vi", "cast(floor(value) as bigint)")]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_line, line_number, log_file, ts, user_id."""
    return line_columns(spread(table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp")))


def line_columns(events: DataFrame) -> DataFrame:
    base = events.selectExpr("event_id", "ts", "user_id", "event_type", "value",
                             *[f"{e} as {n}" for n, e in _values("string")])
    return base.selectExpr(
        _line_sql("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")", "string") + " as raw_line",
        "event_id as line_number",
        "concat('incident_', lpad(cast(user_id as string), 3, '0'), '_service_',"
        " chr(cast(97 + user_id % 3 as int)), '_', element_at(array('cpu_overload', 'disk_full', 'network_split',"
        " 'memory_leak', 'other'), cast(user_id % 5 + 1 as int)), '.log') as log_file",
        "ts", "user_id", "event_type", "value",
    )


LOG_LINES = f"""v_base as (
  select event_id, ts, user_id, event_type, value, {", ".join(f"{e} as {n}" for n, e in _values("varchar"))}
  from events),
v_log_line as (
  select {_line_sql("strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')", 'varchar')} as raw_line, event_id as line_number,
  concat('incident_', lpad(cast(user_id as varchar), 3, '0'), '_service_', chr(cast(97 + user_id % 3 as int)), '_',
    ['cpu_overload', 'disk_full', 'network_split', 'memory_leak', 'other'][cast(user_id % 5 + 1 as int)], '.log')
    as log_file, ts, user_id, event_type, value
  from v_base)"""

AS_OF = "2024-02-01T00:00:00Z"


# ------------------------------------------------------------------ documents, merge requests, tickets, questions
def _dialect(text: str, spark: bool) -> str:
    """One expression text for both engines; only the list constructor and string type differ."""
    return (text.replace("LIST(", "array(" if spark else "list_value(")
            .replace("TEXT)", "string)" if spark else "varchar)"))


_DOC = {
    "doc_id": "doc_id",
    "source_type": "case doc_id % 4 when 0 then 'wiki' when 1 then 'gitlab' when 2 then 'jira' else 'wiki' end",
    "title": "substr(text, 1, 40)",
    "content": "concat(text, case doc_id % 7 when 0 then ' kubernetes and docker monitoring on web-server'"
               " when 1 then ' mysql slow, solution: fix the service-b memory leak and restart' when 2 then"
               " ' redis timeout best practice: recommendation is a larger connection pool' when 3 then"
               " ' service-c depends on database, order-service connects to redis' when 4 then"
               " ' 故障排查 CPU 监控 最佳实践 优化 连接' when 5 then ' api-gateway error on host-3, cpu usage high, 10.0.0.7'"
               " else ' 案例: 处理 memory 方案' end)",
    "category": "lang",
    "author": "source",
    "tags": "LIST(source, concat('lang_', lang))",
    "service_name": "case doc_id % 5 when 0 then 'service-b' when 1 then 'service-a' when 2 then 'unknown'"
                    " when 3 then 'documentation' else 'service-c' end",
    "log_level": "case doc_id % 3 when 0 then 'ERROR' when 1 then 'WARN' else 'INFO' end",
    "log_file": "concat('incident_00', doc_id % 4, '_app.log')",
    "line_number": "doc_id % 100",
}

_CHANGE = {
    "id": "cast(o_orderkey as TEXT)",
    "title": "case o_orderkey % 4 when 0 then concat('Fix bug in service-', chr(cast(97 + o_custkey % 6 as int)))"
             " when 1 then 'Add Feature flag' when 2 then concat('Tune order ', o_orderkey) else '' end",
    "description": "case when o_orderkey % 7 = 0 then '' else concat('order ', o_orderkey, ' is ', o_orderpriority) end",
    "files_changed": "case when o_orderkey % 3 = 0 then LIST(concat('src/service-', chr(cast(97 + o_custkey % 6 as int)),"
                     " '/mod_', o_custkey % 10, '.py'), concat('deploy/docker/app', o_orderkey % 3, '.yaml'))"
                     " when o_orderkey % 3 = 1 then LIST(concat('Config/.env'), concat('web/order-service/a', o_custkey % 5,"
                     " '.JS')) else LIST(concat('lib/x', o_orderkey % 11, '.go')) end",
    "labels": "case o_orderstatus when 'F' then LIST('Backend', 'bug') when 'O' then LIST('frontend', o_orderpriority)"
              " else LIST('api', 'database', 'api') end",
}

_TICKET = {
    "id": "concat('OPS-', o_orderkey)",
    "title": "case when o_orderkey % 5 = 0 then '' else concat('CPU high on service-', chr(cast(97 + o_custkey % 6 as int))) end",
    "description": "case o_orderkey % 4 when 0 then 'disk full, mysql down 故障' when 1 then 'Docker memory 超时 on nginx'"
                   " when 2 then '' else concat('network ', o_custkey) end",
    "type": "case o_orderstatus when 'F' then 'bug' when 'O' then 'incident' else 'task' end",
    "priority": "o_orderpriority",
    "status": "o_orderstatus",
    "components": "case when o_custkey % 3 = 0 then LIST(concat('service-', chr(cast(97 + o_custkey % 6 as int))),"
                  " 'Web-Server') when o_custkey % 3 = 1 then LIST('queue', concat('pool', o_custkey % 4))"
                  " else LIST('cache-service') end",
    "created": "o_orderdate",
}

_QUESTION = {
    "query_id": "conv_id * 1000 + turn",
    "query": "concat(case (conv_id + turn) % 8 when 0 then 'service-b CPU critical error on d1-app-01, timeout '"
             " when 1 then 'database connection slow, please analyze Service C ' when 2 then '最近 内存 异常 排查 service-a '"
             " when 3 then '优化 cluster 性能 disk usage ' when 4 then 'hello there ' when 5 then"
             " 'debug service-d1 memory issue, is disk io down ' when 6 then '部署 kubernetes config 紧急 '"
             " else 'warn: 监控 service-e unavailable, restart ' end, text)",
    "role": "role",
    "conv_id": "conv_id",
    "turn": "turn",
}


def _spark_view(spark, sf_dir, name, columns):
    return spread(table(spark, sf_dir, name)).selectExpr(*[f"{_dialect(e, True)} as {c}" for c, e in columns.items()])


def _sql_view(view, name, columns):
    return f"{view} as (select " + ", ".join(f"{_dialect(e, False)} as {c}" for c, e in columns.items()) + f" from {name})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, "documents", _DOC)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, "orders", _CHANGE)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, "orders", _TICKET)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, "conversations", _QUESTION)


DOCUMENTS = _sql_view("v_kb", "documents", _DOC)
CHANGES = _sql_view("v_change", "orders", _CHANGE)
TICKETS = _sql_view("v_ticket", "orders", _TICKET)
QUESTIONS = _sql_view("v_question", "conversations", _QUESTION)


# ------------------------------------------------------------------ questions with vectors, documents with vectors
_ASK = {
    "query_id": "item_id",
    "query": "concat(text, case item_id % 6 when 0 then ' mysql slow connection' when 1 then ' kubernetes docker'"
             " when 2 then ' redis timeout service-b' when 3 then ' service-c database' when 4 then ' api-gateway error'"
             " else ' cpu usage memory leak' end)",
    "asked_service": "case item_id % 3 when 0 then 'service-b' when 1 then 'service-a' else 'service-c' end",
}


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, asked_service."""
    return _spark_view(spark, sf_dir, "benchmark", _ASK)


def ask_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and vector of the questions that have an embedding of that id."""
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(vec, "query_id")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


ASKS = _sql_view("v_ask", "benchmark", _ASK) + """,
v_ask_vec as (select item_id as query_id, embedding::double[] as vector from benchmark join embeddings on vec_id = item_id),
v_doc_vec as (select vec_id as doc_id, embedding::double[] as vector from embeddings)"""


# ------------------------------------------------------------------ graph
_EDGE_PARTS = [
    ("supplier", "concat('service-', s_suppkey)", "concat('host-', s_nationkey)", "'DEPLOYED_ON'", ""),
    ("supplier", "concat('service-', s_suppkey)", "concat('service-', (s_suppkey * 7 + 1) % 97)", "'CALLS'", ""),
    ("supplier", "concat('service-', s_suppkey)", "concat('service-', (s_suppkey * 3 + 2) % 89)", "'ROUTES_TO'",
     "s_suppkey % 2 = 0"),
    ("lineitem", "concat('issue-', l_orderkey)", "concat('service-', l_suppkey)", "'AFFECTS'", ""),
    ("lineitem", "concat('service-', l_suppkey)", "concat('part-', l_partkey)", "'USES'", "l_returnflag = 'R'"),
]


def edges(spark: SparkSession, sf_dir: str, service_only: bool = False) -> DataFrame:
    out = None
    for name, src, dst, kind, where in _EDGE_PARTS:
        if service_only and kind not in ("'CALLS'", "'ROUTES_TO'"):
            continue
        df = table(spark, sf_dir, name)
        df = (df.filter(where) if where else df).selectExpr(f"{src} as src", f"{dst} as dst", f"{kind} as type")
        out = df if out is None else out.unionByName(df)
    return out.distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name, expr, kind):
        return table(spark, sf_dir, name).selectExpr(f"{expr} as name", f"'{kind}' as type")

    return (of("supplier", "concat('service-', s_suppkey)", "Service")
            .unionByName(of("nation", "concat('host-', n_nationkey)", "Host"))
            .unionByName(of("orders", "concat('issue-', o_orderkey)", "Issue"))
            .unionByName(of("part", "concat('part-', p_partkey)", "Component")))


EDGES = ("v_edge as (select distinct src, dst, type from (" + " union all ".join(
    f"select {src} as src, {dst} as dst, {kind} as type from {name}" + (f" where {where}" if where else "")
    for name, src, dst, kind, where in _EDGE_PARTS) + "))")
NODES = """v_node as (select concat('service-', s_suppkey) as name, 'Service' as type from supplier
  union all select concat('host-', n_nationkey), 'Host' from nation
  union all select concat('issue-', o_orderkey), 'Issue' from orders
  union all select concat('part-', p_partkey), 'Component' from part)"""


def affects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue, component, issue_type: one row per order line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    types = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority"))
    return lines.join(types, "l_orderkey").select(
        F.concat(F.lit("issue-"), "l_orderkey").alias("issue"), F.concat(F.lit("part-"), "l_partkey").alias("component"),
        F.col("o_orderpriority").alias("issue_type"))


AFFECTS = """v_affects as (select concat('issue-', l_orderkey) as issue, concat('part-', l_partkey) as component,
  o_orderpriority as issue_type from lineitem join orders on l_orderkey = o_orderkey)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, type, doc_id: services that the document rows name."""
    docs = table(spark, sf_dir, "documents")
    one = docs.selectExpr("concat('service-', doc_id % 100) as name", "'Service' as type", "doc_id")
    two = docs.selectExpr("concat('part-', doc_id % 37) as name", "'Component' as type", "doc_id")
    return one.unionByName(two)


MENTIONS = """v_mention as (select concat('service-', doc_id % 100) as name, 'Service' as type, doc_id from documents
  union all select concat('part-', doc_id % 37), 'Component', doc_id from documents)"""


# ------------------------------------------------------------------ metric samples
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, ts, event_id, counter: running count per type that starts again on day 16."""
    from opsloom.operators.metrics import counter_series

    era = events(spark, sf_dir).withColumn("era", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    return counter_series(era, ["event_type", "era"], ["ts", "event_id"]).select("event_type", "ts", "event_id", "counter")


COUNTERS = """v_counter as (select event_type, ts, event_id, count(*) over (partition by event_type,
  ts >= timestamp '2024-01-16' order by ts, event_id rows unbounded preceding) as counter from events)"""
DELTAS = COUNTERS + """, v_prev as (select *, lag(counter) over (partition by event_type order by ts, event_id) as prev
  from v_counter), v_delta as (select *, case when prev is null then 0 when counter < prev then counter else counter - prev end
  as delta, case when counter < prev then 1 else 0 end as reset from v_prev)"""
