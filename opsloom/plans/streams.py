"""Named streaming queries: the given table read as a stream to its end, results as a table."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from opsloom.plans import bindings as B
from opsloom.plans.logs import DERIVED_SQL, as_of
from opsloom.plans.stats import PROGRESS_SQL
from opsloom.session import shared_dir
from opsloom.streaming import jobs as J
from opsloom.streaming import search_ingest as SI

c = F.col


def _stream(spark, d, name):
    """The table as a stream, one file or a folder of parts: a pattern, unlike a path, may name either."""
    schema = B.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def _run(df, mode="append", routes=None):
    base = f"{shared_dir(df.sparkSession)}/stream-{uuid4().hex}"
    J.write_batches(df, base, mode, routes).awaitTermination()
    return base


def _line_stream(spark, d):
    return B.line_columns(_stream(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")))


def service_windows(spark, d):
    """Daily windows per service over the line stream."""
    entries = J.log_stream(_line_stream(spark, d).select("raw_line", "line_number", "log_file"), as_of())
    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    J.write_window_parts(entries, base, "1 day").awaitTermination()
    out = J.window_totals(spark, base)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "service_name", "total", "errors", "warnings",
                      F.round("mean_severity", 6).alias("mean_severity"))


def routed_lines(spark, d):
    """Cleaned, parsed and routed lines, counted per table and service."""
    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    J.ingest(_line_stream(spark, d).select("raw_line", "line_number", "log_file"), base, as_of()).awaitTermination()
    parts = [J.read_batches(spark, base, n).select(F.lit(n).alias("table_name"), "service_name") for n in ("entries", "rejected")]
    return parts[0].unionByName(parts[1]).groupBy("table_name", "service_name").agg(F.count("*").alias("n"))


def first_texts(spark, d):
    """Texts of the document stream, repeats dropped by key."""
    docs = _stream(spark, d, "documents").select(c("text").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    base = _run(J.first_texts(docs).select("text_md5"))
    return J.read_batches(spark, base).select("text_md5")


def task_progress(spark, d):
    """Progress per task from the stream of stage events."""
    names = ["ner_extraction", "hybrid_search", "topology_query", "agent_reasoning", "result_formatting"]
    e = _stream(spark, d, "events").select(
        c("user_id").alias("task_id"), F.element_at(F.array(*[F.lit(n) for n in names]), (c("event_id") % 5 + 1).cast("int")).alias("stage"),
        F.when(c("event_type") == "error", "pending").when(c("event_type") == "view", "in_progress").otherwise("completed").alias("status"),
        (c("value") / 500.0).alias("progress"), c("ts").cast("timestamp").alias("ts"))
    base = _run(J.task_progress(e), "update")
    out = J.last_update(J.read_batches(spark, base), ["task_id"])
    return out.select("task_id", F.round("progress", 6).alias("progress"))


def search_tables(spark, d):
    """Both search tables after ingest: rows, rows far off their service's past, and the sum of the scores, per service."""
    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    SI.ingest_search(_line_stream(spark, d).select("raw_line", "line_number", "log_file"), base, as_of()).awaitTermination()
    full, vectors = (SI.read_committed(spark, base, n) for n in ("fulltext_doc", "embedding_doc"))
    parts = [full.withColumn("table_name", F.lit("fulltext_doc")), vectors.where(F.size("vector") == 384).withColumn("table_name", F.lit("embedding_doc"))]
    rows = [p.select("table_name", "service_name", "anomaly_score") for p in parts]
    return rows[0].unionByName(rows[1]).groupBy("table_name", "service_name").agg(
        F.count("*").alias("n"), F.sum(F.when(F.abs("anomaly_score") > 1.5, 1).otherwise(0)).alias("outliers"), F.round(F.sum("anomaly_score"), 3).alias("scores"))


SEARCH_TABLES_SQL = f"""with {DERIVED_SQL}, o as (select *, count(*) over w as n, sum(severity_score) over w as s, sum(severity_score * severity_score) over w as q
  from derived where layout <> 'fallback' window w as (partition by service_name order by ts_text, line_number rows between unbounded preceding and 1 preceding)),
z as (select *, s / n as m, sqrt(greatest(q / n - (s / n) * (s / n), 0.0)) as sd from o),
a as (select service_name, case when n < 2 or sd < 1e-6 then 0.0::double else (severity_score - m) / sd end as score from z)
select table_name, service_name, count(*) as n, cast(sum((abs(score) > 1.5)::int) as bigint) as outliers, round(sum(score), 3) as scores
from a cross join (values ('fulltext_doc'), ('embedding_doc')) t(table_name) group by 1, 2"""


QUERIES = {
    "stream_search_tables": (search_tables, SEARCH_TABLES_SQL),
    "stream_service_windows": (service_windows, f"""with {DERIVED_SQL} select substr(ts_text, 1, 10) as day, service_name,
      count(*) as total, cast(sum((log_level = 'ERROR')::int) as bigint) as errors, cast(sum((log_level = 'WARN')::int) as bigint)
      as warnings, round(avg(severity_score), 6) as mean_severity from derived group by 1, 2"""),
    "stream_routed_lines": (routed_lines, f"""with {DERIVED_SQL} select case when layout = 'fallback' then 'rejected' else 'entries' end
      as table_name, service_name, count(*) as n from derived group by 1, 2"""),
    "stream_first_texts": (first_texts, "select distinct md5(text) as text_md5 from documents"),
    "stream_task_progress": (task_progress, f"select task_id, progress from ({PROGRESS_SQL})"),
}
