from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from opsloom.functions import logs as L
from opsloom.functions.text import normalize_service, strip
from opsloom.operators.filters import made_once


def entries(spark, lines, formats="standard"):
    df = spark.createDataFrame([(i, line, "app.log") for i, line in enumerate(lines)],
                               "line_number int, raw_line string, log_file string")
    rows = L.log_entries(df, F.lit("2025-01-01").cast("timestamp"), formats).collect()
    return {r.line_number: r for r in rows}


def test_layouts_of_entries(spark):
    rows = entries(spark, [
        "2025-08-20T14:30:15.123Z [ERROR] service-b: CPU usage: 95%",
        "2025-08-20T14:30:15.123Z [info] service-b@10.1.0.5: Application started",
        "2025-08-20T14:30:15Z [WARN] [t-1] service-c: db.pool: slow query",
        "This is not a valid log format", "# x", "   ", "",
    ])
    assert set(rows) == {0, 1, 2, 3}
    assert (rows[0].log_level, rows[0].service_name, rows[0].message) == ("ERROR", "service-b", "CPU usage: 95%")
    assert rows[0].timestamp == datetime(2025, 8, 20, 14, 30, 15, 123000)
    assert (rows[1].host_ip, rows[1].log_level) == ("10.1.0.5", "INFO")
    assert (rows[2].thread_id, rows[2].component, rows[2].message) == ("t-1", "db.pool", "slow query")
    assert (rows[3].log_level, rows[3].service_name, rows[3].host_ip) == ("INFO", "unknown", "10.1.0.1")


def test_extended_layouts(spark):
    rows = entries(spark, [
        "2025-08-20T14:30:22.123Z [INFO ] service-b thread-pool-1: Processing request from 10.1.0.101",
        "2025-08-20T14:31:15.456Z service-c ERROR: Database connection failed",
        "2025-08-20 14:32:30,789 service-f WARNING payment_module: External API slow",
        "2024-08-22 08:30:15 [ERROR] web-server-01: CPU usage 85%, memory usage 78%",
        "This is not a valid log format",
    ], "extended")
    assert 4 not in rows
    assert (rows[0].thread_id, rows[0].host_ip) == ("thread-pool-1", "10.1.0.101")
    assert (rows[1].service_name, rows[1].log_level) == ("service-c", "ERROR")
    assert (rows[2].component, rows[2].timestamp) == ("payment_module", datetime(2025, 8, 20, 14, 32, 30, 789000))
    assert (rows[3].service_name, rows[3].log_level) == ("web-server-01", "ERROR")


def test_message_fields(spark):
    rows = entries(spark, [
        "2025-08-20T14:30:15.123Z [ERROR] service-b: Request req-123 failed, duration: 3500ms, code: DB_TIMEOUT",
        "2025-08-20T14:30:15.123Z [ERROR] service-b: request_id=r-9 error code: E42 CPU: 91.5% Memory: 2 GB",
    ])
    assert (rows[0].duration_ms, rows[0].request_id, rows[0].error_code) == (3500.0, None, None)
    assert (rows[1].request_id, rows[1].error_code) == ("r-9", "E42")
    assert rows[1].metadata == {"cpu_percent": 91.5, "memory_mb": 2048.0}
    assert rows[1].tags == ["performance", "performance", "memory"]


def test_severity_category_summary(spark):
    cases = [("ERROR", "Connection failed", 0.8, "connectivity_issue"), ("WARN", "Database query slow", 0.4, "warning"),
             ("INFO", "User logged in", 0.1, "normal_operation"), ("CRITICAL", "Service down", 0.9, "application_error"),
             ("ERROR", "OutOfMemoryError: Java heap space", 0.95, "performance_issue"),
             ("CRITICAL", "critical timeout", 1.0, "connectivity_issue"), ("INFO", "Service started", 0.1, "system_event")]
    rows = entries(spark, [f"2025-08-20T14:30:15.123Z [{lv}] service-b: {m}" for lv, m, *_ in cases])
    for i, (_, _, score, kind) in enumerate(cases):
        assert (rows[i].severity_score, rows[i].category) == (score, kind)
    assert rows[4].summary == "service-b has memory issues"


def test_keywords_entities_template(spark):
    rows = entries(spark, ["2025-08-20T14:30:15.123Z [ERROR] service-b: CPU usage: 95%, memory: 85%, timeout 3/5 on redis",
                           "2025-08-20T14:30:15.123Z [ERROR] service-b: took 1.5 s id 0123456789abcdefghijk n 7"])
    assert {"cpu", "memory", "timeout", "metric_95", "metric_85", "metric_3"} <= set(rows[0].keywords)
    assert {"service:redis", "tech:redis"} <= set(rows[0].entities)
    assert rows[1].content.endswith("Message: took [NUMBER] s id [LONG_ID] n [NUM]")


def test_first_layout_and_file_facts(spark):
    df = spark.createDataFrame([
        ("2025-08-20T14:30:15 [INFO] hello", 1, "incident_001_service_b_cpu_overload.log"),
        ("2025-08-20T14:30:15.1Z [INFO] svc: hello", 2, "x.log")], "raw_line string, line_number int, log_file string")
    rows = {r.line_number: r for r in L.parse_lines(df, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert (rows[1].pattern_used, rows[1].service_name, rows[1].hostname) == ("simple", "service-b", "d1-app-01")
    assert (rows[2].pattern_used, rows[2].level, rows[2].timestamp) == ("fallback", "UNKNOWN", datetime(2025, 1, 1))
    facts = df.limit(1).select(L.file_facts(F.lit("incident_001_service_b_cpu_overload.log")).alias("f")).first().f
    assert tuple(facts) == ("INC-001", "cpu_overload", "service-b")


def test_text_helpers(spark):
    row = spark.range(1).select(strip(F.lit("\t a b 　\n")).alias("s"), normalize_service(F.lit("Service  D1")).alias("n"),
                                normalize_service(F.lit("SERVICE_b")).alias("m")).first()
    assert tuple(row) == ("a b", "service-d1", "service-b")


def test_overlapping_patterns_each_match(spark):
    text = "call service-redis and service-database now, 95% of 20ms in 3/4 or 12gb"
    row = spark.createDataFrame([(text,)], "t string").select(L.entities(F.col("t")).alias("e"), L.keywords(F.col("t")).alias("k")).first()
    assert set(row.e) == {"service:service-r", "service:service-d", "service:redis", "service:database", "tech:redis"}
    assert {"metric_95", "metric_20", "metric_3", "metric_12"} <= set(row.k)


def test_filters_do_not_copy_costly_columns(spark, small):
    plan = entry.queries()["keyword_filtered"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap(keywords#" in plan and plan.count("arrays_overlap(") == 1
    rows = made_once(spark.createDataFrame([(1, None), (2, ["a"])], "x int, y array<string>"))
    assert {(r.x, tuple(r.y or ())) for r in rows.collect()} == {(1, ()), (2, ("a",))}
