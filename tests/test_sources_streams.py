import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom.functions import logs as L
from opsloom.sources import files, sinks
from opsloom.streaming import jobs as J

AS_OF = "2025-01-01"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(3000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree\n")
    (tmp_path / "c.csv").write_text("no\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = sorted((r.line_number, r.raw_line) for r in rows if r.log_file == "a.log")
    assert a == [(i + 1, line) for i, line in enumerate(lines)]
    assert sorted((r.line_number, r.raw_line) for r in rows if r.log_file == "b.txt") == [(1, "one"), (2, ""), (3, "three")]
    assert {r.log_file for r in rows} == {"a.log", "b.txt"}


def test_json_and_markdown(spark, tmp_path):
    wiki = tmp_path / "wiki"
    wiki.mkdir()
    (wiki / "a.json").write_text(json.dumps([{"id": "w1", "title": "T", "content": "mysql 优化。" * 100, "last_updated": "2024-08-12T09:15:00Z"},
                                             {"id": "w2", "title": "U", "content": "short", "tags": ["t"]}]))
    (wiki / "b.json").write_text(json.dumps({"id": "w3", "title": "V", "content": "x"}))
    (wiki / "bad.json").write_text("{ not json")
    (wiki / "guide.md").write_text("# hi\nkubernetes")
    scan = files.read_wiki(spark, str(wiki))
    stat = files.scan_statistics(scan).first()
    assert (stat.files, stat.documents, stat.errors) == (3, 3, 1)
    rows = files.D.wiki_documents(files.good_rows(scan), as_of()).collect()
    assert {r.source_id for r in rows if r.parent_id == "w2"} == {"wiki_w2_0"}
    many = [r for r in rows if r.parent_id == "w1"]
    assert len(many) > 1 and many[0].title.startswith("T (Part ") and many[0].timestamp == datetime(2024, 8, 12, 9, 15)
    md = files.read_markdown(spark, str(wiki)).first()
    assert (md.title, md.content) == ("guide", "# hi\nkubernetes")


def test_search_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "logs", [1.0]), ("b", "wiki", None)], "source_id string, source_type string, vector array<float>")
    sinks.write_search_tables(rows, str(tmp_path))
    emb, full = sinks.read_search_tables(spark, str(tmp_path))
    assert [r.source_id for r in emb.collect()] == ["a"] and full.count() == 2 and "keywords" in full.columns
    sinks.append_rows(spark.createDataFrame([("x",), (None,)], "message_id string"), str(tmp_path / "m"), "message_id")
    assert spark.read.parquet(str(tmp_path / "m")).filter("message_id is null").count() == 0
    sinks.write_snapshot(rows, str(tmp_path / "s"), 1)
    assert sinks.read_snapshot(spark, str(tmp_path / "s"), 1).count() == 2


def test_stream_and_batch_totals_agree(spark, tmp_path):
    lines = [f"2025-08-20T14:{i % 60:02d}:15.123Z [{'ERROR' if i % 3 else 'WARN'}] service-{'ab'[i % 2]}: timeout {i}" for i in range(300)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("\n".join(lines[:200] + ["garbage"]))
    (src / "b.log").write_text("\n".join(lines[200:]))
    J.ingest(J.read_lines(spark, str(src)), str(tmp_path / "out"), as_of()).awaitTermination()
    got = J.read_batches(spark, str(tmp_path / "out"), "entries")
    assert got.count() == 300 and J.read_batches(spark, str(tmp_path / "out"), "rejected").count() == 1
    batch = L.log_entries(files.read_log_lines(spark, str(src)), as_of()).filter("layout <> 'fallback'")
    key = lambda df: sorted(map(tuple, df.groupBy("service_name", "log_level").count().collect()))
    assert key(got) == key(batch)
    J.ingest(J.read_lines(spark, str(src)), str(tmp_path / "out"), as_of()).awaitTermination()
    assert J.read_batches(spark, str(tmp_path / "out"), "entries").count() == 300


def test_stream_hold(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    pattern = [True, True, False, True, True, True, True]
    pdf = pd.DataFrame({"rule": "r", "ts": [t0 + timedelta(minutes=i) for i in range(7)], "firing": pattern})
    src = str(tmp_path / "in")
    spark.createDataFrame(pdf).write.parquet(src)
    stream = spark.readStream.schema("rule string, ts timestamp, firing boolean").parquet(src)
    J.write_batches(J.held_alerts(stream, 120), str(tmp_path / "out")).awaitTermination()
    rows = J.read_batches(spark, str(tmp_path / "out")).collect()
    assert [(r.since, r.alerted_at) for r in rows] == [(t0 + timedelta(minutes=3), t0 + timedelta(minutes=5))]


def test_late_rows_go_aside(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "timestamp timestamp, n int"
    for mode, rows in (("append", [("12:00:00", 1), ("11:00:00", 2)]), ("append", [("11:55:00", 3), ("11:30:00", 4), ("12:30:00", 5)])):
        df = spark.createDataFrame([(datetime.fromisoformat(f"2024-01-01T{t}"), n) for t, n in rows], schema)
        df.coalesce(1).write.mode(mode).parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        J.write_with_late(stream, out).awaitTermination()
    assert sorted(r.n for r in J.read_batches(spark, out).collect()) == [1, 2, 3, 5]
    assert [r.n for r in J.read_batches(spark, out, "late").collect()] == [4]


def test_three_targets_and_months(spark, tmp_path):
    rows = spark.createDataFrame([("a", "wiki", "text", ["service:x"], datetime(2024, 3, 1)), ("b", "wiki", "t", ["service:x"], datetime(2024, 4, 1))],
                                 "source_id string, source_type string, content string, entities array<string>, timestamp timestamp")
    sinks.load_targets(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "mention")).count() == 2
    assert spark.read.parquet(str(tmp_path / "t" / "registry")).count() == 2
    sinks.write_by_month(rows, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).filter("year = 2024 and month = 4").count() == 1


@pytest.mark.parametrize("files, per_batch", [(1, 1), (3, 1), (10, 1), (10, 4)])
def test_window_totals_keep_late_rows(spark, tmp_path, files, per_batch):
    """Totals are those of one batch, however the rows are cut, also for rows far behind."""
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=(i * 37) % 600), f"s{i % 3}", "ERROR" if i % 4 == 0 else "WARN", 0.5 + i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "timestamp timestamp, service_name string, log_level string, severity_score double")
    for k in range(files):
        part = spark.createDataFrame(rows[k::files], df.schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
    J.write_window_parts(stream, str(tmp_path / "out"), "1 hour").awaitTermination()
    key = lambda r: (r.start, r.service_name)
    got = sorted(J.window_totals(spark, str(tmp_path / "out")).collect(), key=key)
    assert got == sorted(J.service_windows(df, "1 hour").collect(), key=key) and sum(r.total for r in got) == 400
    assert files == 1 or J.read_batches(spark, str(tmp_path / "out"), "late").count() > 0


@pytest.mark.parametrize("name", ["stream_first_texts", "stream_task_progress", "stream_service_windows", "stream_routed_lines"])
def test_streams_over_folders_of_parts(spark, tmp_path, small, name):
    import __spark_entry__ as entry
    for t in ("documents", "events"):
        spark.read.parquet(f"{small}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    one, parts = (entry.queries()[name](spark, d) for d in (small, str(tmp_path)))
    assert sorted(one.collect()) == sorted(parts.collect())


def test_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], "content string, timestamp timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content string, timestamp timestamp").parquet(str(tmp_path / "in"))
    J.write_batches(J.first_texts(stream), str(tmp_path / "out")).awaitTermination()
    assert J.read_batches(spark, str(tmp_path / "out")).count() == 0


def test_search_ingest_does_not_depend_on_the_batches(spark, tmp_path):
    """Totals and scores for 1, 3 and 10 batches and after a repeated batch; an unpublished batch is not seen."""
    import numpy as np

    from opsloom.streaming import search_ingest as SI
    rng = np.random.default_rng(2)
    lines = [f"2025-08-20T14:{i // 60:02d}:{i % 60:02d}.123Z [{rng.choice(['ERROR', 'WARN', 'INFO'])}] service-{'ab'[i % 2]}: {rng.choice(['timeout', 'ok', 'disk full'])} {i}" for i in range(120)]
    past, want = {}, []
    rows = [("junk", 999)] + [(x, i) for i, x in enumerate(lines)]
    seen = {}
    for parts in (1, 3, 10):
        src, out = str(tmp_path / f"in{parts}"), str(tmp_path / f"out{parts}")
        for k in range(parts):
            spark.createDataFrame(rows[k * len(rows) // parts:(k + 1) * len(rows) // parts], "raw_line string, line_number int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("raw_line string, line_number int").option("maxFilesPerTrigger", 1).parquet(src).withColumn("log_file", F.lit("a.log"))
        SI.ingest_search(stream, out, as_of()).awaitTermination()
        table = SI.read_committed(spark, out, "fulltext_doc")
        assert table.select("batch_id").distinct().count() == parts
        seen[parts] = sorted((r["line_number"], r["service_name"], round(r["severity_score"], 6), round(r["anomaly_score"], 6)) for r in table.collect())
        assert SI.read_committed(spark, out, "embedding_doc").where("size(vector) = 384").count() == 120
        assert SI.read_committed(spark, out, "rejected").count() == 1
    for n, service, x, _ in seen[1]:
        own = past.setdefault(service, [])
        sd = np.std(own) if len(own) > 1 else 0
        want.append((n, service, x, round((x - np.mean(own)) / sd, 6) if sd > 1e-6 else 0.0))
        own.append(x)
    assert [r[:3] for r in seen[1]] == [r[:3] for r in want] and np.allclose([r[3] for r in seen[1]], [r[3] for r in want], atol=1e-5)
    for parts in (3, 10):
        assert [r[:3] for r in seen[parts]] == [r[:3] for r in want] and np.allclose([r[3] for r in seen[parts]], [r[3] for r in want], atol=1e-5)
    state = SI.next_state(spark.createDataFrame([("old", 3, 1.0, 1.0, datetime(2020, 1, 1))], SI.STATE),
                          spark.createDataFrame([("new", 0.5, datetime(2024, 1, 1))], "service_name string, severity_score double, timestamp timestamp"), 24)
    assert [r["service_name"] for r in state.collect()] == ["new"]
    spark.read.parquet(f"{out}/fulltext_doc/batch_id=0").write.parquet(f"{out}/fulltext_doc/batch_id=77")  # written, not published
    assert SI.read_committed(spark, out, "fulltext_doc").count() == 120


def test_line_numbers_over_many_splits_without_a_shuffle(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(1, 20_001)))
    (tmp_path / "small.log").write_text("one\ntwo")
    (tmp_path / "empty.log").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        df = files.read_log_lines(spark, str(tmp_path))
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert all(r["raw_line"] == f"line {r['line_number']}" for r in rows if r["log_file"] == "big.log") and len(rows) == 20_002
    assert sorted((r["line_number"], r["raw_line"]) for r in rows if r["log_file"] == "small.log") == [(1, "one"), (2, "two")]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
