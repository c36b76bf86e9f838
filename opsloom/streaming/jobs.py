"""Structured Streaming forms of the table jobs.

Event time is ``timestamp`` (or ``ts``) with a watermark of ten minutes. Sinks
write one folder per batch id, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsloom import rules as R
from opsloom.functions import logs as L
from opsloom.functions.privacy import clean_text
from opsloom.functions.text import text_key

WATERMARK = "10 minutes"


def read_lines(spark: SparkSession, path: str, name_filter: str = "*.{log,txt}") -> DataFrame:
    """Lines of log files as they arrive."""
    return spark.readStream.option("pathGlobFilter", name_filter).text(path).select(
        F.col("value").alias("raw_line"), F.col("_metadata.file_name").alias("log_file"))


def log_stream(lines: DataFrame, as_of: Column, formats: str = "standard") -> DataFrame:
    """Parse and enrich: the same narrow job as in batch."""
    return L.log_entries(lines, as_of, formats).withWatermark("timestamp", WATERMARK)


def service_windows(entries: DataFrame, size: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Rows, errors, warnings and mean severity per service and event-time window."""
    win = F.window("timestamp", size, slide or size)
    return entries.groupBy(win.alias("w"), "service_name").agg(
        F.count("*").alias("total"), F.sum(F.when(F.col("log_level") == "ERROR", 1).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("log_level") == "WARN", 1).otherwise(0)).alias("warnings"),
        F.avg("severity_score").alias("mean_severity")).select(F.col("w.start").alias("start"), "service_name", "total",
                                                               "errors", "warnings", "mean_severity")


def first_texts(rows: DataFrame, text: str = "content", ts: str = "timestamp") -> DataFrame:
    """Drops a text seen before within the watermark, before the costly steps."""
    keyed = rows.withColumn("text_md5", text_key(F.col(text)))
    if rows.isStreaming:
        return keyed.withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark(["text_md5"])
    rest = [c for c in keyed.columns if c not in (ts, "text_md5")]
    first = keyed.groupBy("text_md5").agg(F.min(F.struct(ts, *rest)).alias("_r"))
    return first.select("_r.*", "text_md5").select(*keyed.columns)


def new_texts(rows: DataFrame, known: DataFrame, text: str = "content") -> DataFrame:
    """Texts without a row in the table ``known`` (column text_md5)."""
    return rows.withColumn("text_md5", text_key(F.col(text))).join(known.select("text_md5"), "text_md5", "left_anti")


# ------------------------------------------------------------------ sinks
def write_batches(df: DataFrame, base: str, mode: str = "append", routes: dict[str, Column] | None = None) -> StreamingQuery:
    """All that has arrived, one folder per batch; ``routes`` splits rows over tables by condition."""
    routes = routes or {"rows": F.lit(True)}
    _start_tables(df, base, list(routes))

    def save(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, test in routes.items():
                kept.filter(test).write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    return (df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/_checkpoint")
            .trigger(availableNow=True).start())


def _start_tables(df: DataFrame, base: str, names: list[str]) -> None:
    """An empty first part of each table, so that it can be read when nothing arrived."""
    empty = df.sparkSession.createDataFrame([], df.schema)
    for name in names:
        empty.write.mode("overwrite").parquet(f"{base}/{name}/batch_id=-1")


def _newest_before(spark: SparkSession, base: str, batch_id: int) -> datetime | None:
    """Newest time of all batches before; each batch keeps the running one, so that one small file is read."""
    if batch_id == 0:
        return None
    return spark.read.schema("newest timestamp").parquet(f"{base}/newest/batch_id={batch_id - 1}").first()[0]


def _keep_newest(rows: DataFrame, ts: str, base: str, batch_id: int, before: datetime | None) -> datetime | None:
    own = rows.agg(F.max(F.col(ts).cast("timestamp"))).first()[0]
    newest = max((t for t in (own, before) if t is not None), default=None)
    rows.sparkSession.createDataFrame([(newest,)], "newest timestamp").write.mode("overwrite").parquet(f"{base}/newest/batch_id={batch_id}")
    return newest


def write_window_parts(entries: DataFrame, base: str, size: str = "1 minute", late_after: str = "10 minutes") -> StreamingQuery:
    """Sums per service and window of each batch to ``rows``; those of late entries to ``late``.

    Late: more than ``late_after`` behind the newest entry of the same or an
    earlier batch. Nothing is dropped: ``window_totals`` adds both tables up,
    so the totals don't depend on how batches are cut.
    """
    win = F.window("timestamp", size)

    def parts(rows: DataFrame) -> DataFrame:
        return rows.groupBy(win.alias("w"), "service_name").agg(
            F.count("*").alias("total"), F.sum(F.when(F.col("log_level") == "ERROR", 1).otherwise(0)).alias("errors"),
            F.sum(F.when(F.col("log_level") == "WARN", 1).otherwise(0)).alias("warnings"), F.sum("severity_score").alias("severity"))

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()
        try:
            newest = _keep_newest(kept, "timestamp", base, batch_id, _newest_before(spark, base, batch_id))
            late = F.coalesce(F.col("timestamp") < F.lit(newest) - F.expr(f"interval {late_after}"), F.lit(False))
            parts(kept.filter(~late)).write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")
            parts(kept.filter(late)).write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")
        finally:
            kept.unpersist()

    _start_tables(parts(entries), base, ["rows", "late"])
    return (entries.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{base}/_checkpoint")
            .trigger(availableNow=True).start())


def window_totals(spark: SparkSession, base: str) -> DataFrame:
    """start, service_name, total, errors, warnings, mean_severity over timely and late parts."""
    every = read_batches(spark, base).unionByName(read_batches(spark, base, "late"))
    return every.groupBy(F.col("w.start").alias("start"), "service_name").agg(
        F.sum("total").alias("total"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"),
        (F.sum("severity") / F.sum("total")).alias("mean_severity"))


def write_with_late(df: DataFrame, base: str, ts: str = "timestamp", delay_seconds: int = 600) -> StreamingQuery:
    """Rows to ``rows``; those more than ``delay_seconds`` behind the newest time of earlier batches to ``late``.

    Each batch also writes its newest time, so a repeated batch decides the same way.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest_before(spark, base, batch_id)
        edge = F.lit(newest) - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = F.lit(False) if newest is None else F.coalesce(F.col(ts) < edge, F.lit(False))
        kept = batch.persist()
        try:
            kept.filter(~late).write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")
            kept.filter(late).write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")
            _keep_newest(kept, ts, base, batch_id, newest)
        finally:
            kept.unpersist()

    _start_tables(df, base, ["rows", "late"])
    return (df.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{base}/_checkpoint")
            .trigger(availableNow=True).start())


def read_batches(spark: SparkSession, base: str, name: str = "rows") -> DataFrame:
    """Rows of all batches with their batch id."""
    return spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}/batch_id=*")


def last_update(df: DataFrame, keys: list[str]) -> DataFrame:
    """Final row per key of an update stream."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*").drop("batch_id")


def ingest(lines: DataFrame, base: str, as_of: Column) -> StreamingQuery:
    """Clean, parse, enrich, route: parsed lines to ``entries``, the rest to ``rejected``."""
    cleaned = lines.withColumn("raw_line", clean_text(F.col("raw_line")))
    entries = L.log_entries(cleaned, as_of)
    return write_batches(entries, base, routes={"entries": F.col("layout") != "fallback", "rejected": F.col("layout") == "fallback"})


# ------------------------------------------------------------------ state per task and per rule
def task_progress(stage_events: DataFrame, expire_hours: int = 24) -> DataFrame:
    """Weighted progress per task after each batch (task_id, stage, status, progress, ts).

    State is the latest status of each stage; it leaves after ``expire_hours``
    of event time without news.
    """
    weights = dict(R.STAGE_WEIGHTS)
    total = sum(weights.values())
    millis = expire_hours * 3_600_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stages = {s: (t, st, p) for s, t, st, p in zip(*state.get)} if state.exists else {}
        newest = 0
        for pdf in batches:
            for stage, ts, status, progress in zip(pdf["stage"], pdf["ts"], pdf["status"], pdf["progress"]):
                at = ts.value // 1000
                newest = max(newest, at)
                if stage not in stages or stages[stage][0] <= at:
                    stages[stage] = (at, status, float(progress))
        names = list(stages)
        state.update((names, *[[stages[n][i] for n in names] for i in range(3)]))
        state.setTimeoutTimestamp(max(newest // 1000 + millis, state.getCurrentWatermarkMs() + 1))
        done = sum(weights.get(n, 0.0) * (1.0 if st == "completed" else p if st == "in_progress" else 0.0)
                   for n, (_, st, p) in stages.items())
        yield pd.DataFrame({"task_id": [key[0]], "progress": [done / total], "stages": [len(stages)]})

    kind = stage_events.schema["task_id"].dataType.simpleString()
    return (stage_events.withWatermark("ts", WATERMARK).groupBy("task_id").applyInPandasWithState(
        step, f"task_id {kind}, progress double, stages int",
        "names array<string>, times array<bigint>, statuses array<string>, parts array<double>",
        "update", GroupStateTimeout.EventTimeTimeout))


def held_alerts(states: DataFrame, hold_seconds: int) -> DataFrame:
    """Alerts of rules that fire without a break for ``hold_seconds``, once per unbroken stretch.

    Input: rule, ts, firing, one sample per rule and evaluation interval (the
    result of a windowed aggregation, not raw events), so a batch holds few
    rows of a rule. They are put in order before they meet the state.
    """
    hold = hold_seconds * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, told = state.get if state.exists else (None, False)
        out = []
        samples = pd.concat([b[["ts", "firing"]] for b in batches]).sort_values("ts")
        for ts, firing in zip(samples["ts"], samples["firing"]):
            at = ts.value // 1000
            if not firing:
                since, told = None, False
                continue
            since = at if since is None else since
            if not told and at - since >= hold:
                told = True
                out.append((key[0], pd.Timestamp(since, unit="us"), pd.Timestamp(at, unit="us")))
        state.update((since, told))
        if out:
            yield pd.DataFrame(out, columns=["rule", "since", "alerted_at"])

    return states.groupBy("rule").applyInPandasWithState(
        step, "rule string, since timestamp, alerted_at timestamp", "since bigint, told boolean", "append",
        GroupStateTimeout.NoTimeout)
