"""Usage statistics, paging, sessions, tasks, quality reports and data governance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions.text import any_of
from opsloom.operators.quantiles import exact_quantile
from opsloom.operators.search import best_per
from opsloom.operators.series import running_sum


def run_statistics(rows: DataFrame, source: str, file: str, failed: Column) -> DataFrame:
    """Files, rows and errors per source."""
    per_file = rows.groupBy(source, file).agg(F.count("*").alias("rows"), F.sum(F.when(failed, 1).otherwise(0)).alias("errors"))
    return per_file.groupBy(source).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"),
                                        F.sum("errors").alias("errors"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def document_counts(docs: DataFrame) -> DataFrame:
    """Total, by source and by category in one pass over the table."""
    per = docs.groupBy("source", "category").agg(F.count("*").alias("n"))
    return per.groupingSets([[], ["source"], ["category"]], "source", "category").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("level"))


def usage_by_type(df: DataFrame, amount: str) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"), F.sum(amount).alias(amount))


def top_entities(df: DataFrame, k: int = 10) -> DataFrame:
    """By mentions, then by last mention."""
    return df.orderBy(F.desc("mention_count"), F.desc("last_mentioned"), "name", "type").limit(k)


def add_mentions(seen: DataFrame, keys: list[str], snapshot: DataFrame | None = None) -> DataFrame:
    """Counts per key: how often, when last, last confidence; added to a snapshot of the same shape."""
    fresh = seen.groupBy(*keys).agg(F.count("*").alias("mention_count"), F.max("ts").alias("last_mentioned"),
                                    F.max_by("confidence", F.struct("ts", "confidence")).alias("confidence"))
    if snapshot is None:
        return fresh
    return fresh.unionByName(snapshot).groupBy(*keys).agg(
        F.sum("mention_count").alias("mention_count"),
        F.max_by("confidence", F.struct("last_mentioned", "confidence")).alias("confidence"),
        F.max("last_mentioned").alias("last_mentioned"))


def service_impact(logs: DataFrame) -> DataFrame:
    def n(level):
        return F.sum(F.when(F.col("log_level") == level, 1).otherwise(0))
    return logs.groupBy("service_name").agg(F.count("*").alias("total"), n("ERROR").alias("errors"), n("WARN").alias("warnings"))


def error_progression(logs: DataFrame, k: int = 10) -> DataFrame:
    return logs.filter("log_level = 'ERROR'").orderBy("timestamp", "line_number").limit(k).select(
        "timestamp", "service_name", "line_number", F.substring("message", 1, 100).alias("message"))


def critical_events(logs: DataFrame) -> DataFrame:
    return logs.filter(any_of(F.lower("message"), R.CRITICAL_EVENT_WORDS)).select(
        "timestamp", "service_name", "line_number", F.substring("message", 1, 150).alias("event"))




def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with the total count of all rows."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def message_order(messages: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Position of each message in its session; a session of any length is cut into stretches of turns."""
    return running_sum(messages, [session], F.floor(F.col(turn) / 4096), [F.col(turn)], F.lit(1), "position")


def session_span(messages: DataFrame, session: str = "session_id", ts: str = "created_at") -> DataFrame:
    seconds = F.max(F.col(ts).cast("double")) - F.min(F.col(ts).cast("double"))
    return messages.groupBy(session).agg(F.count("*").alias("messages"), seconds.alias("seconds"))


def ready_tasks(tasks: DataFrame, as_of: Column, k: int) -> DataFrame:
    """Pending and due, priority down, oldest first."""
    return tasks.filter((F.col("status") == "pending") & (F.col("scheduled_at") <= as_of)).orderBy(
        F.desc("priority"), "created_at", "task_id").limit(k)


def quality_report(rows: DataFrame, columns: list[str], row_id: str, first: int = 5) -> dict[str, DataFrame]:
    """Counts of unknown services, blank contents and null cells, and the first rows of each."""
    unknown = F.col("service_name") == "unknown"
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    flagged = rows.select(row_id, F.array_compact(F.array(
        F.when(unknown, F.lit("unknown service")), F.when(blank, F.lit("blank content")),
        F.when(nulls > 0, F.lit("null cell")))).alias("_f"), nulls.alias("null_cells"))
    issues = flagged.select(row_id, "null_cells", F.explode("_f").alias("issue"))
    return {"counts": issues.groupBy("issue").agg(F.count("*").alias("rows"), F.sum("null_cells").alias("null_cells")),
            "first": best_per(issues, ["issue"], [F.asc(row_id)], first).select("issue", row_id, "rank")}


def null_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    counted = rows.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])))


# ------------------------------------------------------------------ governance
def retention(rows: DataFrame, as_of: Column, data_type: str = "data_type", created: str = "created_at") -> DataFrame:
    """Adds ``action``: keep, archive or delete, by age and data type."""
    age = F.datediff(as_of, F.col(created))
    action = F.lit("keep")
    for kind, active, _, delete in R.RETENTION:
        if active is not None:
            step = F.when(age >= delete, "delete").when(age >= active, "archive").otherwise("keep")
            action = F.when(F.col(data_type) == kind, step).otherwise(action)
    return rows.withColumn("action", action)


def store_differences(master: DataFrame, copy: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of two stores that differ: missing in one, extra, or with another content."""
    digest = F.xxhash64(*columns)
    a = master.select(F.col(key), digest.alias("master_hash"))
    b = copy.select(F.col(key), digest.alias("copy_hash"))
    kind = (F.when(F.col("copy_hash").isNull(), "missing").when(F.col("master_hash").isNull(), "extra").otherwise("changed"))
    return a.join(b, key, "full_outer").filter(~F.col("master_hash").eqNullSafe(F.col("copy_hash"))).select(key, kind.alias("difference"))


def repaired(master: DataFrame, copy: DataFrame) -> DataFrame:
    """The copy after repair is the master's content in the copy's column order."""
    return master.select(*copy.columns)


def erase_user(rows: DataFrame, users: DataFrame, key: str) -> DataFrame:
    return rows.join(users.select(key).distinct(), key, "left_anti")


def export_user(rows: DataFrame, users: DataFrame, key: str) -> DataFrame:
    return rows.join(users.select(key).distinct(), key, "left_semi")


def model_quality(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Accuracy with degradation (under 0.85) and retraining (under 0.8) flags."""
    acc = rows.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))
    return acc.withColumns({"degraded": F.col("accuracy") < 0.85, "retrain": F.col("accuracy") < 0.8})


def parity_difference(rows: DataFrame, group: str, predicted: str) -> DataFrame:
    """Largest minus smallest positive rate over groups, with band."""
    rates = rows.groupBy(group).agg(F.avg(F.col(predicted).cast("double")).alias("rate"))
    diff = F.abs(F.col("difference"))
    return rates.agg((F.max("rate") - F.min("rate")).alias("difference")).withColumns({
        "biased": diff > 0.1, "severity": F.when(diff < 0.05, "LOW").when(diff < 0.15, "MEDIUM").otherwise("HIGH")})


def benchmark_summary(runs: DataFrame, keys: list[str], seconds: str, ok: Column) -> DataFrame:
    """Success share, mean, exact p95 and throughput per key."""
    counted = runs.groupBy(*keys, F.col(seconds).alias("v")).agg(
        F.count("*").alias("n"), F.sum(F.when(ok, 1).otherwise(0)).alias("good"))
    sums = counted.groupBy(*keys).agg(
        F.sum("n").alias("runs"), (F.sum("good") / F.sum("n")).alias("success"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum("n") / F.sum(F.col("v") * F.col("n"))).alias("per_second"))
    p95 = exact_quantile(counted, keys, 0.95).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("quantile").alias("p95"))
    same = [sums[k].eqNullSafe(p95[f"_{k}"]) for k in keys]
    return sums.join(p95, same, "left").select(*keys, "runs", "success", "mean", "p95", "per_second")


def retrain_decision(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Any trigger over its bound means retraining; the highest priority wins. Input: keys, trigger, value."""
    bound, level = F.lit(None).cast("double"), F.lit(0)
    ranks = {"low": 0, "medium": 1, "high": 2}
    for name, limit, priority in R.RETRAIN_TRIGGERS:
        hit = F.col("trigger") == name
        bound, level = F.when(hit, limit).otherwise(bound), F.when(hit, ranks[priority]).otherwise(level)
    marked = measures.withColumn("hit", F.col("value") > bound).withColumn("level", F.when(F.col("hit"), level).otherwise(0))
    out = marked.groupBy(*keys).agg(F.bool_or("hit").alias("retrain"), F.max("level").alias("l"),
                                    F.sum(F.col("hit").cast("int")).alias("reasons"))
    return out.withColumn("priority", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("l") + 1)).drop("l")


def dependency_guesses(logs: DataFrame, service: str = "service_name", text: str = "message") -> DataFrame:
    """service -> database or redis, from the wording of its lines."""
    found = F.array_compact(F.array(F.when(F.col(text).rlike("call.*database"), F.lit("database")),
                                    F.when(F.col(text).rlike("redis.*connection"), F.lit("redis"))))
    return logs.select(service, F.explode(found).alias("depends_on")).distinct()


# ------------------------------------------------------------------ task progress
def task_progress(stage_events: DataFrame, as_of: Column) -> DataFrame:
    """Latest state per (task, stage), weighted progress and expected remaining seconds per task.

    Input: task_id, stage, status, progress, ts, created_at.
    """
    last = stage_events.groupBy("task_id", "stage").agg(
        F.max_by(F.struct("status", "progress"), "ts").alias("s"), F.min("created_at").alias("created_at"))
    weight = F.coalesce(*[F.when(F.col("stage") == k, F.lit(w)) for k, w in R.STAGE_WEIGHTS.items()], F.lit(0.0))
    done = F.when(F.col("s.status") == "completed", 1.0).when(F.col("s.status") == "in_progress", F.col("s.progress")).otherwise(0.0)
    total = sum(R.STAGE_WEIGHTS.values())
    out = last.groupBy("task_id").agg((F.sum(weight * done) / total).alias("progress"), F.min("created_at").alias("created_at"))
    elapsed = as_of.cast("double") - F.col("created_at").cast("double")
    left = F.when(F.col("progress") > 0, F.greatest(F.lit(0.0), elapsed / F.col("progress") - elapsed))
    return out.withColumn("remaining_seconds", left)


def agent_progress(agents: DataFrame) -> DataFrame:
    """(finished agents + progress of working ones) / agents, and whether all key agents finished."""
    finished = F.col("status").isin("done", "failed")
    share = F.when(finished, 1.0).when(F.col("status") == "working", F.col("progress")).otherwise(0.0)
    key = F.col("agent_id").isin("planner", "knowledge", "reasoning", "executor")
    return agents.groupBy("task_id").agg(
        (F.sum(share) / F.count("*")).alias("progress"), F.coalesce(F.bool_and(F.when(key, finished)), F.lit(True)).alias("completed"))


def fresh_tasks(tasks: DataFrame, as_of: Column, hours: int = 24, created: str = "created_at") -> DataFrame:
    return tasks.filter(F.col(created) >= as_of - F.expr(f"interval {hours} hours"))
