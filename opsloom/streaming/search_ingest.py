"""Log lines as they arrive, to both search tables, with an anomaly score against each service's own past."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsloom import rules as R
from opsloom.functions import logs as L
from opsloom.functions.privacy import clean_text
from opsloom.operators.series import running_sum, time_bucket

STATE = "service_name string, n long, total double, squares double, last_seen timestamp"


def hashed_vectors(rows: DataFrame, text: str = "content", out: str = "vector", dims: int = 384) -> DataFrame:
    """Hashed term counts of length one. Needs nothing but the row, unlike weights over a corpus, so it fits a stream."""
    steps = [RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=R.TOKEN_SPLIT, toLowercase=True),
             HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims), Normalizer(inputCol="_tf", outputCol="_unit")]
    for step in steps:
        rows = step.transform(rows)
    return rows.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


def anomaly_scores(rows: DataFrame, state: DataFrame, order: list[str], value: str = "severity_score", bucket_seconds: int = 3600) -> DataFrame:
    """Adds ``anomaly_score``: deviations of the value from the mean of all earlier rows of its service; 0 while they don't vary.

    ``state`` has a row per service with the number, sum and sum of squares of
    the rows of earlier batches. Inside the batch the sums run in the order of
    ``order`` by buckets of time, so that a busy service is many tasks.
    """
    x = F.col(value).cast("double")
    timed = rows.withColumn("_x", x)
    bucket, by = F.coalesce(time_bucket(order[0], bucket_seconds), F.lit(-1)), [F.col(o) for o in order]
    for name, term in (("_n", F.lit(1)), ("_s", F.col("_x")), ("_q", F.col("_x") * F.col("_x"))):
        timed = running_sum(timed, ["service_name"], bucket, by, term, name)
    past = state.select(F.col("service_name").alias("_service"), F.col("n").alias("_n0"), F.col("total").alias("_s0"), F.col("squares").alias("_q0"))
    both = timed.join(past, F.col("service_name") == F.col("_service"), "left")
    n = F.col("_n") - 1 + F.coalesce("_n0", F.lit(0))
    mean = (F.col("_s") - F.col("_x") + F.coalesce("_s0", F.lit(0.0))) / n
    spread = F.sqrt(F.greatest((F.col("_q") - F.col("_x") * F.col("_x") + F.coalesce("_q0", F.lit(0.0))) / n - mean * mean, F.lit(0.0)))
    score = F.when(n < 2, 0.0).when(spread < 1e-6, 0.0).otherwise((F.col("_x") - mean) / spread)
    return both.withColumn("anomaly_score", score).drop("_x", "_n", "_s", "_q", "_service", "_n0", "_s0", "_q0")


def next_state(state: DataFrame, rows: DataFrame, keep_hours: int, value: str = "severity_score", ts: str = "timestamp") -> DataFrame:
    """The state after a batch; services without a row for ``keep_hours`` of event time leave it."""
    x = F.col(value).cast("double")
    new = rows.groupBy("service_name").agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.max(ts).alias("last_seen"))
    whole = state.unionByName(new).groupBy("service_name").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.max("last_seen").alias("last_seen"))
    newest = whole.select(F.max("last_seen")).scalar()
    return whole.where(F.col("last_seen") >= newest - F.make_interval(hours=F.lit(keep_hours)))


def _state_before(spark: SparkSession, base: str, batch_id: int) -> DataFrame:
    """State that the batch before left; reads one batch's folder, however many there were."""
    if batch_id > 0:
        try:
            return spark.read.schema(STATE).parquet(f"{base}/state/batch_id={batch_id - 1}")
        except AnalysisException:
            pass
    return spark.createDataFrame([], STATE)


def ingest_search(lines: DataFrame, base: str, as_of: Column, keep_hours: int = 24 * 365, order: tuple[str, str] = ("timestamp", "line_number")) -> StreamingQuery:
    """Clean, parse, enrich, score and write: ``embedding_doc`` with vectors, ``fulltext_doc`` with keywords, ``rejected`` lines.

    Each batch writes its own folders and last its manifest; ``read_committed``
    shows batches with a manifest only, so that the tables change together. A
    repeated batch starts from the same state and replaces its folders. Lines
    come with a line_number (or another order within a time).
    """
    cleaned = lines.withColumn("raw_line", clean_text(F.col("raw_line")))
    entries = L.log_entries(cleaned, as_of)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _state_before(spark, base, batch_id)
        kept = batch.persist()
        try:
            good = kept.where(F.col("layout") != "fallback")
            scored = anomaly_scores(good, state, list(order))
            text = scored.drop("raw_line")
            hashed_vectors(text.drop("keywords", "entities")).write.mode("overwrite").parquet(f"{base}/embedding_doc/batch_id={batch_id}")
            text.write.mode("overwrite").parquet(f"{base}/fulltext_doc/batch_id={batch_id}")
            kept.where(F.col("layout") == "fallback").write.mode("overwrite").parquet(f"{base}/rejected/batch_id={batch_id}")
            next_state(state, good, keep_hours).write.mode("overwrite").parquet(f"{base}/state/batch_id={batch_id}")
        finally:
            kept.unpersist()
        counts = spark.createDataFrame([(batch_id,)], "id long")
        counts.write.mode("overwrite").parquet(f"{base}/manifest/batch_id={batch_id}")

    return (entries.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{base}/_checkpoint")
            .trigger(availableNow=True).start())


def read_committed(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Rows of a table with their batch id, of published batches only."""
    rows = spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}/batch_id=*")
    done = spark.read.option("basePath", f"{base}/manifest").parquet(f"{base}/manifest/batch_id=*").select("batch_id")
    return rows.join(F.broadcast(done), "batch_id", "left_semi")  # one row per batch
