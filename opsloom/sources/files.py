"""Scans of log, JSON and Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom import schemas
from opsloom.functions import documents as D
from opsloom.functions.logs import _utc as parse_utc
from opsloom.operators.search import BROADCAST_ROWS, has_at_most

CORRUPT = "_corrupt_record"


def read_log_lines(spark: SparkSession, path: str, name_filter: str = "*.{log,txt}") -> DataFrame:
    """log_file, line_number (from 1), raw_line of every line.

    Files are split as usual, a big file over many tasks. The number of a line
    is its place in its split plus the lines of the splits before it. Splits
    are counted in a scan of their own; the table of their counts, a row per
    split, goes to the lines, which are not shuffled while it is small.
    """
    lines = (spark.read.option("lineSep", "\n").option("pathGlobFilter", name_filter).text(path)
             .select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("_path"),
                     F.col("_metadata.file_name").alias("log_file"),
                     F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (lines.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
              .select("_path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    side = F.broadcast(splits) if has_at_most(splits, BROADCAST_ROWS) else splits
    return lines.join(side, ["_path", "_start"]).select(
        "log_file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_number"), "raw_line")


def read_incident_logs(spark: SparkSession, path: str) -> DataFrame:
    return read_log_lines(spark, path, "incident_*.log")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold a list or one object; a bad file gives one row with ``_corrupt_record``."""
    return (spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.json").json(path)
            .withColumn("file_name", F.col("_metadata.file_name")))


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def scan_statistics(df: DataFrame) -> DataFrame:
    """Files, rows and bad files of a JSON scan."""
    bad = F.col(CORRUPT).isNotNull()
    # Spark refuses a JSON scan that reads the corrupt-record column alone, so a data column is read along
    one = F.least(F.lit(1), F.length(F.coalesce(F.col(df.columns[0]), F.lit(""))) + 1)
    return df.groupBy("file_name").agg(F.sum(F.when(bad, 0).otherwise(one)).alias("rows"), F.max(bad.cast("int")).alias("bad")).agg(
        F.count("*").alias("files"), F.sum("rows").alias("documents"), F.sum("bad").alias("errors"))


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.WIKI).withColumn("last_updated", parse_utc(F.col("last_updated")))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.CHANGE).withColumn("created_at", parse_utc(F.col("created_at")))


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.TICKET).withColumns({
        "created": parse_utc(F.col("created")), "title": F.coalesce("title", "summary")})


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.INCIDENT)


def read_markdown(spark: SparkSession, path: str, category: str = "知识文档", tags: tuple[str, ...] = ("markdown",)) -> DataFrame:
    """One document per file, title from the file name. A document is one row, however it is read."""
    return (spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
            .select(F.regexp_extract("_metadata.file_name", r"^(.*)\.md$", 1).alias("title"), F.col("value").alias("content"))
            .withColumns({"id": F.col("title"), "category": F.lit(category), "tags": F.array(*[F.lit(t) for t in tags]),
                          "author": F.lit(None).cast("string"), "last_updated": F.lit(None).cast("timestamp")}))


def knowledge_rows(spark: SparkSession, wiki: str, changes: str, tickets: str, as_of: Column) -> DataFrame:
    """Search rows of all three knowledge sources."""
    parts = [D.wiki_documents(good_rows(read_wiki(spark, wiki)), as_of),
             D.change_documents(good_rows(read_changes(spark, changes)), as_of),
             D.ticket_documents(good_rows(read_tickets(spark, tickets)), as_of)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
