"""Named queries of sources and sinks: the given tables written as files, read back, and counted."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsloom.plans import bindings as B
from opsloom.session import shared_dir
from opsloom.sources import files, sinks

c = F.col


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def log_file_lines(spark, d):
    """Lines written as one text file per incident, read back with their numbers."""
    base = _folder(spark, "lines")
    lines = B.log_lines(spark, d).select("raw_line", c("log_file").alias("incident"))
    lines.repartition("incident").write.partitionBy("incident").text(base)
    read = files.read_log_lines(spark, base, "*.txt")
    return read.agg(F.count("*").alias("lines"), F.sum("line_number").alias("numbers"), F.max("line_number").alias("longest"),
                    F.sum(F.when(c("line_number") == 1, 1).otherwise(0)).alias("files"), F.sum(F.length("raw_line")).alias("letters"))


def _search_rows(spark, d):
    vectors = B.doc_vectors(spark, d)
    rows = B.documents(spark, d).select(c("doc_id").cast("string").alias("source_id"), "doc_id", "source_type", "title", "content", "category", "author", "tags",
                                        F.when(c("doc_id") % 2 == 0, F.array("category", "author")).alias("entities"))
    return rows.join(vectors, "doc_id", "left").drop("doc_id")


def search_tables_written(spark, d):
    """Both search tables, dropped and loaded anew over an older load, by source type."""
    base, rows = _folder(spark, "search"), _search_rows(spark, d)
    sinks.write_search_tables(rows.limit(5), base)
    sinks.write_search_tables(rows, base)
    embedding, fulltext = sinks.read_search_tables(spark, base)
    count = lambda df, name: df.groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("letters")).withColumn("table_name", F.lit(name))
    return count(embedding, "embedding_doc").unionByName(count(fulltext, "fulltext_doc"))


def appended_messages(spark, d):
    """Messages appended in two loads; those without an id get one of their own."""
    base = _folder(spark, "messages")
    rows = B.table(spark, d, "conversations").select(
        F.when(c("turn") % 2 == 0, F.concat("conv_id", F.lit("-"), "turn")).alias("message_id"), "conv_id", "role")
    sinks.append_rows(rows.filter(c("conv_id") % 3 == 0), base, "message_id")
    sinks.append_rows(rows.filter(c("conv_id") % 3 != 0), base, "message_id")
    read = spark.read.parquet(base)
    return read.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("message_id").alias("ids"),
                                    F.sum(F.when(c("message_id").rlike(r"^\d+-\d+$"), 1).otherwise(0)).alias("given"))


def month_partitions(spark, d):
    """Events appended to month partitions in two loads."""
    base = _folder(spark, "months")
    e = B.events(spark, d)
    sinks.write_by_month(e.filter(c("event_id") % 2 == 0), base, "ts")
    sinks.write_by_month(e.filter(c("event_id") % 2 != 0), base, "ts")
    return spark.read.parquet(base).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum(F.round(c("value") * 100).cast("long")).alias("cents"))


def load_targets(spark, d):
    """One chain to three targets: search rows, mentions, registry."""
    base = _folder(spark, "targets")
    sinks.load_targets(_search_rows(spark, d), base)
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    parts = [read("fulltext_doc").agg(F.count("*").alias("n"), F.countDistinct("source_type").alias("kinds")).withColumn("target", F.lit("fulltext_doc")),
             read("mention").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("kinds")).withColumn("target", F.lit("mention")),
             read("registry").agg(F.count("*").alias("n"), F.sum("size").alias("kinds")).withColumn("target", F.lit("registry"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    "log_file_lines": (log_file_lines, f"""with {B.LOG_LINES}, f as (select log_file, count(*) as n, sum(length(raw_line)) as letters from v_log_line group by 1)
      select count(*) as files, cast(sum(n) as bigint) as lines, cast(sum(n * (n + 1) // 2) as bigint) as numbers, max(n) as longest,
      cast(sum(letters) as bigint) as letters from f"""),
    "search_tables_written": (search_tables_written, f"""with {B.DOCUMENTS}
      select source_type, count(*) as n, cast(sum(length(content)) as bigint) as letters, 'embedding_doc' as table_name
      from v_kb join embeddings on vec_id = doc_id group by 1
      union all select source_type, count(*), cast(sum(length(content)) as bigint), 'fulltext_doc' from v_kb group by 1"""),
    "appended_messages": (appended_messages, """select role, count(*) as n, count(*) as ids, cast(sum((turn % 2 = 0)::int) as bigint) as given
      from conversations group by 1"""),
    "month_partitions": (month_partitions, """select cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, count(*) as n,
      cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by 1, 2"""),
    "load_targets": (load_targets, f"""with {B.DOCUMENTS}, m as (select distinct doc_id, unnest([category, author]) as entity from v_kb where doc_id % 2 = 0)
      select 'fulltext_doc' as target, count(*) as n, cast(count(distinct source_type) as bigint) as kinds from v_kb
      union all select 'mention', count(*), count(distinct entity) from m
      union all select 'registry', count(*), cast(sum(length(content)) as bigint) from v_kb"""),
}
