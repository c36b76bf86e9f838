"""Writing search tables, snapshots and partitioned history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_defaults(rows: DataFrame) -> DataFrame:
    """Defaults for the fields a search row must have."""
    have = set(rows.columns)
    empty = F.array().cast("array<string>")
    fill = {"title": F.lit(""), "category": F.lit(""), "author": F.lit(""), "tags": empty, "keywords": empty, "entities": empty}
    return rows.withColumns({k: F.coalesce(F.col(k), v) if k in have else v for k, v in fill.items()})


def write_search_tables(rows: DataFrame, base: str, mode: str = "overwrite") -> None:
    """Two tables by source type: rows with a vector, and every row for full text.

    The rows are kept for the second write, so the work before them runs once.
    """
    full = with_defaults(rows).persist()
    try:
        vector_only = [c for c in ("vector", "chunk_index", "chunk_size", "parent_id") if c in full.columns]
        if "vector" in full.columns:
            (full.filter(F.col("vector").isNotNull()).drop("keywords", "entities")
             .write.mode(mode).partitionBy("source_type").parquet(f"{base}/embedding_doc"))
        full.drop(*vector_only).write.mode(mode).partitionBy("source_type").parquet(f"{base}/fulltext_doc")
    finally:
        full.unpersist()


def read_search_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{base}/embedding_doc"), spark.read.parquet(f"{base}/fulltext_doc")


def append_rows(rows: DataFrame, path: str, id_column: str) -> None:
    """Append with a generated id where none is given."""
    own = F.expr("uuid()")
    filled = rows.withColumn(id_column, F.coalesce(F.col(id_column), own) if id_column in rows.columns else own)
    filled.write.mode("append").parquet(path)


def write_snapshot(rows: DataFrame, base: str, version: int) -> str:
    """A new folder per version, so that a snapshot is never read and overwritten at once."""
    path = f"{base}/version={version:06d}"
    rows.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base}/version={version:06d}")


def write_by_month(rows: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Month partitions, written by the tasks that hold the rows: no shuffle, a busy month stays spread."""
    dated = rows.withColumns({"year": F.year(ts), "month": F.month(ts)})
    dated.write.mode(mode).partitionBy("year", "month").parquet(path)


def load_targets(rows: DataFrame, base: str) -> None:
    """One chain, three targets: search rows, mentions of entities, document registry."""
    kept = with_defaults(rows).persist()
    try:
        kept.write.mode("overwrite").partitionBy("source_type").parquet(f"{base}/fulltext_doc")
        (kept.select("source_id", F.explode("entities").alias("entity")).distinct()
         .write.mode("overwrite").parquet(f"{base}/mention"))
        (kept.select("source_id", "title", "category", "source_type", F.length("content").alias("size"))
         .write.mode("overwrite").parquet(f"{base}/registry"))
    finally:
        kept.unpersist()
