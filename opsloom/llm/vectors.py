"""Vectors as blocks: usable rows, matrices from Arrow, pairs of query and vector blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors and queries of one block at most on average.
VECTORS, QUERIES = 8192, 4096


def usable(embeddings: DataFrame, zero: bool, more: list[str] | None = None) -> DataFrame:
    """vec_id, v and columns ``more``: rows with an id and a vector of finite components; ``zero`` says whether zero vectors count."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), *more or [])
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def asked(rows: DataFrame, every: int) -> DataFrame:
    """The queries, ids divisible by ``every``; of rows that share an id the one with the least vector."""
    return rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _by_part(values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("part") + 1)


def _numbers(blocks: list[int]) -> Column:
    return F.sequence(F.lit(0).cast("long"), _by_part(blocks).cast("long") - 1)


def block_pairs(rows: DataFrame, queries: DataFrame, parts: int, search: Callable, schema: str) -> DataFrame:
    """``search(vectors, queries)`` on every pair of a vector block and a query block of one part.

    Both tables have vec_id, v and part (0 .. parts - 1); a query may be in
    several parts. A part is cut by a hash of the ids into as many blocks as
    its counts ask for, so that neither a hot part nor many queries meet in
    one task. Vectors travel once for each query block of their part.
    """
    def count(df: DataFrame) -> list[int]:
        found = {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
        return [found.get(p, 0) for p in range(parts)]

    v_blocks = [max(1, -(-n // VECTORS)) for n in count(rows)]
    q_blocks = [max(1, -(-n // QUERIES)) for n in count(queries)]
    hashed = F.xxhash64("vec_id")
    left = (rows.withColumn("vb", F.pmod(hashed, _by_part(v_blocks).cast("long")))
            .withColumn("qb", F.explode(_numbers(q_blocks))))
    right = (queries.withColumn("qb", F.pmod(hashed, _by_part(q_blocks).cast("long")))
             .withColumn("vb", F.explode(_numbers(v_blocks))))
    keys = ["part", "vb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to smaller ids."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def width(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("v"))).first()[0] or 1
