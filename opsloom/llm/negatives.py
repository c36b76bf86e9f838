"""Hard negatives by BOND: dimensions are read one after the other and bounds on the rest shrink the candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, stored, table
from opsloom.llm.maxscore import quantized
from opsloom.llm.vectors import usable, width
from opsloom.operators.tiles import pass_by, tile_count

#: Dimensions that are read before the candidates are tested again.
STEP = 8
#: A negative's score is between LOW and HIGH parts of SCALE of the positive's.
LOW, HIGH, SCALE = 30, 90, 100


class Columns:
    """Vectors of one tile by dimension, in the order of their ids, with each dimension's least and largest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.whole = ids[order], labels[order], np.ascontiguousarray(x[order].T)
        self.low, self.high = self.whole.min(axis=1), self.whole.max(axis=1)
        self.most = float(np.abs(self.whole).max(initial=0))
        self.kinds: dict[type, np.ndarray] = {}

    def typed(self, q: np.ndarray) -> np.ndarray:
        """The columns in the smallest type whose sums with ``q`` are exact."""
        bound = self.most * float(np.abs(q).max(initial=0)) * len(q)
        kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64
        if kind not in self.kinds:
            self.kinds[kind] = self.whole.astype(kind)
        return self.kinds[kind]

    def scan(self, q: np.ndarray, at: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of those candidates ``at`` that ``keep`` leaves.

        Dimensions are read in the order of the question's magnitudes. After
        each step ``keep(least, most)`` says from the bounds of the final
        scores which candidates stay; once half of them are out, the columns
        are read at the others only.
        """
        order = np.argsort(-np.abs(q), kind="stable")
        order = order[q[order] != 0]
        ends = np.stack([q[order] * self.low[order], q[order] * self.high[order]])
        most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        columns = self.typed(q)
        weights, open_ = q.astype(columns.dtype), np.ones(len(at), bool)
        total = np.zeros(len(at), columns.dtype)
        for a in range(0, len(order), STEP):
            dims, b = order[a:a + STEP], min(a + STEP, len(order))
            total += weights[dims] @ (columns[dims] if len(at) == columns.shape[1] else columns[np.ix_(dims, at)])
            open_ &= keep(total + least[b], total + most[b])
            if 2 * np.count_nonzero(open_) <= len(at):
                at, total, open_ = at[open_], total[open_], np.ones(int(open_.sum()), bool)
                if not len(at):
                    break
        return at[open_], total[open_].astype(np.int64)

    def best_of_label(self, own: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best other vectors of the label, ties to smaller ids."""
        def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            return most >= np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else np.ones(len(least), bool)

        at, score = self.scan(q, np.flatnonzero((self.labels == label) & (self.ids != own)), keep)
        order = np.argsort(-score, kind="stable")[:k]  # places are in the order of ids
        return at[order], score[order]

    def best_in_windows(self, label: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window of scores the places and scores of the k best vectors of other labels."""
        def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            out = np.zeros(len(least), bool)
            for lo, hi in zip(low, high):
                inside = (most >= lo) & (least <= hi)
                sure = least[(least >= lo) & (most <= hi)]
                if len(sure) > k:
                    inside &= most >= np.partition(sure, len(sure) - k)[len(sure) - k]
                out |= inside
            return out

        at, score = self.scan(q, np.flatnonzero(self.labels != label), keep)
        out = []
        for lo, hi in zip(low, high):
            own = np.flatnonzero((score >= lo) & (score <= hi))
            own = own[np.argsort(-score[own], kind="stable")[:k]]
            out.append((at[own], score[own]))
        return out


def _first(found: DataFrame, keys: list[str], k: int, by: str, name: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc(by), name)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mined(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of (vec_id, v, label).

    Components become floor(scale * x). Anchors are the rows whose id
    ``every`` divides; of rows that share an anchor's id the one with the
    least vector, then label, is the anchor, and all of them are no others of
    it. Other repeated rows count each. A negative's whole-number product lies
    between LOW and HIGH parts of SCALE of the positive's; a positive of a
    score below zero has none. Shorter vectors end in zeros, zero vectors take
    part. Ties go to smaller ids. Scores must fit a long. Empty table: no rows.
    """
    dim, count = width(rows), tile_count(rows.count())
    anchors = stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id")
                     .agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v"), "anchors")

    def build(vectors: pa.Table) -> Columns:
        return Columns(vectors.column("vec_id").to_numpy(), vectors.column("label").to_numpy(), quantized(vectors.column("v"), dim, scale))

    found = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def same(tile: Columns, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for own, label, q in zip(asked.column("vec_id").to_pylist(), asked.column("label").to_pylist(), quantized(asked.column("v"), dim, scale)):
            at, score = tile.best_of_label(own, label, q, positives)
            for column, values in zip(out, ([own] * len(at), tile.ids[at].tolist(), score.tolist())):
                column.extend(values)
        yield batch_of(found, dict(zip(found.names, out)))

    slim = rows.select("vec_id", "label", "v")
    near = pass_by(slim, anchors, count, build, same, "anchor_id long, positive_id long, positive_score long")
    chosen = _first(near, ["anchor_id"], positives, "positive_score", "positive_id")
    score = F.col("positive_score")
    window = F.struct(F.col("rank").alias("p_rank"), "positive_id", "positive_score")
    asks = (chosen.where(score >= 0).groupBy("anchor_id").agg(F.sort_array(F.collect_list(window)).alias("windows"))
            .join(anchors, F.col("anchor_id") == F.col("vec_id")).select("vec_id", "label", "v", "windows"))
    asks = stored(asks, "windows")
    kept = pa.schema([("anchor_id", pa.int64()), ("p_rank", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
                      ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def other(tile: Columns, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in kept]
        for own, label, q, windows in zip(asked.column("vec_id").to_pylist(), asked.column("label").to_pylist(),
                                          quantized(asked.column("v"), dim, scale), asked.column("windows").to_pylist()):
            low = np.array([-(-LOW * w["positive_score"] // SCALE) for w in windows])
            high = np.array([HIGH * w["positive_score"] // SCALE for w in windows])
            for w, (at, score) in zip(windows, tile.best_in_windows(label, q, low, high, negatives)):
                n = len(at)
                for column, values in zip(out, ([own] * n, [w["p_rank"]] * n, [w["positive_id"]] * n, [w["positive_score"]] * n,
                                                tile.ids[at].tolist(), score.tolist())):
                    column.extend(values)
        yield batch_of(kept, dict(zip(kept.names, out)))

    plain = slim.withColumn("windows", F.lit(None).cast(asks.schema["windows"].dataType))
    far = pass_by(plain, asks, count, build, other, "anchor_id long, p_rank int, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(far, ["anchor_id", "p_rank"], negatives, "negative_score", "negative_id").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for the embeddings; ids that 7 divides bear the next label."""
    embeddings = table(spark, sf_dir, "embeddings").where("label is not null")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(embeddings.withColumn("label", label), zero=True, more=["label"])
    return mined(rows)


OP11_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
             cast(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])) as bigint) as score
      from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score,
             row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
      where p.k <= 5)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
