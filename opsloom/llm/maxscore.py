"""Exact top-k inner products of integer vectors by MaxScore over postings per component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import table
from opsloom.llm.vectors import asked, best, block_pairs, matrix, usable, width

FOUND = "query_id long, vec_id long, score long"
#: Terms that are probed together before candidates are dropped again.
STEP = 8


class Postings:
    """Per component the vectors that are not zero there, with their values and bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids = ids
        self.columns = np.ascontiguousarray(x.T)
        self.lists = []
        for column in self.columns:
            at = np.flatnonzero(column)
            self.lists.append((None if len(at) == len(column) else at, column if len(at) == len(column) else column[at]))
        self.high = x.max(axis=0, initial=0)  # a vector that is not in a list counts zero there
        self.low = x.min(axis=0, initial=0)

    def add(self, total: np.ndarray, term: int, weight: int) -> None:
        at, values = self.lists[term]
        if at is None:
            total += values * weight
        else:
            total[at] += values * weight

    def top(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores), ties to smaller ids, the query's own id left out.

        Terms are sorted by the most they can add. A few vectors that lead
        after the first terms are scored whole; the k-th of them bounds the
        result from below. The terms at the end whose bounds sum to less than
        that are not essential: a vector needs the others to compete. Postings
        of the essential terms are added for all, the rest is probed for those
        vectors only that can still reach the bound.
        """
        terms = np.flatnonzero(q)
        bound = np.maximum(q[terms] * self.high[terms], q[terms] * self.low[terms])
        order = np.argsort(-bound, kind="stable")
        terms, rest = terms[order], np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        open_ = self.ids != own
        total, done = np.zeros(len(self.ids), np.int64), 0
        for done in range(min(len(terms), 2 * STEP)):
            self.add(total, terms[done], q[terms[done]])
        done = min(len(terms), 2 * STEP)
        places = np.flatnonzero(open_)
        if len(places) > 4 * k:
            lead = places[np.argpartition(-total[places], 4 * k)[:4 * k]]
            whole = q[terms] @ self.columns[terms][:, lead]
            least = np.partition(whole, len(lead) - k)[len(lead) - k]
            essential = max(done, int(np.argmax(rest < least)) if (rest < least).any() else len(terms))
            for t in range(done, essential):
                self.add(total, terms[t], q[terms[t]])
            places = places[total[places] + rest[essential] >= least]
            score = total[places]
            for t in range(essential, len(terms), STEP):
                probed = terms[t:t + STEP]
                score = score + q[probed] @ self.columns[probed][:, places]
                keep = score + rest[min(t + STEP, len(terms))] >= least
                places, score = places[keep], score[keep]
        else:
            score = q[terms] @ self.columns[terms][:, places]
        order = np.lexsort((self.ids[places], -score))[:k]
        return self.ids[places[order]], score[order]


def quantized(column, dim: int, scale: int) -> np.ndarray:
    return np.floor(matrix(column, dim) * scale).astype(np.int64)


def top_products(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of each query with all other vectors.

    Components become floor(scale * x). Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part; zero vectors
    do. Rows that bear the query's id are its own; otherwise repeated rows are
    candidates each. Shorter vectors end in zeros. Scores must fit a long.
    Empty table: no rows. Queries meet all rows in blocks; every block gives
    its k best, which are merged.
    """
    rows = usable(embeddings, zero=True).withColumn("part", F.lit(0))
    dim = width(rows)

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        postings = Postings(vectors.column("vec_id").to_numpy(), quantized(vectors.column("v"), dim, scale))
        out: list[list] = [[], [], []]
        if len(postings.ids):
            for own, q in zip(queries.column("vec_id").to_pylist(), quantized(queries.column("v"), dim, scale)):
                ids, score = postings.top(q, k, own)
                out[0].extend([own] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(score.tolist())
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out)})

    return best(block_pairs(rows, asked(rows, every).withColumn("part", F.lit(0)), 1, search, FOUND), k)


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id,
             cast(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])) as bigint) as score
      from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
