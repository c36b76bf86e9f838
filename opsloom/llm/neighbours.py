"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, table
from opsloom.llm.vectors import asked, best, block_pairs, matrix, usable, width

#: Vectors that the partition and its classifier are learned from, at most; drawn by a hash of the id.
SAMPLE = 8192
PARTS = 16
#: Neighbours per vertex of the sample's graph.
DEGREE = 10
#: Share of true neighbours that the probes must reach on held-back sample vectors, and masses that are tried for it.
RECALL = 0.97
MASSES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 1.1)
#: Shares of the sample's rows that are shorter than the layers above the first.
LAYERS = (0.8, 0.97)
FOUND = "query_id long, vec_id long, score double"


def best_rows(queries: np.ndarray, rows: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Places of the k largest inner products of each query; ``own``: the queries are the rows, and not their own neighbours."""
    out = np.empty((len(queries), k), np.int64)
    for a in range(0, len(queries), 512):
        s = queries[a:a + 512] @ rows.T
        if own:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 30, slack: float = 1.1) -> np.ndarray:
    """Part of each vertex: few cut edges, no part over ``slack`` times its share.

    Starts from halves along principal directions, then lets vertices move to
    the part that most neighbours are in, those with most to gain first, as
    long as there is room.
    """
    n = len(x)
    part = np.zeros(n, np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        own = x[rows] - x[rows].mean(axis=0)
        _, vectors = np.linalg.eigh(own.T @ own)
        rows = rows[np.argsort(own @ vectors[:, -1], kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        halve(rows[:cut], first, left)
        halve(rows[cut:], first + left, count - left)

    halve(np.arange(n), 0, parts)
    most = int(np.ceil(slack * n / parts))
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        near = np.bincount(starts * parts + part[ends], minlength=n * parts).reshape(n, parts)
        gain = near.max(axis=1) - near[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]:
            to = int(near[v].argmax())
            if size[to] < most:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if moved < n // 500 + 1:
            break
    return part


def _chances(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Softmax regression on the direction of each row."""
    z = np.hstack([_unit(x), np.ones((len(x), 1))]) @ weights
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _length(x: np.ndarray) -> np.ndarray:
    most = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)
    return most * np.linalg.norm(x / most[:, None], axis=1)


@dataclass
class Router:
    """Layers of rows by length, the parts of each layer, and the probability mass that a query's probes must reach.

    ``edges`` are the least lengths of the layers above the first. ``homes``
    has a softmax regression from a row's direction to its part per layer,
    ``asks`` one from a query's direction to the parts of all layers.
    """
    edges: np.ndarray
    homes: list[np.ndarray]
    asks: np.ndarray
    mass: float

    @property
    def parts(self) -> int:
        return sum(w.shape[1] for w in self.homes)

    def home(self, x: np.ndarray) -> np.ndarray:
        layer, out, first = np.searchsorted(self.edges, _length(x), "right"), np.zeros(len(x), np.int64), 0
        for k, weights in enumerate(self.homes):
            own = layer == k
            out[own] = first + _chances(x[own], weights).argmax(axis=1)
            first += weights.shape[1]
        return out

    def probes(self, x: np.ndarray, mass: float | None = None) -> np.ndarray:
        """Query by part: the most probable parts up to the mass."""
        p = _chances(x, self.asks)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, before < (self.mass if mass is None else mass), axis=1)
        return out


def _regression(x: np.ndarray, wanted: np.ndarray, steps: int) -> np.ndarray:
    """Softmax regression of row shares on directions, by Adam."""
    a = np.hstack([_unit(x), np.ones((len(x), 1))])
    weights = np.zeros((a.shape[1], wanted.shape[1]))
    m = v = np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = a.T @ (_chances(x, weights) - wanted) / len(a) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - 0.3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return weights


def learn(x: np.ndarray, parts: int = PARTS, degree: int = DEGREE, recall: float = RECALL, k: int = 20, steps: int = 300) -> Router:
    """Layers, partitions and router of a sample, and the mass that reaches ``recall`` for rows held back from all of it.

    Long rows have large products with any query that leans their way, so that
    rows are told apart by length first: the longest 3 %, the next 17 %, the
    rest (a layer that is hardly longer than the rest joins it). Each layer's
    neighbour graph is cut into balanced parts, and a classifier learns them.
    The query's classifier learns where the rows of largest product with the
    sample's rows lie; the mass is tuned with the products of original vectors.
    """
    x = np.unique(x / max(np.abs(x).max(initial=0), 1e-300), axis=0)
    x = x[np.random.default_rng(5).permutation(len(x))]
    one = Router(np.zeros(0), [np.zeros((x.shape[1] + 1, 1))], np.zeros((x.shape[1] + 1, 1)), 1.0)
    held, x = x[:min(512, len(x) // 8)], x[min(512, len(x) // 8):]
    k = min(k, len(x) - 1)
    if not len(held) or len(x) // (4 * degree) < 2:
        return one
    length = _length(x)
    edges = np.array([e for e in np.quantile(length, LAYERS) if e > 1.05 * np.median(length)])
    layer, homes = np.searchsorted(edges, length, "right"), []
    for n in range(len(edges) + 1):
        own = _unit(x[layer == n])
        count = max(1, min(parts, len(own) // (4 * degree)))
        graph = best_rows(own, own, min(degree, len(own) - 1), True) if count > 1 else None
        part = balanced_parts(own, graph, count) if count > 1 else np.zeros(len(own), np.int64)
        wanted = np.eye(count)[part] if count == 1 else 0.5 * np.eye(count)[part] + 0.5 * np.eye(count)[part[graph]].mean(axis=1)
        homes.append(_regression(own, wanted, steps if count > 1 else 0))
    router = Router(edges, homes, np.zeros((x.shape[1] + 1, sum(w.shape[1] for w in homes))), 1.0)
    home = router.home(x)
    router.asks = _regression(x, np.eye(router.parts)[home[best_rows(x, x, k, True)]].mean(axis=1), steps)
    truth = home[best_rows(held, x, k, False)]
    for router.mass in MASSES:
        if np.take_along_axis(router.probes(held), truth, axis=1).mean() >= recall:
            break
    return Router(edges * 1.0, homes, router.asks, router.mass)


def fitted(rows: DataFrame, dim: int, sample: int = SAMPLE) -> Router:
    n = rows.count()
    drawn = rows.where(F.abs(F.xxhash64("vec_id", F.lit(1)) / F.lit(float(1 << 63))) < sample / max(1, n))
    got = drawn.select("v").limit(2 * sample).toArrow()
    x = matrix(got.column("v"), dim) if got.num_rows else np.zeros((0, dim))
    router = learn(x)
    router.edges = router.edges * max(np.abs(x).max(initial=0), 1e-300)  # the sample was scaled by its largest component
    return router


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: nearest vectors by inner product in double precision.

    The partition and its classifier are learned from SAMPLE vectors at most;
    every row is indexed, in the most probable part of its layer of lengths. A
    query goes to its most probable parts, up to the mass that reached RECALL
    for vectors held back from the graph and the classifiers, and is scored
    exactly against all of them.

    Rows without id, null or zero vectors and those with null or non-finite
    components take no part. Rows that bear the query's id are its own;
    otherwise repeated rows are candidates each. Shorter vectors end in
    zeros. Empty table: no rows.
    """
    rows = usable(embeddings, zero=False)
    dim = width(rows)
    router = router or fitted(rows, dim)
    parts = router.parts
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("part", pa.int32())])

    def routed(probing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("v"), dim)
                at, part = np.nonzero(router.probes(x)) if probing else (np.arange(len(x)), router.home(x))
                taken = batch.take(pa.array(at))
                yield batch_of(schema, {"vec_id": taken.column("vec_id"), "v": taken.column("v"), "part": part.astype(np.int32)})
        return run

    homed = rows.mapInArrow(routed(False), "vec_id long, v array<double>, part int")
    probing = asked(rows, every).mapInArrow(routed(True), "vec_id long, v array<double>, part int")

    def rerank(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, x = vectors.column("vec_id").to_numpy(), matrix(vectors.column("v"), dim)
        own, q = queries.column("vec_id").to_numpy(), matrix(queries.column("v"), dim)
        out: list[list] = [[], [], []]
        for a in range(0, len(q) if len(x) else 0, 128):
            s = q[a:a + 128] @ x.T
            s[own[a:a + 128, None] == ids] = -np.inf
            last = np.partition(s, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)]
            slack = 1e-10 * np.linalg.norm(q[a:a + 128], axis=1) * np.linalg.norm(x, axis=1).max()
            for i in range(len(s)):
                at = np.flatnonzero((s[i] >= last[i] - slack[i]) & (s[i] > -np.inf))
                score = (x[at] * q[a + i]).sum(axis=1)  # equal vectors get equal scores, wherever they lie
                order = np.lexsort((ids[at], -score))[:k]
                out[0].extend([own[a + i]] * len(order))
                out[1].extend(ids[at[order]].tolist())
                out[2].extend(score[order].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return best(block_pairs(homed, probing, parts, rerank, FOUND), k)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
