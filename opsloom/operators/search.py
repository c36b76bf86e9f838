"""Full-text, vector and hybrid search over tables of questions.

A side is broadcast on request only after its rows were counted against a
bound; beyond it the same join shuffles. All other joins are left to the planner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from opsloom import rules as R
from opsloom.functions.vectors import certainty
from opsloom.session import cut_lineage, small_batches

#: Questions that are sent to all tasks at most; questions and documents of one block beyond that.
QUERIES_PER_PASS = 1024
BLOCK_OF_QUESTIONS = 4096
DOCUMENTS_PER_BLOCK = 8192
BROADCAST_ROWS = 200_000
#: Sums of (question, document) that one task holds at most.
SUMS_PER_TASK = 1_000_000
#: Texts that one task counts at most.
TEXTS_PER_TASK = 20_000
_DIGITS = 9


def tokens(text: Column) -> Column:
    """Lowered words of letters and digits."""
    return F.filter(F.split(F.lower(text), R.TOKEN_SPLIT), lambda t: t != "")


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table of questions is small enough to broadcast; reads no further than the bound."""
    return df.limit(rows + 1).count() <= rows


def best_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Each task keeps its own first k before the shuffle."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "content",
                query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a word with the question.

    Only words that some question asks for are counted. Texts are dealt by
    their id first, a bounded number to each task, so that the counts of a task
    are bounded too, whatever the splits of the scan; they need no shuffle then.
    """
    number = docs.count()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    asked = queries.select(F.col(query_id).alias("query_id"),
                           F.explode(F.array_distinct(tokens(F.col(query)))).alias("term"))
    few = has_at_most(asked, BROADCAST_ROWS)
    # the (question, document) sums of a task and the texts it counts are bounded
    tasks = max(cores, math.ceil(number * queries.count() / SUMS_PER_TASK) if few else 1, math.ceil(number / TEXTS_PER_TASK))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition(tasks, "doc_id")
    sized = texts.select("doc_id", tokens(F.col("text")).alias("words")).withColumn("dl", F.size("words"))

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # outer: an inner explode would infer a filter that splits every text a second time
    counts = (sized.select("doc_id", "dl", F.explode_outer("words").alias("term"))
              .join(side(asked.select("term").distinct()), "term", "left_semi")
              .groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))
    total, mean = stats.select("n").scalar(), stats.select("avgdl").scalar()
    # counts of a document are together when they meet the questions, so the
    # much larger (question, document) sums need no shuffle of their own; both
    # uses of the counts read one and the same shuffle
    dealt = counts.repartition(tasks, "doc_id")
    idf = dealt.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")).withColumn(
        "idf", F.log(1.0 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf, k1, b = F.col("tf"), R.BM25_K1, R.BM25_B
    weight = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / mean))
    return (dealt.join(side(asked.join(idf, "term")), "term")
            .groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), _DIGITS).alias("score")))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, **names) -> DataFrame:
    return best_per(bm25_scores(docs, queries, **names), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


# ------------------------------------------------------------------ vectors
def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _near(doc: np.ndarray, vectors: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int | None, least: float | None,
          distance: bool, not_self: bool) -> pd.DataFrame:
    """Scores of one block of documents with some questions: those over the bound, the k best of each and their ties."""
    parts = []
    for a in range(0, len(ids), 256):
        own = asked[a:a + 256]
        if distance:
            # distances row by row: exact also for near-equal vectors
            s = np.stack([np.linalg.norm(own - row, axis=1) for row in vectors], axis=1)
        else:
            s = _unit(own) @ _unit(vectors).T
        s = np.round(s, _DIGITS)
        keep = np.ones_like(s, dtype=bool) if least is None else (s <= least if distance else s >= least)
        if not_self:
            keep &= ids[a:a + 256, None] != doc[None, :]
        if k is not None and s.shape[1] > k:
            # rows beyond the k-th best of this block cannot be among the best k; ties stay
            worth = np.where(keep, -s if distance else s, -np.inf)
            keep &= worth >= np.partition(worth, -k, axis=1)[:, [-k]]
        qi, di = np.nonzero(keep)
        parts.append(pd.DataFrame({"query_id": ids[a:a + 256][qi], "doc_id": doc[di], "score": s[qi, di]}))
    found = pd.concat(parts)
    if k is None:
        return found
    return _best(found, k, distance)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.map(np.asarray)).astype("float64")


def _best(found: pd.DataFrame, k: int, distance: bool) -> pd.DataFrame:
    return found.sort_values(["query_id", "score", "doc_id"], ascending=[True, distance, True]).groupby("query_id", sort=False).head(k)


def _near_enough(doc: np.ndarray, unit: np.ndarray, ids: np.ndarray, asked: np.ndarray, least: np.ndarray, k: int | None,
                 not_self: bool) -> pd.DataFrame:
    """Cosines of a block of documents with some questions, where they can reach ``least`` and the block's k best of a question.

    Both sides have length one. Products in single precision leave out what
    their error cannot bring back; the scores are made in double precision.
    """
    error = (unit.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -_DIGITS
    about = asked.astype(np.float32) @ unit.astype(np.float32).T
    if not_self:
        about[ids[:, None] == doc[None, :]] = -np.inf
    if k is not None and about.shape[1] > k:
        open_ = np.flatnonzero(np.isneginf(least))  # of questions that have k hits the worst of these is the bound
        if len(open_):
            least = least.copy()
            least[open_] = np.partition(about[open_], -k, axis=1)[:, -k] - error
    qi, di = np.nonzero((about >= (least - error).astype(np.float32)[:, None]) & (about > -np.inf))
    score = np.empty(len(qi))
    for a in range(0, len(qi), 65_536):
        score[a:a + 65_536] = np.einsum("ij,ij->i", asked[qi[a:a + 65_536]], unit[di[a:a + 65_536]])
    return pd.DataFrame({"query_id": ids[qi], "doc_id": doc[di], "score": np.round(score, _DIGITS)})


def _vector_blocks(rows: DataFrame, id_: str, parts: int, size: int | None = None) -> DataFrame:
    """ids, vectors: the rows of a part, or up to ``size`` of them, as one row of packed numbers."""
    kind = _number(rows)
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema[id_].dataType)), T.StructField("vectors", T.BinaryType())])
    ids = to_arrow_type(rows.schema[id_].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch if size is None else batch.slice(0, size - n)
                held, n, batch = [*held, take], n + take.num_rows, batch.slice(take.num_rows)
                if n == size:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    def block(part: pa.Table) -> pa.RecordBatch:
        own = pa.array([part.column(id_).to_pylist()], pa.list_(ids))
        return pa.RecordBatch.from_arrays([own, pa.array([_matrix(part.column("vector").to_pandas()).astype(kind).tobytes()], pa.binary())], ["ids", "vectors"])

    return cut_lineage(rows.select(F.col(id_), "vector").repartition(parts).mapInArrow(run, schema))


def _number(rows: DataFrame) -> type:
    return np.float32 if "float" in rows.schema["vector"].dataType.simpleString() else np.float64


def _blocks_met(docs: DataFrame, queries: DataFrame, k: int | None, least: float | None, distance: bool, not_self: bool) -> DataFrame:
    """Hits of every question: a task keeps the best of its block of questions while all blocks of documents pass by."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    asks, number = queries.count(), docs.count()
    size = min(BLOCK_OF_QUESTIONS, max(1, QUERIES_PER_PASS // 4, math.ceil(asks / (4 * cores))))
    tasks = math.ceil(asks / size)
    q_kind, d_kind = _number(queries), _number(docs)
    # dealt by number: a block of questions per part, and bounded parts of documents
    own = _vector_blocks(queries, "query_id", tasks)
    theirs = _vector_blocks(docs, "doc_id", max(1, math.ceil(number / (4 * DOCUMENTS_PER_BLOCK))), DOCUMENTS_PER_BLOCK)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    pairs = own.hint("shuffle_replicate_nl").crossJoin(theirs.toDF("by_ids", "by_vectors"))
    bound = (np.inf if distance else -np.inf) if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, best, worst, asked = None, None, None, None

        def done() -> Iterator[pd.DataFrame]:
            if k is not None and best is not None and len(best):
                yield best

        for whole in batches:
            for i in range(whole.num_rows):
                ids, doc = (np.asarray(whole.column(c)[i].values.to_pandas()) for c in ("ids", "by_ids"))
                vectors = np.frombuffer(whole.column("by_vectors")[i].as_py(), d_kind).reshape(len(doc), -1).astype(np.float64)
                key = whole.column("vectors")[i].as_py()
                if told is None or told[0] != key or not pd.Series(told[1]).equals(pd.Series(ids)):
                    yield from done()
                    told, best, worst = (key, ids), None, np.full(len(ids), bound)
                    asked = np.frombuffer(key, q_kind).reshape(len(ids), -1).astype(np.float64)
                    asked = asked if distance else _unit(asked)
                found = []
                unit = vectors if distance else _unit(vectors)
                for a in range(0, len(ids), 256):
                    part = slice(a, a + 256)
                    if distance:
                        found.append(_near(doc, unit, ids[part], asked[part], k, least, True, not_self))
                    else:
                        found.append(_near_enough(doc, unit, ids[part], asked[part], worst[part], k, not_self))
                hits = pd.concat(found)
                if least is not None:
                    hits = hits[hits["score"] <= least if distance else hits["score"] >= least]
                if k is None:
                    yield hits
                    continue
                best = _best(hits if best is None else pd.concat([best, hits]), k, distance)
                if not distance:
                    last = best.groupby("query_id", sort=False)["score"].agg(["size", "min"])
                    last = last["min"].where(last["size"] >= k)
                    worst = np.fmax(worst, pd.Series(ids).map(last).to_numpy(float))
        yield from done()

    def told_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in run(batches):
            yield pa.RecordBatch.from_pandas(found[["query_id", "doc_id", "score"]], schema=arrow, preserve_index=False)

    # parts of the product lie in the order of the questions' blocks, so a task has all documents of a block
    return small_batches(pairs).coalesce(tasks).mapInArrow(told_rows, schema)


def similar_rows(docs: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None,
                 metric: str = "cosine", not_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score): exact similarity of every document with every question.

    ``docs`` has doc_id and vector, ``queries`` query_id and vector. Up to
    QUERIES_PER_PASS questions go to all tasks and the documents stay where
    they are. Beyond that both are packed into blocks that are written once; a
    task holds a block of questions while all documents pass by, and gives the
    best ``k`` per question, or every row at or over ``least``. What is written
    grows with the rows, not with their pairs.
    """
    distance = metric == "euclidean"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, doc_id {id_type}, score double"
    few = queries.select("query_id", "vector").limit(QUERIES_PER_PASS + 1).toPandas()
    if few.empty:
        return docs.sparkSession.createDataFrame([], schema)
    if len(few) <= QUERIES_PER_PASS:
        ids, asked = few["query_id"].to_numpy(), _matrix(few["vector"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                if batch.empty:
                    continue
                found = _near(batch["doc_id"].to_numpy(), _matrix(batch["vector"]), ids, asked, k, least, distance, not_self)
                if k is None:
                    yield found
                    continue
                best = _best(found if best is None else pd.concat([best, found]), k, distance)
            if best is not None:
                yield best

        out = docs.select("doc_id", "vector").mapInPandas(run, schema)
    else:
        out = _blocks_met(docs, queries, k, least, distance, not_self)
    if k is None:
        return out
    order = F.asc("score") if distance else F.desc("score")
    return best_per(out, ["query_id"], [order, F.asc("doc_id")], k)


def vector_search(docs: DataFrame, queries: DataFrame, k: int, least_certainty: float = 0.7) -> DataFrame:
    """Nearest documents with certainty (1 + cosine) / 2 at or over a bound."""
    hits = similar_rows(docs, queries, k)
    sure = F.round(certainty(F.col("score")), _DIGITS)
    return hits.withColumn("certainty", sure).filter(F.col("certainty") >= least_certainty)


# ------------------------------------------------------------------ fusion
def fuse_by_id(vector_hits: DataFrame, text_hits: DataFrame, k: int, alpha: float = R.RERANK_ALPHA) -> DataFrame:
    """Full outer merge on (query_id, doc_id): alpha * vector + (1 - alpha) * text.

    Both inputs carry query_id, doc_id, score.
    """
    v = vector_hits.select("query_id", "doc_id", F.col("score").alias("embedding_score"))
    t = text_hits.select("query_id", "doc_id", F.col("score").alias("fulltext_score"))
    both = v.join(t, ["query_id", "doc_id"], "full_outer")
    origin = (F.when(F.col("fulltext_score").isNull(), "embedding")
              .when(F.col("embedding_score").isNull(), "fulltext").otherwise("hybrid"))
    merged = both.withColumn("search_source", origin).na.fill(0.0, ["embedding_score", "fulltext_score"])
    final = F.round(F.col("embedding_score") * alpha + F.col("fulltext_score") * (1 - alpha), _DIGITS)
    return best_per(merged.withColumn("final_score", final), ["query_id"],
                    [F.desc("final_score"), F.asc("doc_id")], k)


def fuse_by_content(vector_hits: DataFrame, text_hits: DataFrame, k: int, alpha: float = R.CONTENT_ALPHA,
                    text_scale: float = R.CONTENT_BM25_SCALE) -> DataFrame:
    """Merge on equal content; vector score capped at 1, text score scaled and capped.

    Inputs carry query_id, doc_id, content, score and rank. Of several hits
    with one content the last in rank gives the score, the first the row.
    """
    def side(df, name):
        # texts are grouped and joined by a digest and travel once
        return df.withColumn("_key", F.md5("content")).groupBy("query_id", "_key").agg(
            F.max_by("score", F.struct("rank", "doc_id")).alias(f"{name}_score"),
            F.min_by("doc_id", F.struct("rank", "doc_id")).alias(f"{name}_doc"), F.first("content").alias(f"{name}_content"))

    both = side(vector_hits, "vector").join(side(text_hits, "bm25"), ["query_id", "_key"], "full_outer")
    vec = F.least(F.coalesce("vector_score", F.lit(0.0)), F.lit(1.0))
    text = F.least(F.coalesce("bm25_score", F.lit(0.0)) / text_scale, F.lit(1.0))
    scored = both.select(
        "query_id", F.coalesce("vector_doc", "bm25_doc").alias("doc_id"), F.coalesce("vector_content", "bm25_content").alias("content"),
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
        F.round(vec * alpha + text * (1 - alpha), _DIGITS).alias("hybrid_score"))
    return best_per(scored, ["query_id"], [F.desc("hybrid_score"), F.asc("doc_id")], k)


def fuse_three(vector_hits: DataFrame, text_hits: DataFrame, graph_hits: DataFrame, k: int,
               weights: tuple[float, float, float] | None = None) -> DataFrame:
    """Weighted sum per (query_id, doc_id); the graph weight is what the other two leave."""
    w = weights or (R.VECTOR_WEIGHT, R.KEYWORD_WEIGHT, 1.0 - R.VECTOR_WEIGHT - R.KEYWORD_WEIGHT)
    sides = [("vector", vector_hits), ("keyword", text_hits), ("graph", graph_hits)]
    rows = None
    for name, df in sides:
        one = df.select("query_id", "doc_id", "score", F.lit(name).alias("side"),
                        (F.col("related_entity") if "related_entity" in df.columns else F.lit(None).cast("string"))
                        .alias("related_entity"))
        rows = one if rows is None else rows.unionByName(one)

    def of(name):
        return F.coalesce(F.max(F.when(F.col("side") == name, F.col("score"))), F.lit(0.0))

    merged = rows.groupBy("query_id", "doc_id").agg(
        *[of(name).alias(f"{name}_score") for name, _ in sides], F.max("related_entity").alias("related_entity"))
    final = sum(F.col(f"{name}_score") * weight for (name, _), weight in zip(sides, w))
    return best_per(merged.withColumn("final_score", F.round(final, _DIGITS)), ["query_id"],
                    [F.desc("final_score"), F.asc("doc_id")], k)


def rank_fusion(vector_hits: DataFrame, text_hits: DataFrame, alpha: float, constant: int = R.RANK_FUSION_K,
                k: int | None = None) -> DataFrame:
    """Reciprocal ranks: weight / (constant + rank) summed over both lists; inputs carry rank."""
    v = vector_hits.select("query_id", "doc_id", (F.lit(alpha) / (constant + F.col("rank"))).alias("part"))
    t = text_hits.select("query_id", "doc_id", (F.lit(1.0 - alpha) / (constant + F.col("rank"))).alias("part"))
    out = v.unionByName(t).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), _DIGITS).alias("hybrid_score"))
    return out if k is None else best_per(out, ["query_id"], [F.desc("hybrid_score"), F.asc("doc_id")], k)


def search_rows(docs: DataFrame, k: int, mode: str = "hybrid", where: Column | None = None,
                questions: DataFrame | None = None, question_vectors: DataFrame | None = None,
                alpha: float = R.RERANK_ALPHA) -> DataFrame:
    """Filtered search in one call: ``vector``, ``fulltext`` or ``hybrid``.

    Without question vectors the text side alone answers; without any question
    the filtered rows come back newest first.
    """
    kept = docs if where is None else docs.filter(where)
    if questions is None and question_vectors is None:
        return kept.orderBy(F.desc("timestamp"), "doc_id").limit(k)
    if question_vectors is None or mode == "fulltext":
        return bm25_search(kept, questions, k)
    near = similar_rows(kept.filter("vector is not null"), question_vectors, k)
    near = near.withColumn("score", F.round(certainty(F.col("score")), _DIGITS))
    if questions is None or mode == "vector":
        return near
    return fuse_by_id(near, bm25_search(kept, questions, k), k, alpha)


def capped_score(vector: Column, bm25: Column, alpha: float = 0.7, beta: float = 0.3) -> Column:
    return vector * alpha + F.least(bm25 / R.CAPPED_BM25_SCALE, F.lit(1.0)) * beta


def best_per_text(df: DataFrame, keys: list[str] | None = None, score: str = "final_score") -> DataFrame:
    """One row per md5 of ``title:content``, the best-scored."""
    key = F.md5(F.concat(F.coalesce("title", F.lit("")), F.lit(":"), F.coalesce("content", F.lit(""))))
    group = (keys or []) + ["content_hash"]
    row = F.struct(*df.columns)
    return (df.withColumn("_row", row).withColumn("content_hash", key)
            .groupBy(*group).agg(F.max_by("_row", F.struct(score, -F.col("doc_id"))).alias("_row"))
            .select("content_hash", "_row.*"))


def service_first(hits: DataFrame, k: int) -> DataFrame:
    """Hits whose service holds the asked name first, each part by score."""
    named = F.lower("service_name").contains(F.lower("query"))
    return best_per(hits.drop("rank").withColumn("named", named), ["query_id"],
                    [F.desc("named"), F.desc("hybrid_score"), F.asc("doc_id")], k)


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall, F1 and NDCG at k per question; inputs carry query_id, doc_id (and rank)."""
    top = ranked.filter(F.col("rank") <= k)
    marked = top.join(relevant.select("query_id", "doc_id", F.lit(1.0).alias("rel")), ["query_id", "doc_id"], "left")
    gain = F.coalesce("rel", F.lit(0.0))
    got = marked.groupBy("query_id").agg(F.sum(gain).alias("found"),
                                         F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    size = relevant.groupBy("query_id").agg(F.count("*").alias("wanted"))
    ideal_terms = F.transform(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")),
                              lambda i: 1.0 / F.log2(i + 1))
    ideal = F.aggregate(ideal_terms, F.lit(0.0), lambda s, x: s + x)
    p, r = F.col("found") / k, F.col("found") / F.col("wanted")
    return size.join(got, "query_id", "left").na.fill(0.0, ["found", "dcg"]).select(
        "query_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg"))
