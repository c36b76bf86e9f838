import re

import numpy as np
from pyspark.sql import functions as F

from opsloom.functions import vectors as V
from opsloom.operators import filters as FL
from opsloom.operators import clusters
from opsloom.operators import search as S


def vectors(spark, m, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} bigint, vector array<float>")


def test_fusion_hand_values(spark):
    v = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8)], "query_id int, doc_id int, score double")
    t = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.6)], "query_id int, doc_id int, score double")
    rows = {r.doc_id: r for r in S.fuse_by_id(v, t, 10).collect()}
    assert {d: (round(r.final_score, 6), r.search_source) for d, r in rows.items()} == {
        1: (0.78, "hybrid"), 2: (0.56, "embedding"), 3: (0.18, "fulltext")}
    cv = spark.createDataFrame([(1, 1, "x", 0.9, 1)], "query_id int, doc_id int, content string, score double, rank int")
    ct = spark.createDataFrame([(1, 5, "x", 1.5, 1)], "query_id int, doc_id int, content string, score double, rank int")
    row = S.fuse_by_content(cv, ct, 5).first()
    assert (row.doc_id, round(row.hybrid_score, 6)) == (1, 0.74)


def test_nearest_equals_brute_force_over_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERIES_PER_PASS", 7)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 8)).astype("float32")
    m[40:70] = m[3]  # copies: ties are broken by id
    docs, asks = vectors(spark, m, "doc_id").repartition(5), vectors(spark, m[:20], "query_id")
    got = {(r.query_id, r["rank"]): r.doc_id for r in S.similar_rows(docs, asks, 6, not_self=True).collect()}
    u = m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    sims = np.round(u[:20] @ u.T, 9)
    for q in range(20):
        best = sorted((-sims[q, d], d) for d in range(120) if d != q)[:6]
        assert [got[q, i + 1] for i in range(6)] == [d for _, d in best]


def sequential_leaders(m, threshold):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    leaders, out = [], []
    for i in range(len(u)):
        near = [j for j in leaders if round(float(u[i] @ u[j]), 9) > threshold]
        out.append(near[0] if near else i)
        if not near:
            leaders.append(i)
    return out


def test_leader_clusters_equal_sequential_rule(spark):
    rng = np.random.default_rng(5)
    m = np.repeat(rng.normal(size=(12, 6)), 15, axis=0) + rng.normal(scale=0.35, size=(180, 6))
    m[60:120] = m[7]  # a third of all rows are copies
    m = m.astype("float32").astype("float64")
    for in_task in (1, 10, 1000):
        rows = clusters.leader_clusters(vectors(spark, m, "item_id").repartition(4), 0.8, in_task).collect()
        got = {r.item_id: r.leader_id for r in rows}
        assert [got[i] for i in range(180)] == sequential_leaders(m, 0.8)


def test_leader_blocks_are_written_once(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    monkeypatch.setattr(clusters, "BLOCKS_PER_PART", 2)
    m = np.random.default_rng(5).normal(size=(150, 3)).astype("float32").astype("float64")
    df = vectors(spark, m, "item_id").selectExpr("item_id", "cast(vector as array<float>) as vector")
    got = {r.item_id: r.leader_id for r in clusters.leader_clusters(df, 0.9, 20).collect()}
    assert [got[i] for i in range(150)] == sequential_leaders(m, 0.9)
    rows = df.selectExpr("item_id as pos", "vector")
    assert "Generate" not in clusters._met(rows, rows, 0.9)._jdf.queryExecution().executedPlan().toString()


def test_planner_sizes_do_not_grow_with_the_rounds(spark, monkeypatch):
    """Each round once squared the size that the planner takes a table for, into numbers that fill the driver."""
    bits, cut = [], clusters.cut_lineage

    def told(df):
        out = cut(df)
        bits.append(int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length())
        return out

    monkeypatch.setattr(clusters, "cut_lineage", told)
    chain = np.array([[np.cos(0.5 * i), np.sin(0.5 * i)] for i in range(12)])
    got = {r.item_id: r.leader_id for r in clusters.leader_clusters(vectors(spark, chain, "item_id"), 0.8, 1).collect()}
    assert [got[i] for i in range(12)] == sequential_leaders(chain.astype("float32").astype("float64"), 0.8)
    assert len(bits) > 15 and max(bits) < 200


def test_first_near_decides_as_in_double_precision():
    rng = np.random.default_rng(11)
    angles = np.concatenate([np.arccos(0.8) + rng.normal(scale=s, size=60) for s in (1e-10, 1e-9, 1e-8, 1e-6, 1e-3)])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    theirs = np.array([[1.0, 0.0], [0.0, 1.0], [np.cos(0.1), np.sin(0.1)]])
    pos, asked = np.arange(300) + 2, np.array([0, 1, 150])
    got = clusters._first_near(pos, x, asked, theirs, 0.8)
    near = (np.round(x @ theirs.T, 9) > 0.8) & (asked[None, :] < pos[:, None])
    assert got.tolist() == [asked[n.argmax()] if n.any() else -1 for n in near] and len(set(got.tolist())) == 3


def test_leaders_of_chains_and_awkward_vectors(spark):
    """A chain in which each item is near the one before only; zero, null and repeated vectors; no items."""
    chain = [[float(np.cos(0.5 * i)), float(np.sin(0.5 * i))] for i in range(10)]
    rows = [(i, v) for i, v in enumerate(chain)] + [(20, [0.0, 0.0]), (21, [0.0, 0.0]), (22, None), (23, chain[3]), (24, chain[3])]
    df = spark.createDataFrame(rows, "item_id int, vector array<float>")
    for in_task in (1, 3, 100):
        got = {r.item_id: r.leader_id for r in clusters.leader_clusters(df, 0.8, in_task).collect()}
        want = dict(zip(range(10), sequential_leaders(np.array(chain), 0.8)))
        assert got == want | {20: 20, 21: 21, 23: want[3], 24: want[3]}
    assert clusters.leader_clusters(df.where("item_id < 0")).count() == 0


def test_bm25_ranks_and_prefix(spark):
    docs = spark.createDataFrame([(1, "mysql slow query mysql"), (2, "mysql fine"), (3, "redis cache")], "doc_id int, content string")
    asks = spark.createDataFrame([(1, "Mysql slow"), (2, "nothing here")], "query_id int, query string")
    top = [r.doc_id for r in S.bm25_search(docs, asks, 5).orderBy("rank").collect()]
    assert top == [1, 2]
    assert [r.doc_id for r in S.bm25_search(docs, asks, 1).collect()] == top[:1]


def test_bm25_without_broadcast_is_the_same(spark, monkeypatch, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    asks = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    one = S.bm25_search(docs, asks, 5).collect()
    monkeypatch.setattr(S, "BROADCAST_ROWS", 1)
    assert sorted(one) == sorted(S.bm25_search(docs, asks, 5).collect())


def test_filters(spark):
    df = spark.createDataFrame([("service-b", "ERROR", 25, "incident_001_x.log", ["CPU"]), ("service-a", "INFO", 70, "b.log", [])],
                               "service_name string, log_level string, line_number int, log_file string, keywords array<string>")
    assert df.filter(FL.search_filter()).count() == 2
    assert df.filter(FL.search_filter(service=["service-b", "x"], lines=(20, 60), log_file="incident_001*.log")).count() == 1
    assert df.filter(FL.search_filter(keywords=["CPU"], level="INFO")).count() == 0


def test_text_vectors_and_user_encoder(spark):
    df = spark.createDataFrame([(1, "mysql slow query"), (2, "mysql query slow"), (3, "red green blue")], "id int, content string")
    v = {r.id: np.array(r.vector) for r in V.encode_texts(df).collect()}
    assert abs(float(v[1] @ v[2]) - 1) < 1e-6 and float(v[1] @ v[3]) < 0.5
    out = V.encode_with(df, lambda: lambda texts: [[float(len(t))] for t in texts]).collect()
    assert {r.id: r.vector for r in out} == {1: [16.0], 2: [16.0], 3: [14.0]}


def test_similarity_columns(spark):
    row = spark.range(1).select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
                                V.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("e")).first()
    assert (row.z, row.e) == (0.0, 5.0)


def test_blocks_of_questions_give_the_same_hits(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    x[100:200] = x[7]  # ties
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    q = d.withColumnRenamed("doc_id", "query_id")
    for args in ({"k": 4}, {"k": 3, "metric": "euclidean"}, {"least": 0.95}, {"k": 3, "not_self": True}):
        want = sorted(S.similar_rows(d, q, **args).collect())
        with monkeypatch.context() as m:
            m.setattr(S, "QUERIES_PER_PASS", 40)
            m.setattr(S, "DOCUMENTS_PER_BLOCK", 70)
            assert sorted(S.similar_rows(d, q, **args).collect()) == want
    assert S.similar_rows(d, q.filter("false"), 3).count() == 0


def test_bm25_sums_of_a_task_are_bounded(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('disk full on host ', id % 7) as content")
    asks = spark.range(20).selectExpr("id as query_id", "concat('disk host ', id % 7) as query")
    whole = {tuple(r) for r in S.bm25_scores(docs, asks).collect()}
    monkeypatch.setattr(S, "SUMS_PER_TASK", 400)
    scores = S.bm25_scores(docs, asks)
    assert {tuple(r) for r in scores.collect()} == whole and len(whole) == 8000
    assert max(scores.rdd.glom().map(len).collect()) < 900  # a document has 20; before, 8 tasks at most held all 8000


def test_bm25_texts_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "TEXTS_PER_TASK", 2)
    kb = spark.createDataFrame([(i, f"disk {'slow ' * (i % 3)}n{i}") for i in range(60)], "doc_id long, content string")
    asks = spark.createDataFrame([(1, "slow disk"), (2, "n7")], "query_id long, query string")
    found = S.bm25_scores(kb, asks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[doc_id#\d+L\], (\d+)", plan)]
    assert dealt and min(dealt) >= 30
    rows = {(r.query_id, r.doc_id) for r in found.collect()}
    assert rows == {(1, i) for i in range(60)} | {(2, 7)}


def test_blocks_of_vectors_are_written_once(spark, monkeypatch):
    """Many questions: no vector is copied per block of the other side, and a block of questions gives its best once."""
    monkeypatch.setattr(S, "QUERIES_PER_PASS", 40)
    monkeypatch.setattr(S, "DOCUMENTS_PER_BLOCK", 10)
    x = np.random.default_rng(8).normal(size=(400, 4))
    x[50:90], x[200:220] = x[3], 0
    d = spark.createDataFrame([(f"d{i:03}", [float(y) for y in v]) for i, v in enumerate(x)], "doc_id string, vector array<float>").repartition(3)
    q = d.withColumnRenamed("doc_id", "query_id")
    hits = S._blocks_met(d, q, 3, None, False, True)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroup" not in plan
    assert hits.count() <= 3 * 400  # before, three for each of 40 blocks of documents
    u = x.astype("float32").astype("float64")
    length = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, length, out=np.zeros_like(u), where=length > 0)
    s = np.round(u @ u.T, 9)
    want = {(f"d{i:03}", f"d{j:03}", n + 1) for i in range(400) for n, (_, j) in enumerate(sorted((-s[i, j], j) for j in range(400) if j != i)[:3])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in S.similar_rows(d, q, 3, not_self=True).collect()} == want
