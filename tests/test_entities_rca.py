from pyspark.sql import functions as F

from opsloom.operators import entities as E
from opsloom.operators import rca as C
from opsloom.operators import search as S


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_pattern_entities_and_overlap(spark):
    rows = E.extract_entities(docs(spark, "order-service calls mysql at 10.0.0.1 on 2024-01-01T00:00:00Z ERROR")).orderBy("ord").collect()
    assert [(r.text, r.label) for r in rows] == [
        ("order-service", "SERVICE"), ("mysql", "DATABASE"), ("10.0.0.1", "IP_ADDRESS"),
        ("2024-01-01T00:00:00Z", "TIMESTAMP"), ("ERROR", "ERROR")]
    assert [(r.start, r.end) for r in rows][:2] == [(0, 13), (20, 25)]


def test_surer_span_replaces_or_moves_to_the_end(spark):
    spans = F.array(*[F.struct(F.lit(t).alias("text"), F.lit("X").alias("label"), F.lit(a).alias("start"), F.lit(b).alias("end"),
                               F.lit(c).alias("confidence")) for t, a, b, c in
                      [("p", 0, 5, 0.6), ("q", 3, 8, 0.9), ("r", 9, 12, 0.7), ("s", 4, 6, 0.5)]])
    row = spark.range(1).select(E.merge_overlaps(spans).alias("i"), E.merge_overlaps(spans, append=True).alias("a")).first()
    assert [s.text for s in row.i] == ["q", "r"]
    assert [s.text for s in row.a] == ["q", "r"]


def test_relations(spark):
    d = docs(spark, "redis depends on mysql. cache depends on redis.", "order-service with mysql" + " " * 60 + "redis")
    ents = E.extract_entities(d)
    rows = {(r.doc_id, r.relation, r.source_text, r.target_text, r.inferred) for r in E.extract_relations(d, ents).collect()}
    assert (0, "DEPENDS_ON", "redis", "mysql", False) in rows
    assert not any(r[2] == "cache" for r in rows)
    assert (1, "USES", "order-service", "mysql", True) in rows
    assert not any(r[3] == "redis" and r[0] == 1 for r in rows)


def test_near_relations_equal_all_pairs(spark):
    d = docs(spark, " ".join(["a-service mysql", "x" * 30, "b-server docker b-api error latency redis"] * 6))
    ents = E.extract_entities(d)
    e = ents.orderBy("ord").collect()
    rule = {frozenset(p): k for *p, k in E.R.NEAR_PAIR_RULES}
    want = sorted((a.ord, b.ord, rule[frozenset((a.label, b.label))]) for i, a in enumerate(e) for b in e[i + 1:]
                  if 0 < b.start - a.end < 50 and frozenset((a.label, b.label)) in rule)
    got = sorted((r.source_ord, r.target_ord, r.relation) for r in E.near_relations(ents).collect())
    assert got == want and want


def test_question_entities(spark):
    q = spark.createDataFrame([(1, "Service B1 CPU 超时, restart database")], "query_id int, query string")
    rows = {(r.text, r.label) for r in E.question_entities(q).collect()}
    assert ("service-b1", "SERVICE") in rows and ("cpu", "COMPONENT_CPU") in rows and ("database", "COMPONENT_DATABASE") in rows
    assert ("超时", "INCIDENT_TIMEOUT") in rows and ("restart", "OPERATION_RESTART") in rows


def test_solution_score_hand_value(spark):
    causes = spark.createDataFrame([(1, "资源不足", "resource", 0.7)], "query_id int, cause string, cause_type string, confidence double")
    rows = C.solution_scores(causes).orderBy("rank").collect()
    assert abs(rows[0].score - 0.5821667) < 1e-6 and rows[0].priority == "中"


def test_causes_and_fallback(spark):
    q = spark.createDataFrame([(1, "timeout"), (2, "slow"), (3, "hello")], "query_id int, query string")
    ev = spark.createDataFrame([(1, "ERROR x", "service-b", 0.9), (1, "ERROR y", "unknown", 0.95)],
                               "query_id int, content string, service_name string, hybrid_score double")
    rel = spark.createDataFrame([(1, "a", "b", "DEPENDS_ON")], "query_id int, from_service string, to_service string, relation string")
    ranked = C.rank_causes(q, C.log_causes(ev), C.relation_causes(rel))
    rows = {(r.query_id, r["rank"]): r for r in ranked.collect()}
    assert rows[1, 1].cause.startswith("service-b服务出现故障") and rows[1, 2].evidence_type == "dependency"
    assert rows[2, 1].cause == "系统性能瓶颈" and (3, 1) not in rows
    sol = {(r.query_id, r["rank"]): r.solution for r in C.cause_solutions(ranked).collect()}
    assert sol[1, 2].startswith("检查依赖服务状态")


def test_balanced_and_plain_merge(spark):
    rows = [(1, "log", f"l{i}", 0.9 - i / 100) for i in range(12)] + [(1, "knowledge", f"k{i}", 0.3) for i in range(6)] + [(1, "entity", "e", 0.1)]
    df = spark.createDataFrame(rows, "query_id int, result_type string, item_id string, relevance double")
    kinds = [r.result_type for r in C.merge_evidence(df, 12).collect()]
    assert (kinds.count("log"), kinds.count("knowledge"), kinds.count("entity")) == (7, 4, 1)
    assert all(r.result_type == "log" for r in C.merge_evidence(df, 12, "as_written").collect())


def test_retrieval_quality(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(1, 10), (1, 99), (2, 5)], "query_id int, doc_id int")
    rows = {r.query_id: r for r in S.retrieval_quality(ranked, rel, 2).collect()}
    assert (rows[1].precision, rows[1].recall, rows[1].f1, rows[2].recall) == (0.5, 0.5, 0.5, 0.0)


def _span_frame(spark, n, chain):
    """A text of n names; with ``chain`` all in one island of overlapping spans."""
    word = "cpu usage " if not chain else "host-node-"
    return spark.createDataFrame([(1, word * n), (2, None), (3, "")], "doc_id int, text string")


def test_islands_equal_one_fold(spark):
    """Islands against the rule applied to all spans of a text, both orders, for many small texts."""
    import random
    rng, words = random.Random(4), ["order-service", "host-api", "node-3", "error", "pod-error", "10.0.0.1", "service-b", "cpu", "LB", "Service_A1", "ERROR", "2024-01-01 00:00:00"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "-", "", "_"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    d = docs(spark, *texts)
    for rules, lower, append in ((E._TEXT_RULES, None, False), (E._QUESTION_RULES, 3, True)):
        spans = E.merged_spans(d, "doc_id", F.col("text"), rules, lower, append)
        got = {}
        for r in spans.orderBy("doc_id", "ord").collect():
            got.setdefault(r.doc_id, []).append((r.text, r.label, r.start, r.end, r.confidence))
        hits = d.select("doc_id", E._hits(F.col("text"), rules, lower).alias("h")).collect()
        for row in hits:
            at, all_ = {}, []
            for h in row.h:
                start = at.get(h.rule, 0) + h.gap
                if h.text is not None:
                    at[h.rule] = start + len(h.text)
                    all_.append((h.text, h.label, start, start + len(h.text), h.confidence))
            order = sorted(range(len(all_)), key=lambda i: (all_[i][2], all_[i][3], i) if append else (all_[i][2], i))
            kept = []
            for s in (all_[i] for i in order):
                k = next((i for i, o in enumerate(kept) if s[2] < o[3] and s[3] > o[2]), None)
                if k is None:
                    kept.append(s)
                elif s[4] > kept[k][4]:
                    kept[k:k + 1] = [] if append else [s]
                    kept += [s] if append else []
            assert got.get(row.doc_id, []) == kept


def test_spans_of_a_long_text_cost_in_proportion(spark):
    import time
    seconds = []
    for n in (1000, 10_000, 20_000):
        d = _span_frame(spark, n, False)
        start = time.time()
        assert E.extract_entities(d).count() == n
        seconds.append(time.time() - start)
    assert seconds[2] < 6 * max(seconds[1], 1.0)
