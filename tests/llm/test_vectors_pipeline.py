from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from opsloom.llm import maxscore, nearcopies, neighbours, simhash, vectors
from opsloom.llm.queries import QUERIES
from tests.llm.rows import AWKWARD, docs
from tools.check_queries import rows_of

VECTORS = "vec_id long, embedding array<float>, label int, v string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 0, "x", 9) for i, e in rows], VECTORS)


def random_rows(n, dim, seed, zeros=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if zeros:
        x[rng.random(x.shape) < 0.7] = 0
    x[n // 2:n // 2 + n // 3] = x[0]  # a third are copies of one
    return list(enumerate(x.tolist()))


BAD = [(1000, None), (1001, [1.0, float("nan"), 0]), (1002, [float("inf"), 0, 0]), (1003, [None, 1.0]), (1004, [0.0, 0.0]), (1005, []), (None, [1.0, 2.0]), (1006, [3.0])]


def brute_top(rows, every, k, score):
    out = {}
    for q, a in rows:
        if q % every == 0:
            found = sorted(((-score(a, b), i) for i, b in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


@pytest.mark.parametrize("zeros", [False, True])
def test_maxscore_equals_brute_force(spark, monkeypatch, zeros):
    monkeypatch.setattr(vectors, "VECTORS", 130)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    rows = random_rows(600, 12, 5, zeros)
    whole = lambda a: [int(np.floor(256 * np.float64(np.float32(x)))) for x in a]
    usable = [(i, whole(e) + [0] * (12 - len(e))) for i, e in rows + [(1004, [0.0, 0.0]), (1005, []), (1006, [3.0])]]
    want = brute_top(usable, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b)))
    assert ranked(maxscore.top_products(frame(spark, rows + BAD))) == want


def test_op8_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    df = entry.queries()["op8_maxscore"](spark, small)
    cur = con.execute(entry.oracle_sql()["op8_maxscore"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_op4_equals_sql(spark):
    con, d = duckdb.connect(), "/root/testdata/sf0.1"
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    df = entry.queries()["op4_license_scan"](spark, d)
    cur = con.execute(entry.oracle_sql()["op4_license_scan"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_op1_recall(spark):
    d = "/root/testdata/sf0.1"
    got = ranked(entry.queries()["op1_learned_partitions"](spark, d))
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows])
    hit = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit += len(best & {i for i, _ in found})
        assert len(found) == 20 and all(abs(v - s[ids == i][0]) < 1e-12 for i, v in found)
        assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)
    assert hit / (20 * len(got)) >= 0.9 and len(got) == (ids % 20 == 0).sum()


@pytest.mark.parametrize("spread", [0.0, 0.6, 1.0])
def test_recall_at_any_lengths(spread):
    """Queries that were not learned from, against all rows, by products of the original vectors; few rows are read."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 12000)] + 0.6 * rng.normal(size=(12000, 32))
    x *= np.exp(spread * rng.normal(size=(12000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    router = neighbours.learn(x[300:8300])
    router.edges = router.edges * np.abs(x[300:8300]).max()
    home, probes, s = router.home(x), router.probes(x[:300]), x[:300] @ x.T
    s[np.arange(300), np.arange(300)] = -np.inf
    truth = home[np.argpartition(-s, 20, axis=1)[:, :20]]
    assert np.take_along_axis(probes, truth, axis=1).mean() >= 0.9
    assert (probes @ np.bincount(home, minlength=router.parts)).mean() < 0.2 * len(x)


def test_neighbours_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS", 100)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    rows = random_rows(500, 6, 8)
    got = ranked(neighbours.nearest(frame(spark, rows + BAD)))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    assert not {i for f in got.values() for i, _ in f} & {i for i, e in BAD if i != 1006}
    copy = 260  # one of the copies: its neighbours are the copies with the least ids
    assert [i for i, _ in got[copy]][:3] == [0, 250, 251]
    assert ranked(neighbours.nearest(frame(spark, []))) == {} and ranked(maxscore.top_products(frame(spark, []))) == {}
    assert len(ranked(neighbours.nearest(frame(spark, [(0, [1, 0]), (20, [1, 1]), (3, [2, 0])])))[0]) == 2


def test_balanced_parts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    graph = neighbours.best_rows(x, x, 6, True)
    part = neighbours.balanced_parts(x, graph, 7)
    assert np.bincount(part, minlength=7).max() <= np.ceil(1.1 * 900 / 7) + 1
    halves = rng.integers(0, 7, 900)
    assert (part[graph] == part[:, None]).mean() > 2 * (halves[graph] == halves[:, None]).mean()


def test_stages_hand_on_documents(spark, tmp_path):
    """Each stage against a plain version of its decision, on the small table."""
    text = lambda n: " ".join("".join(np.random.default_rng(n * 100 + k).choice(list("abcdefgh"), 6)) for k in range(60))
    rows = [(i, text(i), "en", "ab"[i % 2]) for i in range(40)] + [(50, text(3), "en", "a"), (51, "", "en", "a"), (52, None, "en", None), (53, "...", None, "b")]
    d = docs(spark, rows)
    columns = d.columns
    out = d
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, "")
        assert out.columns == columns, name
        ids = Counter(r["doc_id"] for r in out.collect())
        assert not {51, 52, 53} & set(ids)
        if name == "near_duplicates":
            assert 50 not in ids and set(ids) <= set(range(40)) and len(ids) > 30
            kept = set(ids)
        if name == "repeated_passages":
            assert set(ids) <= kept
    packed = corpus_pipeline.STAGES[4][1](spark, out, "").toPandas()
    assert set(packed["doc_id"]) == set(ids) and packed["row_id"].nunique() == sum(ids.values())


def test_stages_of_awkward_and_empty_tables(spark):
    for rows in (AWKWARD, []):
        out = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "")
        assert (out.count() > 0) == bool(rows)


#: Names that the stages use inside.
INSIDE = ("id digest node n keys key row doc tag cuts _doc _tag _cuts _cuts_ at own other set a b x y i j h c p q root who times size source_size target ratio "
          "copies chance u load g groups _times _copy _digest _lang_pred _lang_score _lang_spans part ids width before rows words text_ _row").split()


def test_stages_keep_any_column(spark):
    """Every extra column, whatever its name, comes back as it was."""
    from pyspark.sql import functions as F

    words = [" ".join("".join(np.random.default_rng(100 * i + k).choice(list("abcdefgh"), 6)) for k in range(50)) for i in range(12)]
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(words)] + [(20, words[3], "en", "a"), (21, words[4] + " " + words[5], "en", "b")]
    d = docs(spark, rows).drop("n", "size").withColumns({c: F.concat(F.lit(c + "-"), "doc_id") for c in INSIDE if c != "id"}).withColumn("id", F.lit("mine"))
    out = d
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, "")
        assert out.columns == d.columns, name
        got = out.collect()
        assert got and all(r["id"] == "mine" and all(r[c] == f"{c}-{r['doc_id']}" for c in INSIDE if c != "id") for r in got), name


def test_language_stage_keeps_clean_texts(spark):
    """Without labels all texts with letters stay; with labels one in three languages does."""
    texts = ["the cat sat on the mat and looked at the dog in the house", "der Hund lief über die Straße und blieb dann vor dem Haus stehen",
             "le chat est sur la table et il regarde dans la maison de la rue"]
    bare = [(i, texts[i % 3] + f" {i}", None, "a") for i in range(60)] + [(100, "12 34", None, "a"), (101, None, None, "a")]
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs(spark, bare), "").collect()} == set(range(60))
    known = [(i, texts[i % 3], ("en", "de", "fr")[i % 3], "a") for i in range(60)] + [(70, " ".join(texts), "en", "a"), (71, "...", "en", "a")]
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs(spark, known), "").collect()} == set(range(60)) | {70}


def test_pipeline_query(spark, small):
    rows = entry.queries()["pipeline"](spark, small).collect()
    assert rows and corpus_pipeline.ORACLE_SQL is None
    assert len(corpus_pipeline.STAGES) == 5 and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}


def five_word_sets(texts):
    words = [t.lower().split() for t in texts]
    return [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]


def test_near_copies_go_by_five_word_similarity(spark):
    """Edited copies at similarities on both sides of 0.8, chains among them, against all pairs."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(30):
        words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6):
            for i in rng.choice(200, edits, replace=False):
                words[i] = f"x{rng.integers(10**9)}"
            texts.append(" ".join(words))
    sets, root = five_word_sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root)) and len(set(root)) < 150


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Where no band of least hashes agrees, copies whose fingerprints differ in three bits at most still meet."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(20):
        words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
        texts += [" ".join(words), " ".join([*words[:-1], f"x{len(texts)}"]), " ".join(words[3:])]
    prints = [simhash.majority(nearcopies.shingles(t)) for t in texts]
    sets, root = five_word_sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert len(set(root)) < 40
    frame_ = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    assert len(corpus_pipeline.near_duplicates(spark, frame_, "").collect()) == 20
    monkeypatch.setattr(nearcopies, "band_keys", lambda own: np.arange(nearcopies.BANDS) + int(own.sum() >> np.uint64(8)))
    kept = corpus_pipeline.near_duplicates(spark, frame_, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))
