from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opsloom.operators import metrics as M
from opsloom.operators import series as T
from opsloom.operators import stats as ST

T0 = datetime(2024, 1, 1)


def samples(spark, values, step=60):
    return spark.createDataFrame([("s", T0 + timedelta(seconds=i * step), i, v) for i, v in enumerate(values)],
                                 "k string, ts timestamp, n int, v bigint")


def test_increase_with_reset(spark):
    out = M.rate(samples(spark, [10, 25, 5, 15]), ["k"], ["ts", "n"], "v", 300).orderBy("n").collect()
    assert (out[-1].increase, out[-1].resets, out[-1].rate) == (30, 1, 0.1)


def test_carry_over_empty_buckets(spark):
    df = samples(spark, [1, 2, 3, 4], step=7200)
    got = [r.p for r in T.previous(df, ["k"], T.time_bucket("ts", 3600), ["ts"], "v", "p").orderBy("n").collect()]
    assert got == [None, 1, 2, 3]
    run = [r.r for r in T.running_sum(df, ["k"], T.time_bucket("ts", 3600), [F.col("ts")], F.col("v"), "r").orderBy("n").collect()]
    assert run == [1, 3, 6, 10]


def test_quantiles_hand_case(spark):
    df = spark.range(1).select(F.array(*[F.lit(x) for x in (0.1, 0.5, 1.0, float("inf"))]).alias("b"),
                               F.array(*[F.lit(x) for x in (50, 90, 99, 100)]).alias("n"))
    row = df.select(M.quantile(F.col("b"), F.col("n"), 0.95).alias("q95"), M.quantile(F.col("b"), F.col("n"), 0.5).alias("q50")).first()
    assert abs(row.q95 - 0.7777778) < 1e-6 and row.q50 == 0.1


def test_alert_spans_and_hold(spark):
    fires = [False, True, True, False, True, True, True]
    df = spark.createDataFrame([("r", T0 + timedelta(minutes=i), i, f) for i, f in enumerate(fires)],
                               "rule string, ts timestamp, n int, firing boolean")
    spans = M.alert_spans(df, ["rule"], ["ts"]).orderBy("span").collect()
    assert [s.samples for s in spans] == [2, 3]
    held = [r.n for r in M.held(df, ["rule"], 120).filter("alert").orderBy("n").collect()]
    assert held == [6]
    one = df.limit(1).selectExpr("rule", "ts", "n", "true as firing")
    assert not M.held(one, ["rule"], 120).first().alert
    later = one.unionByName(one.selectExpr("rule", "ts + interval 5 minutes as ts", "n + 1 as n", "firing"))
    assert [r.alert for r in M.held(later, ["rule"], 120).orderBy("ts").collect()] == [False, True]


def test_message_order_in_long_session(spark):
    df = spark.range(10000).selectExpr("1 as session_id", "id * 3 as turn")
    assert ST.message_order(df).filter("position <> turn / 3 + 1").count() == 0


def test_task_progress_hand_case(spark):
    rows = [(1, "ner_extraction", "completed", 1.0), (1, "hybrid_search", "completed", 1.0), (1, "topology_query", "in_progress", 0.5)]
    df = spark.createDataFrame([(*r, i, T0) for i, r in enumerate(rows)],
                               "task_id int, stage string, status string, progress double, ts int, created_at timestamp")
    row = ST.task_progress(df, F.lit(T0 + timedelta(seconds=50))).first()
    assert abs(row.progress - 0.5) < 1e-9 and abs(row.remaining_seconds - 50) < 1e-6


def test_exact_quantile_narrows_to_the_rank(spark):
    """Groups of distinct, repeated, skewed, equal and single values against the sorted list, whole and in small rounds."""
    import numpy as np

    from opsloom.operators.quantiles import exact_quantile
    rng = np.random.default_rng(3)
    groups = {"distinct": rng.normal(size=3000), "skewed": np.exp(rng.normal(size=2000) * 8), "repeated": rng.integers(0, 9, 1500).astype(float),
              "equal": np.full(50, 7.0), "one": np.array([3.5]), "two": np.array([-1.0, 2.0]), None: rng.normal(size=11)}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("equal", None), ("void", None), ("one", float("nan"))], "g string, v double")
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    for q, cells, most in ((0.95, 1024, 50_000), (0.95, 8, 5), (0.5, 16, 1), (0.0, 4, 3), (1.0, 4, 3)):
        got = {r["g"]: r["quantile"] for r in exact_quantile(counted, ["g"], q, cells, most).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert abs(got[g] - np.quantile(xs, q)) <= 1e-12 * max(1, abs(got[g]))


def test_windows_by_passing_rows_equal_frames(spark):
    rows = [(i % 2, float(i * 37 % 101) if i % 9 else None, i % 3, (i * i * 7919 % 4_000) // 4 * 4) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, v double, n int, s long").selectExpr("*", "timestamp_seconds(s) as ts")
    want = T.over_last(df, ["k"], "ts", 300, total=F.sum("n"), top=F.max("v"))
    got = T.max_over_last(T.sums_over_last(df, ["k"], "ts", 300, total=F.col("n")), ["k"], "ts", 300, "v", "top")
    key = lambda r: repr((r.k, r.s, r.v, r.n, r.total, r.top))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    # each row comes three times at most, and no frame slides
    plan = got._jdf.queryExecution().toString()
    assert "-300000000" not in plan
