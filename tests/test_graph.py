import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators import graph as G
from opsloom.sources import seeds


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


def plain_reach(edges, start, depth):
    out, paths = set(), [(start, frozenset())]
    for d in range(1, depth + 1):
        nxt = []
        for node, used in paths:
            for i, (a, b) in enumerate(edges):
                if i not in used and node in (a, b):
                    other = b if node == a else a
                    nxt.append((other, used | {i}))
                    if other != start:
                        out.add((other, d))
        paths = nxt
    return out


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_trails_equal_plain_walk(spark, depth):
    rnd = random.Random(depth)
    edges = sorted({tuple(rnd.sample("abcdef", 2)) for _ in range(8)})
    df = spark.createDataFrame([(a, b, "R") for a, b in edges], "src string, dst string, type string")
    rows = G.reachable(df, starts(spark, "a", "b"), depth).collect()
    for s in "ab":
        assert {(r.name, r.distance) for r in rows if r.start == s} == plain_reach(edges, s, depth)


def test_three_steps_shuffle_no_pairs(spark):
    edges = [("hub", f"n{i}") for i in range(12)] + [("n0", "n0"), ("n1", "n2"), ("n2", "n1")]
    df = spark.createDataFrame([(a, b, "R") for a, b in edges] + [(None, "n3", "R"), ("n4", None, "R")], "src string, dst string, type string")
    out = G.reachable(df, starts(spark, "hub", "n0", "n1", "n1", "n5", "gone"), 3)
    assert not re.search(r"hashpartitioning\(start#\d+L?, (node|name)#", out._jdf.queryExecution().executedPlan().toString())
    rows = out.collect()
    assert len(rows) == len(set(rows))
    for s in ("hub", "n0", "n1", "n5", "gone"):
        assert {(r.name, r.distance) for r in rows if r.start == s} == plain_reach(edges, s, 3)


@pytest.mark.parametrize("seed", range(6))
def test_walks_by_counts_equal_plain_trails(monkeypatch, seed):
    """Several edges between two nodes, loops, both ways or one way, in small steps or at once."""
    rnd = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(G, "NODES_AT_ONCE", 3)
    monkeypatch.setattr(G, "SHARED_BY", rnd.choice([0, 2, 99]))
    edges = [(rnd.randrange(7), rnd.randrange(7)) for _ in range(rnd.choice([6, 12, 25]))]
    arcs = [(a, b, e) for e, (a, b) in enumerate(edges)] + [(b, a, e) for e, (a, b) in enumerate(edges) if a != b and seed < 4]
    walks = G._Walks(G._Arcs(*[np.array(x, np.int64) * 10 for x in zip(*arcs)]))
    for start in walks.arcs.names.tolist():
        trails, want = [(start // 10, ())], set()
        for d in (1, 2, 3):
            trails = [(b, (*used, e)) for node, used in trails for a, b, e in arcs if a == node and e not in used]
            want |= {(b * 10, d) for b, _ in trails if b * 10 != start}
        got = [(int(n), d) for d, found in walks.of(int(np.searchsorted(walks.arcs.names, start))) for n in walks.arcs.names[found]]
        assert len(got) == len(set(got)) and set(got) == want
    assert not walks.total.any() and not walks.spare.any()


def test_trails_of_a_start_are_not_rows(spark):
    """300 leaves of two hubs: 90,000 trails of a hub end at leaves; only what is distinct comes out of a task."""
    edges = [(f"n{i}", f"hub{j}") for i in range(300) for j in (0, 1)]
    df = spark.createDataFrame([(a, b, "R") for a, b in edges], "src string, dst string, type string")
    out = G.reachable(df, starts(spark, "hub0", "n7"), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "HashAggregate" not in plan
    rows = {(r.start, r.distance, r.name) for r in out.collect()}
    leaves, hubs = {f"n{i}" for i in range(300)}, {"hub0", "hub1"}
    want = {("hub0", d, n) for d, ns in ((1, leaves), (2, {"hub1"}), (3, leaves)) for n in ns}
    assert rows == want | {("n7", d, n) for d, ns in ((1, hubs), (2, leaves - {"n7"}), (3, hubs)) for n in ns}


def test_seed_topology(spark):
    edges = seeds.topology_edges(spark)
    near = G.nearest_services(edges, starts(spark, "service-a"), "out", 2, ["ROUTES_TO", "CONNECTS_TO"]).collect()
    assert {(r.name, r.distance) for r in near} == {("service-b", 1), ("service-c", 1)}
    more = G.reachable(edges, starts(spark, "service-a"), 2, "out", ["ROUTES_TO", "CALLS", "CONNECTS_TO"]).filter("distance = 2")
    assert {r.name for r in more.collect()} == {"service-d1", "service-d2", "service-d3", "service-f"}
    pairs = spark.createDataFrame([("service-a", "mysql-primary"), ("mysql-primary", "service-a")], "source string, target string")
    paths = G.shortest_paths(edges, pairs, directed=True, types=["ROUTES_TO", "CALLS", "CONNECTS_TO"]).collect()
    assert [(p.source, p.length, p.nodes) for p in paths] == [
        ("service-a", 3, ["service-a", "service-b", "service-d1", "mysql-primary"])]
    topo = G.service_topology(seeds.topology_nodes(spark), edges, spark.createDataFrame([("service-c",)], "service string"))
    assert {(r.from_service, r.to_service) for r in topo.collect()} == {("service-a", "service-c"), ("service-c", "service-f")}


def test_shared_groups_lose_nothing(spark):
    rnd = random.Random(2)
    rows = [("hot", m) for m in range(30)] + [(f"g{i}", rnd.randint(0, 29)) for i in range(12) for _ in range(4)]
    df = spark.createDataFrame([(g, str(m)) for g, m in rows], "g string, m string")
    want = {}
    for g in {g for g, _ in rows}:
        ms = {m for gg, m in rows if gg == g}
        for a in ms:
            for b in ms - {a}:
                want[str(a), str(b)] = want.get((str(a), str(b)), 0) + 1
    shared = G.shared_groups(df, "g", "m")
    assert shared.filter("size = 30").count() == 30 and G.shared_total(shared).first()[0] == sum(want.values())
    asked = spark.createDataFrame(list(want), "left string, right string")
    assert {(r.left, r.right): r.evidence for r in G.shared_evidence(shared, asked).collect()} == want


def test_upserts(spark):
    schema = "name string, type string, props map<string,string>, confidence double, created_at int, updated_at int, seq int"
    old = spark.createDataFrame([("a", "S", {"x": "1", "y": "1"}, 0.5, 1, 1, 1)], schema)
    new = spark.createDataFrame([("a", "S", {"x": "2"}, 0.9, 5, 5, 2), ("b", "S", {}, 0.1, 5, 5, 3)], schema)
    rows = {r.name: r for r in G.upsert_nodes(old, new).collect()}
    assert (rows["a"].props, rows["a"].created_at, rows["a"].updated_at, rows["a"].confidence) == ({"x": "2", "y": "1"}, 1, 5, 0.9)
    assert rows["b"].props == {}
    es = "src string, dst string, type string, weight int, created_at int, seq int"
    nodes = spark.createDataFrame([("a",), ("b",)], "name string")
    e1 = spark.createDataFrame([("a", "b", "USES", 1, 1, 1)], es)
    e2 = spark.createDataFrame([("a", "b", "CALLS", 2, 2, 2), ("a", "zz", "CALLS", 2, 2, 3)], es)
    assert G.upsert_edges(e1, e2, nodes).count() == 2
    assert [(r.type, r.created_at) for r in G.upsert_edges(e1, e2, nodes, "pair").collect()] == [("CALLS", 1)]


def test_entities_by_word_equals_substring_search(spark):
    names = [f"service-{i}" for i in range(30)] + ["mysql-primary", "cache", "ab"]
    ents = spark.createDataFrame([(n, "Service") for n in names], "name string, type string")
    q = spark.createDataFrame([(1, "is mysql ok"), (2, "service ice-2 zzz"), (3, "ab")], "query_id int, query string")
    rows = G.entities_by_word(ents, q, with_type=False).orderBy("query_id", "rank").collect()
    got = {k: [r.name for r in rows if r.query_id == k] for k in (1, 2, 3)}
    assert got[1] == ["mysql-primary"] and got[3] == []
    first = sorted(n for n in names if "service" in n)[:5]
    assert got[2] == first + [n for n in sorted(n for n in names if "ice-2" in n)[:5] if n not in first]


def test_seed_entities(spark):
    rel = seeds.seed_relations(spark)
    ents = seeds.seed_entities(spark)
    assert rel.join(ents, (F.col("dst") == ents.name) & (F.col("dst_type") == ents.type)).count() == rel.count() == 10


def test_pairs_of_one_target_share_a_search(spark, monkeypatch):
    rnd, kinds = random.Random(9), ["CALLS", "ROUTES_TO"]
    rows = [(f"n{i:02}", f"hub{i % 2}", rnd.choice(kinds)) for i in range(40)] + [(f"n{i:02}", f"n{rnd.randrange(40):02}", k) for i in range(8) for k in kinds]
    edges = spark.createDataFrame(rows, "src string, dst string, type string")
    asked = [(f"n{i:02}", "hub0") for i in range(40)] + [("n01", "hub1")]
    sizes = []

    def counted(df, cut=G.cut_lineage):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", counted)
    for turn in (False, True):
        pairs = spark.createDataFrame([p[::-1] if turn else p for p in asked], "source string, target string")
        got = {(r.source, r.target): (r.nodes, r.relations) for r in G.shortest_paths(edges, pairs).collect()}
        ways = {(s, d, t) for s, d, t in rows} | {(d, s, t) for s, d, t in rows}
        for s, t in ((p[::-1] if turn else p) for p in asked):
            front, want = [([s], [])], None
            for _ in range(5):
                front = [(n + [b], r + [k]) for n, r in front for a, b, k in ways if a == n[-1] and b not in n]
                front = list({n[-1]: (n, r) for n, r in sorted(front, reverse=True)}.values())
                done = [p for p in front if p[0][-1] == t]
                if done:
                    want = min(done)
                    break
            assert got.get((s, t)) == want
    assert max(sizes) <= 2 * 42  # anchors times nodes; pairs times nodes are over 1000


def test_words_that_all_names_hold_are_no_hot_key(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS_PER_TASK", 10)
    names = spark.createDataFrame([(f"part-{i:03d}", "Component") for i in range(200)], "name string, type string")
    asked = spark.createDataFrame([(i, "part none-at-all" if i % 2 else "part-19") for i in range(200)], "query_id int, query string")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = G.entities_by_word(names, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {}
        for r in found.collect():
            rows.setdefault(r.query_id, []).append((r.rank, r.name))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert not re.search(r"SortMergeJoin \[(gram|word)", plan)
    assert sorted(rows[1]) == [(i + 1, f"part-{i:03d}") for i in range(5)]
    assert sorted(rows[2]) == [(i + 1, f"part-{190 + i}") for i in range(5)] and len(rows) == 200
