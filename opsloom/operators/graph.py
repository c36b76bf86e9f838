"""Property-graph work over node and edge tables.

Nodes: name, type, props map. Edges: src, dst, type (and an edge id that the
functions make from those three).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.search import BROADCAST_ROWS, best_per, has_at_most
from opsloom.session import cut_lineage

#: Names or questions that one task of a word search holds at most.
ROWS_PER_TASK = 50_000
#: Arcs that go to all tasks at most, as numbers; (start, node) pairs two steps apart that one task walks, about.
ARCS_TO_ALL = 2_000_000
PAIRS_PER_TASK = 3_000_000
#: Nodes that a task looks at in one step; nodes two steps from others that it keeps; starts that make it keep them.
NODES_AT_ONCE, NODES_KEPT, SHARED_BY = 1_000_000, 8_000_000, 4


# ------------------------------------------------------------------ steps
def _arcs(edges: DataFrame, direction: str, types: list[str] | None) -> DataFrame:
    """(a, b, edge, etype): one row per way an edge can be walked."""
    e = edges.filter(F.col("type").isin(types)) if types else edges
    e = e.select("src", "dst", F.col("type").alias("etype"),
                 F.xxhash64("src", "dst", "type").alias("edge")).dropDuplicates(["src", "dst", "etype"])
    out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge", "etype")
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge", "etype")
    if direction == "out":
        return out
    if direction == "in":
        return back
    return out.unionByName(back.filter("a <> b"))


def _fewer_paths(paths: DataFrame, keys: list[str], used: int, left: int) -> DataFrame:
    """Enough paths per key to decide every continuation of ``left`` more edges.

    A continuation is blocked only by the edges it shares with a path. Keeping
    the smallest path, and for each of its edges the smallest path without that
    edge, and so on ``left`` levels deep, keeps at least one path open to every
    continuation that some dropped path allowed. The number kept per key is
    bounded by the depth, not by the size of the graph.
    """
    if used < 2 or left < 1:
        return paths.dropDuplicates([*keys, "edges"])
    todo = paths.withColumn("blocked", F.array().cast("array<bigint>"))
    kept = None
    for level in range(left + 1):
        first = todo.groupBy(*keys, "blocked").agg(F.min("edges").alias("edges"))
        kept = first if kept is None else kept.unionByName(first)
        if level == left:
            break
        more = first.select(*keys, "blocked", F.explode("edges").alias("x"))
        todo = (todo.join(more, [*keys, "blocked"]).filter(~F.array_contains("edges", F.col("x")))
                .withColumn("blocked", F.array_sort(F.array_append("blocked", F.col("x")))).drop("x"))
    return kept.drop("blocked").dropDuplicates([*keys, "edges"])


class _Arcs:
    """Arcs as arrays, by their first node: what the trails of a start are counted from."""

    def __init__(self, a: np.ndarray, b: np.ndarray, edge: np.ndarray):
        self.names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        tail, head, edge = ends[:len(a)], ends[len(a):], np.unique(edge, return_inverse=True)[1]
        order = np.lexsort((head, tail))
        self.n, self.tail, self.head, self.edge = len(self.names), tail[order], head[order].astype(np.int32), edge[order].astype(np.int32)
        self.at = np.searchsorted(self.tail, np.arange(self.n + 1)).astype(np.int64)
        self.tail = self.tail.astype(np.int32)
        self.of_edge = np.argsort(self.edge, kind="stable").astype(np.int32)  # arcs of an edge lie together
        self.edge_at = np.searchsorted(self.edge[self.of_edge], np.arange(int(self.edge.max(initial=-1)) + 2)).astype(np.int64)
        self.into = np.bincount(self.head, minlength=self.n)


class _Walks:
    """Nodes that trails of one to three arcs end at, by counts: all walks of a start less those that use an edge twice.

    What two arcs from a node reach is counted once and added for every start
    beside it, so the work of a start is its neighbours times the different
    nodes that these reach, and not the number of its trails.
    """

    def __init__(self, arcs: _Arcs):
        self.arcs, self.total, self.spare = arcs, np.zeros(arcs.n, np.int64), np.zeros(arcs.n, np.int64)
        self.known, self.held = {}, 0

    def beside(self, x: int) -> slice:
        return slice(self.arcs.at[x], self.arcs.at[x + 1])

    def two(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes two arcs of different edges from h, and the number of such trails."""
        if h in self.known:
            return self.known[h]
        g, own, parts = self.arcs, self.beside(h), []
        nexts = g.head[own].astype(np.int64)
        sizes = g.at[nexts + 1] - g.at[nexts]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()), NODES_AT_ONCE), side="left")
        for p, q in zip(cuts, [*cuts[1:], len(nexts)]):
            size = sizes[p:q]
            arc = np.repeat(g.at[nexts[p:q]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            arc = arc[g.edge[arc] != np.repeat(g.edge[own][p:q], size)]
            parts.append(self.counted(g.head[arc]))
        if len(parts) == 1:
            found = parts[0]
        else:
            for node, n in parts:
                self.spare[node] += n
            found = self.taken(self.spare, [node for node, _ in parts])
        if g.into[h] >= SHARED_BY and self.held + len(found[0]) <= NODES_KEPT:
            self.known[h], self.held = found, self.held + len(found[0])
        return found

    def counted(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, n = np.unique(node, return_counts=True)
        return node.astype(np.int32), n.astype(np.int32)

    def taken(self, total: np.ndarray, nodes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The different ones of ``nodes`` that have a count, and their counts, which are set back to 0."""
        seen, counts = [], []
        for node in nodes:
            more = node[total[node] > 0]
            counts.append(total[more])
            total[more] = 0
            seen.append(more)
        return np.concatenate([np.zeros(0, np.int32), *seen]), np.concatenate([np.zeros(0, np.int64), *counts])

    def of(self, s: int) -> Iterator[tuple[int, np.ndarray]]:
        """(distance, nodes), nodes of a distance once each."""
        g, own = self.arcs, self.beside(s)
        heads, edges = g.head[own], g.edge[own]
        one, count = self.counted(heads)
        yield 1, one[one != s]
        total, touched = self.spare, []
        for h, e in zip(heads.tolist(), edges.tolist()):
            arc = self.beside(h)
            node = g.head[arc][g.edge[arc] != e]
            node = node[np.diff(node, prepend=-1) > 0]  # in order, so equal ones are neighbours
            total[node] = 1
            touched.append(node)
        node = self.taken(total, touched)[0]
        yield 2, node[node != s]
        total, touched = self.total, []
        for h, e in zip(heads.tolist(), edges.tolist()):
            node, n = self.two(h)
            total[node] += n
            touched.append(node)
            for arc in g.of_edge[g.edge_at[e]:g.edge_at[e + 1]].tolist():
                x, y = int(g.tail[arc]), int(g.head[arc])
                if x == h:  # the second arc is the edge again, the third is not
                    after = self.beside(y)
                    node, n = (one, count) if y == s else self.counted(g.head[after])
                    total[node] -= n
                    np.add.at(total, g.head[after][g.edge[after] == e], 1)
                before = self.beside(h)  # the third arc is the edge again, the second is not
                total[y] -= np.count_nonzero((g.head[before] == x) & (g.edge[before] != e))
        node = self.taken(total, touched)[0]
        yield 3, node[node != s]


def _three_steps(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, distance) of trails of one to three arcs: starts are dealt, and the arcs come to all tasks as arrays.

    Nodes are numbered. What is distinct for a start is settled in its task
    without shuffle; neither trails nor pairs are stored.
    """
    spark = arcs.sparkSession
    names = cut_lineage(arcs.select(F.col("a").alias("name")).unionByName(arcs.select(F.col("b").alias("name"))).distinct()
                        .where("name is not null").withColumn("n", F.monotonically_increasing_id()))
    a, b = names.select(F.col("name").alias("a"), F.col("n").alias("x")), names.select(F.col("name").alias("b"), F.col("n").alias("y"))
    steps = arcs.join(a, "a").join(b, "b").select("x", "y", "edge").toArrow()
    known = _Arcs(*[steps.column(c).to_numpy() for c in ("x", "y", "edge")])
    degree = np.diff(known.at)
    near = np.bincount(known.tail, weights=degree[known.head], minlength=known.n)
    begun = cut_lineage(starts.select(F.col("start").alias("name")).distinct().join(names, "name").select(F.col("n").alias("start"), F.col("name").alias("told")))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(near.sum() / PAIRS_PER_TASK))
    sent, schema = spark.sparkContext.broadcast(known), pa.schema([("told", pa.string()), ("distance", pa.int32()), ("nodes", pa.list_(pa.int64()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = None
        for batch in batches:
            walks = walks or _Walks(sent.value)
            g, rows, size = walks.arcs, [], 0
            for start, told in zip(batch.column("start").to_pylist(), batch.column("told").to_pylist()):
                for distance, found in walks.of(int(np.searchsorted(g.names, start))):
                    for i in range(0, len(found), NODES_AT_ONCE):
                        rows.append((told, distance, g.names[found[i:i + NODES_AT_ONCE]]))
                        size += len(rows[-1][2])
                        if size >= NODES_AT_ONCE:
                            yield batch_of(rows)
                            rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        told, distance, found = zip(*rows)
        nodes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([pa.array(told, pa.string()), pa.array(distance, pa.int32()), nodes], schema=schema)

    met = begun.repartition(tasks, "start").mapInArrow(walk, "told string, distance int, nodes array<long>")
    found = met.select(F.col("told").alias("start"), "distance", F.explode("nodes").alias("n"))
    return found.join(F.broadcast(names), "n").select("start", "name", "distance")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int = 2, direction: str = "both",
              types: list[str] | None = None, chain: bool = False) -> DataFrame:
    """Distinct (start, name, distance) within 1..max_depth edges, no edge used twice on a path.

    A node shows up once for every distance at which some path ends there; the
    start itself is left out. ``chain=True`` adds the edge types walked and
    makes them part of what is distinct. ``starts`` has the column ``start``.
    """
    if not 1 <= max_depth <= 5:
        raise ValueError("max_depth must be 1 to 5")
    arcs = _arcs(edges, direction, types)
    if max_depth == 3 and not chain:
        arcs = cut_lineage(arcs)
        if has_at_most(arcs, ARCS_TO_ALL):
            return _three_steps(arcs, starts)
    keys = ["start", "node"] + (["chain"] if chain else [])
    paths = starts.select("start", F.col("start").alias("node"), F.array().cast("array<bigint>").alias("edges"),
                          F.array().cast("array<string>").alias("chain"))
    found = None
    for depth in range(1, max_depth + 1):
        step = paths.join(arcs, F.col("node") == F.col("a")).filter(~F.array_contains("edges", F.col("edge")))
        last = depth == max_depth
        longer = step.select(
            "start", F.col("b").alias("node"),
            *([] if last else [F.array_sort(F.array_append("edges", F.col("edge"))).alias("edges")]),
            (F.array_append("chain", F.col("etype")) if chain else F.col("chain")).alias("chain"))
        if last:
            level = longer.select(*keys).distinct()
        else:
            paths = cut_lineage(_fewer_paths(longer.select(*keys, "edges"), keys, depth, max_depth - depth)
                                .withColumn("chain", F.col("chain") if chain else F.array().cast("array<string>")))
            level = paths.select(*keys).distinct()
        level = level.filter("node <> start").withColumn("distance", F.lit(depth))
        found = level if found is None else found.unionByName(level)
    return found.withColumnRenamed("node", "name")


def nearest_services(edges: DataFrame, starts: DataFrame, direction: str, max_depth: int = 2,
                     types: list[str] | None = None, k: int = 20) -> DataFrame:
    """Upstream (``in``) or downstream (``out``) services with their relation chain, nearest first."""
    rows = reachable(edges, starts, max_depth, direction, types, chain=True)
    return best_per(rows, ["start"], [F.asc("distance"), F.asc("name"), F.asc("chain")], k)


def shortest_paths(edges: DataFrame, pairs: DataFrame, directed: bool = False, types: list[str] | None = None,
                   max_depth: int = 5) -> DataFrame:
    """(source, target, length, nodes, relations) of a shortest path for each pair, if one exists in max_depth edges.

    Breadth first from the side of the pairs with fewer different nodes: all
    pairs of an anchor share one search, so rows are anchors times nodes and
    not pairs times nodes. Per anchor and node only the smallest path of its
    level stays; smallest paths consist of smallest parts from either end. An
    anchor leaves the search as soon as all its pairs have their path.
    """
    asked = pairs.select("source", "target").distinct()
    n = asked.agg(F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets")).first()
    backward = n["targets"] < n["sources"]
    anchor, end = ("target", "source") if backward else ("source", "target")
    steps = _arcs(edges, "out" if directed else "both", types).groupBy("a", "b").agg(F.min("etype").alias("etype"))
    if backward:
        steps = steps.select(F.col("b").alias("a"), F.col("a").alias("b"), "etype")
    put = F.array_prepend if backward else F.array_append
    open_ = cut_lineage(asked.select(F.col(anchor).alias("anchor"), F.col(end).alias("node"), "source", "target"))
    front = open_.select("anchor").distinct().select(
        "anchor", F.col("anchor").alias("node"), F.array("anchor").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    seen = front.select("anchor", "node")
    found = None
    for depth in range(1, max_depth + 1):
        step = front.join(steps, F.col("node") == F.col("a")).select(
            "anchor", F.col("b").alias("node"), put("nodes", F.col("b")).alias("nodes"), put("relations", F.col("etype")).alias("relations"))
        level = cut_lineage(step.join(seen, ["anchor", "node"], "left_anti").groupBy("anchor", "node")
                            .agg(F.min(F.struct("nodes", "relations")).alias("p")).select("anchor", "node", "p.*"))
        hit = cut_lineage(open_.join(level, ["anchor", "node"]).select("source", "target", F.lit(depth).alias("length"), "nodes", "relations"))
        found = hit if found is None else found.unionByName(hit)
        if depth == max_depth:
            break
        open_ = cut_lineage(open_.join(hit.select("source", "target"), ["source", "target"], "left_anti"))
        front = level.join(open_.select("anchor").distinct(), "anchor", "left_semi")
        seen = seen.unionByName(level.select("anchor", "node"))
    return found


# ------------------------------------------------------------------ neighbourhood and statistics
def service_topology(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct direct relations of the asked services (column ``service``) in both directions.

    Only edges between services count; services without any keep one row with nulls.
    """
    services = nodes.filter("type = 'Service'").select("name")
    named = asked.select(F.col("service").alias("name")).distinct().join(services, "name")
    between = (edges.join(services.withColumnRenamed("name", "src"), "src")
               .join(services.withColumnRenamed("name", "dst"), "dst").select("src", "dst", "type"))
    ends = between.select(F.col("src").alias("name"), "src", "dst", "type").unionByName(
        between.select(F.col("dst").alias("name"), "src", "dst", "type"))
    return named.join(ends, "name", "left").select(
        F.col("name").alias("service"), F.col("src").alias("from_service"), F.col("dst").alias("to_service"),
        F.col("type").alias("relation")).distinct()


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): totals, nodes by type, edges by type."""
    n = nodes.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n"))
    e = edges.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("n")).select(F.lit("nodes").alias("kind"), F.lit("").alias("label"), "n").unionByName(
        e.agg(F.sum("n").alias("n")).select(F.lit("edges").alias("kind"), F.lit("").alias("label"), "n"))
    return total.unionByName(n.select(F.lit("node type").alias("kind"), "label", "n")).unionByName(
        e.select(F.lit("edge type").alias("kind"), "label", "n"))


def missing_edges(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """Expected direct edges with a flag whether they are there."""
    there = edges.select("src", "dst", "type").distinct().withColumn("present", F.lit(True))
    return expected.join(there, ["src", "dst", "type"], "left").na.fill(False, ["present"])


def affected_services(relations: DataFrame, source: str = "from_service", target: str = "to_service") -> DataFrame:
    """Both ends of the relations, each service once."""
    return relations.select(F.col(source).alias("service")).union(relations.select(F.col(target))).distinct()


def many_dependencies(edges: DataFrame, types: list[str]) -> DataFrame:
    return (edges.filter(F.col("type").isin(types)).select("src", "dst").distinct()
            .groupBy("src").agg(F.count("*").alias("dependencies")).filter("dependencies > 1"))


# ------------------------------------------------------------------ inference over shared groups
def shared_groups(members: DataFrame, group: str, member: str) -> DataFrame:
    """Distinct (group, member) with the group's size, for groups of two members or more.

    One row per member, whatever the size of a group, and no pairs. Two members
    are related by each group that holds both: ``shared_evidence`` counts that
    for asked pairs, ``shared_total`` for all.
    """
    one = members.select(F.col(group).alias("group"), F.col(member).alias("member")).distinct()
    size = one.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1")
    return one.join(size, "group")


def shared_evidence(shared: DataFrame, asked: DataFrame) -> DataFrame:
    """Groups that asked pairs (left, right) share."""
    both = shared.select("group", "member")
    return (asked.join(both.withColumnRenamed("member", "left"), "left").join(both.withColumnRenamed("member", "right"), ["group", "right"])
            .groupBy("left", "right").agg(F.count("*").alias("evidence")))


def shared_total(shared: DataFrame) -> DataFrame:
    """Relations in all: one for each group and ordered pair of its members."""
    return shared.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("n"))


def potential_dependencies(affects: DataFrame) -> DataFrame:
    """Components hit by one issue may depend on each other: confidence 0.5."""
    return shared_groups(affects, "issue", "component").withColumn("confidence", F.lit(0.5))


def collocated(deployed: DataFrame) -> DataFrame:
    """Services on one host: confidence 0.8."""
    return shared_groups(deployed, "host", "service").withColumn("confidence", F.lit(0.8))


def issue_patterns(affects: DataFrame) -> DataFrame:
    """Component and issue type seen more than once, confidence 0.7."""
    return (affects.groupBy("component", "issue_type").agg(F.count("*").alias("frequency"))
            .filter("frequency > 1").withColumn("confidence", F.lit(0.7)))


# ------------------------------------------------------------------ upserts as snapshot plus delta
def upsert_nodes(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """Merge on (name, type): first creation time, last update time, newest value per property.

    Both sides carry name, type, props, confidence, created_at, updated_at, seq.
    """
    rows = snapshot.unionByName(delta)
    key = ["name", "type"]
    newest = rows.groupBy(*key).agg(
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max("seq").alias("seq"),
        F.max_by("confidence", "seq").alias("confidence"))
    props = (rows.select(*key, "seq", F.explode("props").alias("p", "v"))
             .groupBy(*key, "p").agg(F.max_by("v", "seq").alias("v"))
             .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("props")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return newest.join(props, key, "left").withColumn("props", F.coalesce("props", empty))


def upsert_edges(snapshot: DataFrame, delta: DataFrame, nodes: DataFrame, key: str = "typed") -> DataFrame:
    """Edges whose ends both exist; key (src, dst, type), or (src, dst) with ``key='pair'`` (the last type wins)."""
    names = nodes.select("name").distinct()
    rows = (snapshot.unionByName(delta).join(names.withColumnRenamed("name", "src"), "src", "left_semi")
            .join(names.withColumnRenamed("name", "dst"), "dst", "left_semi"))
    keys = ["src", "dst"] + (["type"] if key == "typed" else [])
    rest = [c for c in rows.columns if c not in keys + ["created_at"]]
    return rows.groupBy(*keys).agg(F.min("created_at").alias("created_at"),
                                   F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "created_at", "r.*")


def update_rows(snapshot: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Bulk update by key: columns of ``updates`` replace those of the snapshot."""
    new = updates.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in updates.columns if c != key],
                         F.lit(True).alias("_hit"))
    joined = snapshot.join(new, key, "left")
    cols = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if f"_new_{c}" in joined.columns else F.col(c) for c in snapshot.columns]
    return joined.select(*cols)


def delete_rows(snapshot: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return snapshot.join(keys.select(key), key, "left_anti")


# ------------------------------------------------------------------ text to entity names
def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))),
                                        lambda i: F.substr(text, i, F.lit(3))))


def entities_by_word(entities: DataFrame, questions: DataFrame, per_word: int = 5, k: int = 10,
                     with_type: bool = True) -> DataFrame:
    """Entities whose name (or type) holds a word of the question; 5 per word, each once, then 10.

    Substring search as an equi-join: every name is filed under its
    three-letter pieces and every word is looked up by its rarest piece, then
    the whole word is tested. Names and questions are dealt to tasks once, a
    bounded number to each. The different words go to the names and their
    matches to the questions where they were counted against a bound, so that
    no piece and no word is a hot key; beyond it both joins shuffle.
    """
    n_names, n_questions = (math.ceil(df.count() / ROWS_PER_TASK) for df in (entities, questions))
    cores = entities.sparkSession.sparkContext.defaultParallelism
    e = entities.select("name", "type").repartition(max(cores, n_names), "name", "type").distinct()
    fields = [F.lower("name")] + ([F.lower("type")] if with_type else [])
    asked = questions.select("query_id", "query").repartition(max(cores, n_questions), "query_id")
    words = asked.select("query_id", F.posexplode(F.array_distinct(F.filter(
        F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) >= 3))).alias("word_no", "word"))
    looked = words.select("word").distinct()
    few = has_at_most(looked, BROADCAST_ROWS)

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    grams = looked.select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    # only pieces of asked words are filed; a piece that no name has cannot match
    filed = (e.select("name", "type", F.explode_outer(F.array_distinct(F.concat(*[_grams(f) for f in fields]))).alias("gram"))
             .join(side(grams.select("gram").distinct()), "gram", "left_semi"))
    load = filed.groupBy("gram").agg(F.count("*").alias("load"))
    piece = (grams.join(side(load), "gram", "left").groupBy("word")
             .agg(F.min_by("gram", F.struct(F.coalesce("load", F.lit(0)), F.col("gram"))).alias("gram")))
    holds = fields[0].contains(F.col("word"))
    if with_type:
        holds = holds | fields[1].contains(F.col("word"))
    matches = best_per(filed.join(side(piece), "gram").filter(holds).select("word", "name", "type"),
                       ["word"], [F.asc("name"), F.asc("type")], per_word, "n")
    hits = words.join(side(matches), "word")
    if not few:
        hits = hits.repartition(max(cores, n_questions), "query_id")
    dedup = ["query_id", "name"] + (["type"] if with_type else [])
    first = best_per(hits, dedup, [F.asc("word_no"), F.asc("n"), F.asc("type")], 1, "first")
    return best_per(first.drop("first"), ["query_id"], [F.asc("word_no"), F.asc("n"), F.asc("name"), F.asc("type")], k)


def entities_holding(entities: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Entities whose name or type holds the whole question, first k by name."""
    low = query.lower()
    return entities.filter(F.lower("name").contains(low) | F.lower("type").contains(low)).orderBy("name", "type").limit(k)


def documents_of_entities(entities: DataFrame, mentions: DataFrame, docs: DataFrame, per_entity: int | None = None
                          ) -> DataFrame:
    """Mention join: entity (name, type) to the documents that mention it."""
    hits = entities.join(mentions, ["name", "type"]).join(docs, "doc_id")
    if per_entity is None:
        return hits
    keys = [c for c in entities.columns]
    return best_per(hits, keys, [F.asc("doc_id")], per_entity, "n")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return best_per(df, keys, order, 1, "_n").drop("_n")


