"""Named queries over the entity and topology graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.operators import filters as FL
from opsloom.operators import graph as G
from opsloom.operators import search as S
from opsloom.plans import bindings as B

c = F.col
GRAPH = f"{B.EDGES}, {B.NODES}"


def _services(spark, d, name="start"):
    return B.nodes(spark, d).filter("type = 'Service'").select(c("name").alias(name))


def _hosts(spark, d):
    return B.nodes(spark, d).filter("type = 'Host'").select(c("name").alias("start"))


def related_entities(spark, d):
    """Every host: what lies within two undirected hops."""
    return G.reachable(B.edges(spark, d), _hosts(spark, d), 2).select("start", "name", "distance")


_BOTH = """e as (select src, dst, type, row_number() over (order by src, dst, type) as id from v_edge),
arc as (select src as a, dst as b, id, type from e union all select dst, src, id, type from e where src <> dst)"""
RELATED_SQL = f"""with {GRAPH}, {_BOTH}, s as (select name as start from v_node where type = 'Host'),
one as (select start, b as node, id from s join arc on a = start)
select distinct start, node as name, 1 as distance from one where node <> start
union all select distinct start, b, 2 from one join arc on a = node and arc.id <> one.id where b <> start"""


def related_three_hops(spark, d):
    """Every service over calls and routes, three undirected hops."""
    return G.reachable(B.edges(spark, d, True), _services(spark, d), 3).select("start", "name", "distance")


_SVC_ARC = f"""e as (select src, dst, type, row_number() over (order by src, dst, type) as id from v_edge
  where type in ('CALLS', 'ROUTES_TO')),
arc as (select src as a, dst as b, id, type from e union all select dst, src, id, type from e where src <> dst)"""
THREE_SQL = f"""with {GRAPH}, {_SVC_ARC}, s as (select name as start from v_node where type = 'Service'),
p1 as (select start, b as node, id as i1 from s join arc on a = start),
p2 as (select start, b as node, i1, id as i2 from p1 join arc on a = node and id <> i1),
p3 as (select start, b as node from p2 join arc on a = node and id <> i1 and id <> i2)
select distinct start, node as name, 1 as distance from p1 where node <> start
union all select distinct start, node, 2 from p2 where node <> start
union all select distinct start, node, 3 from p3 where node <> start"""


def _chains(direction):
    def run(spark, d):
        out = G.nearest_services(B.edges(spark, d, True), _services(spark, d), direction, 2)
        return out.select("start", "name", "distance", F.array_join("chain", ">").alias("chain"), "rank")
    return run


def _chain_sql(direction):
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return f"""with {GRAPH}, arc as (select {a} as a, {b} as b, type, src, dst from v_edge
      where type in ('CALLS', 'ROUTES_TO')),
    s as (select name as start from v_node where type = 'Service'),
    one as (select start, b as node, [type] as chain, src, dst from s join arc on a = start),
    two as (select start, b as node, list_append(chain, arc.type) as chain from one join arc on a = node
      and not (one.src = arc.src and one.dst = arc.dst and one.chain[1] = arc.type)),
    u as (select distinct start, node, chain, 1 as distance from one where node <> start
      union all select distinct start, node, chain, 2 from two where node <> start)
    select start, node as name, distance, array_to_string(chain, '>') as chain, rank from (select *, row_number() over
      (partition by start order by distance, node, chain) as rank from u) where rank <= 20"""


def call_paths(spark, d):
    """Ends of call paths of one to three hops, with their chains."""
    out = G.reachable(B.edges(spark, d, True), _services(spark, d), 3, "out", chain=True)
    return out.groupBy("start", "distance").agg(F.countDistinct("name").alias("ends"), F.count("*").alias("chains"))


CALL_SQL = f"""with {GRAPH}, arc as (select src as a, dst as b, type, row_number() over (order by src, dst, type) as id
  from v_edge where type in ('CALLS', 'ROUTES_TO')), s as (select name as start from v_node where type = 'Service'),
p1 as (select start, b as node, [type] as chain, id as i1 from s join arc on a = start),
p2 as (select start, b as node, list_append(chain, type) as chain, i1, id as i2 from p1 join arc on a = node and id <> i1),
p3 as (select start, b as node, list_append(chain, type) as chain from p2 join arc on a = node and id <> i1 and id <> i2),
u as (select distinct start, node, chain, 1 as distance from p1 union all select distinct start, node, chain, 2 from p2
  union all select distinct start, node, chain, 3 from p3)
select start, distance, count(distinct node) as ends, count(*) as chains from u where node <> start group by 1, 2"""


def _pairs(spark, d):
    return B.table(spark, d, "supplier").selectExpr(
        "concat('service-', s_suppkey) as source", "concat('service-', (s_suppkey * 31 + 5) % 83) as target"
    ).filter("source <> target")


def _path_query(directed):
    def run(spark, d):
        out = G.shortest_paths(B.edges(spark, d, True), _pairs(spark, d), directed)
        return out.select("source", "target", "length", F.array_join("nodes", ">").alias("nodes"),
                          F.array_join("relations", ">").alias("relations"))
    return run


def _path_sql(directed):
    back = "" if directed else " union select dst, src, type from v_edge where type in ('CALLS', 'ROUTES_TO')"
    return f"""with recursive {GRAPH}, arc as (select src as a, dst as b, type from v_edge
      where type in ('CALLS', 'ROUTES_TO'){back}),
    pair as (select concat('service-', s_suppkey) as source, concat('service-', (s_suppkey * 31 + 5) % 83) as target
      from supplier), p as (
      select source, target, source as node, [source] as nodes, cast([] as varchar[]) as relations, 0 as length
        from pair where source <> target
      union all select source, target, b, list_append(nodes, b), list_append(relations, type), length + 1
        from p join arc on a = node where length < 5 and node <> target and not list_contains(nodes, b)),
    m as (select *, row_number() over (partition by source, target order by length, nodes, relations) as n from p
      where node = target)
    select source, target, length, array_to_string(nodes, '>') as nodes, array_to_string(relations, '>') as relations
    from m where n = 1"""


def host_services(spark, d):
    on = B.edges(spark, d).filter("type = 'DEPLOYED_ON'")
    return on.select(c("dst").alias("host"), c("src").alias("service")).orderBy("host", "service")


def graph_statistics(spark, d):
    return G.graph_statistics(B.nodes(spark, d), B.edges(spark, d))


def service_topology(spark, d):
    asked = B.table(spark, d, "customer").select(F.concat(F.lit("service-"), c("c_nationkey")).alias("service")).distinct()
    return G.service_topology(B.nodes(spark, d), B.edges(spark, d), asked)


TOPOLOGY = f"""svc as (select name from v_node where type = 'Service'),
asked as (select distinct concat('service-', c_nationkey) as service from customer),
bt as (select e.* from v_edge e join svc a on e.src = a.name join svc b on e.dst = b.name),
topo as (select distinct service, src as from_service, dst as to_service, bt.type as relation from asked
  join svc on service = name left join (select src as n, * from bt union all select dst, * from bt) bt on n = service)"""


def valid_relations(spark, d):
    rel = service_topology(spark, d).filter(FL.has_both_ends())
    sides = G.affected_services(rel).agg(F.count("*").alias("affected"))
    up = rel.filter("service = to_service").agg(F.countDistinct("from_service").alias("n"))
    down = rel.filter("service = from_service").agg(F.countDistinct("to_service").alias("n"))
    return sides.select("affected", up.scalar().alias("upstream"), down.scalar().alias("downstream"))


def potential_dependencies(spark, d):
    return G.potential_dependencies(B.affects(spark, d))


def _shared_sql(source, group, member, confidence):
    return f"""one as (select distinct {group} as g, {member} as m from {source}),
    sized as (select g, m, count(*) over (partition by g) as size from one)
    select g as "group", m as member, size, cast({confidence} as double) as confidence from sized where size > 1"""


def collocated(spark, d):
    on = B.edges(spark, d).filter("type = 'DEPLOYED_ON'").select(c("dst").alias("host"), c("src").alias("service"))
    return G.collocated(on)


def shared_evidence(spark, d):
    """Evidence for the component pairs that the parts table asks about; confidence 0.5, repeats counted."""
    shared = G.potential_dependencies(B.affects(spark, d))
    asked = B.table(spark, d, "lineitem").selectExpr(
        "concat('part-', l_partkey) as left", "concat('part-', (l_partkey * 13 + 1) % 2000) as right"
    ).filter("left <> right").distinct()
    return G.shared_evidence(shared, asked).withColumns({"confidence": F.lit(0.5), "evidence_count": c("evidence") - 1})


EVIDENCE_SQL = f"""with {B.AFFECTS}, one as (select distinct issue, component as m from v_affects),
asked as (select distinct concat('part-', l_partkey) as l, concat('part-', (l_partkey * 13 + 1) % 2000) as r from lineitem)
select l as "left", r as "right", count(*) as evidence, cast(0.5 as double) as confidence, count(*) - 1 as evidence_count
from asked join one a on a.m = l join one b on b.m = r and a.issue = b.issue where l <> r group by 1, 2"""


def issue_patterns(spark, d):
    return G.issue_patterns(B.affects(spark, d))


def enrichment_totals(spark, d):
    """Relations that each inference adds."""
    aff = B.affects(spark, d)
    parts = [("dependencies", G.shared_total(G.potential_dependencies(aff))), ("collocated", G.shared_total(collocated(spark, d))),
             ("patterns", G.issue_patterns(aff).agg(F.count("*").alias("n")))]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("inference"), "n")
        out = one if out is None else out.unionByName(one)
    return out


TOTALS_SQL = f"""with {B.AFFECTS}, {B.EDGES}, o1 as (select distinct issue as g, component as m from v_affects),
o2 as (select distinct dst as g, src as m from v_edge where type = 'DEPLOYED_ON')
select 'dependencies' as inference, (select count(*) from o1 a join o1 b using (g) where a.m <> b.m) as n
union all select 'collocated', (select count(*) from o2 a join o2 b using (g) where a.m <> b.m)
union all select 'patterns', (select count(*) from (select component, issue_type from v_affects group by 1, 2
    having count(*) > 1))"""


def topology_check(spark, d):
    """Expected direct edges, present or not: does supplier n call supplier 2n?"""
    want = B.table(spark, d, "supplier").selectExpr(
        "concat('service-', s_suppkey) as src", "concat('service-', (s_suppkey * 7 + s_suppkey % 2) % 97) as dst",
        "'CALLS' as type")
    return G.missing_edges(want, B.edges(spark, d))


def many_dependencies(spark, d):
    return G.many_dependencies(B.edges(spark, d), ["CALLS", "ROUTES_TO"])


def entities_in_questions(spark, d):
    ents = B.nodes(spark, d)
    return G.entities_by_word(ents, _word_asks(spark, d)).select("query_id", "name", "type", "rank")


def _word_asks(spark, d):
    return B.table(spark, d, "customer").selectExpr(
        "c_custkey as query_id", "concat('host-', c_nationkey % 3, ' ice-9', c_custkey % 10, ' ho ', lower(c_mktsegment),"
        " ' rt-', c_custkey % 1000) as query")


WORDS_SQL = f"""with {B.NODES}, q as (select c_custkey as query_id, string_split(concat('host-', c_nationkey % 3,
    ' ice-9', c_custkey % 10, ' ho ', lower(c_mktsegment), ' rt-', c_custkey % 1000), ' ') as ws from customer),
w as (select query_id, unnest(range(1, len(ws) + 1)) as word_no, unnest(ws) as word from q),
dw as (select distinct word from w where length(word) >= 3),
m as (select * from (select word, name, type, row_number() over (partition by word order by name, type) as n
  from dw join v_node on contains(lower(name), word) or contains(lower(type), word)) where n <= 5),
h as (select query_id, name, type, word_no, n from w join m using (word)),
f as (select *, row_number() over (partition by query_id, name, type order by word_no, n) as k from h)
select query_id, name, type, rank from (select *, row_number() over (partition by query_id order by word_no, n, name, type)
  as rank from f where k = 1) where rank <= 10"""


def documents_by_entity(spark, d):
    """Documents that mention each service, three per entity, as graph hits."""
    ents = B.nodes(spark, d).filter("type = 'Service'").select("name", "type")
    docs = B.documents(spark, d).select("doc_id", "title")
    return G.documents_of_entities(ents, B.mentions(spark, d), docs, 3).select(
        "name", "type", "doc_id", "title", F.lit(R.GRAPH_HIT_SCORE).alias("score"))


MENTION_SQL = f"""with {B.NODES}, {B.MENTIONS}, {B.DOCUMENTS}
select name, type, doc_id, title, cast(0.7 as double) as score from (select name, type, doc_id, title, row_number() over
  (partition by name, type order by doc_id) as n from v_node join v_mention using (name, type) join v_kb using (doc_id)
  where type = 'Service') where n <= 3"""


def search_by_entity(spark, d):
    """All documents per mentioned component, with counts."""
    docs = B.documents(spark, d).select("doc_id", "category")
    ents = B.nodes(spark, d).filter("type = 'Component'").select("name", "type")
    hits = G.documents_of_entities(ents, B.mentions(spark, d), docs)
    return hits.groupBy("name", "category").agg(F.count("*").alias("n"), F.lit(R.ENTITY_HIT_SCORE).alias("score"))


def find_entities(spark, d):
    """Open-property filter: hosts of one data center, by name."""
    ents = B.table(spark, d, "supplier").select(
        F.concat(F.lit("service-"), "s_suppkey").alias("name"), F.lit("Service").alias("type"),
        F.create_map(F.lit("nation"), c("s_nationkey").cast("string"),
                     F.lit("tier"), (c("s_suppkey") % 3).cast("string")).alias("props"))
    return ents.filter(FL.entity_filter("Service", {"tier": "1"})).select("name", c("props")["nation"].alias("nation"))


def entities_holding(spark, d):
    return G.entities_holding(B.nodes(spark, d), "Service-1").select("name", "type")


def suggestions(spark, d):
    """Entity labels that hold the question, then fixed phrases that hold it, five per question."""
    asks = B.table(spark, d, "nation").selectExpr("n_nationkey as query_id", "concat('host-', n_nationkey) as query")
    more = B.table(spark, d, "region").selectExpr("r_regionkey + 100 as query_id",
                                                  "case r_regionkey % 2 when 0 then 'cpu' else '性能' end as query")
    q = asks.unionByName(more)
    ents = G.entities_by_word(B.nodes(spark, d), q, 5, 5).select(
        "query_id", F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("suggestion"), c("rank").alias("pos"))
    phrases = q.select("query_id", F.lower("query").alias("low"), F.posexplode(
        F.array(*[F.lit(p) for p in R.SUGGESTIONS])).alias("pos", "suggestion")).filter(
        F.lower("suggestion").contains(c("low"))).select("query_id", "suggestion", (c("pos") + 100).alias("pos"))
    return S.best_per(ents.unionByName(phrases), ["query_id"], [F.asc("pos")], 5).select("query_id", "suggestion", "rank")


_PHRASES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(R.SUGGESTIONS))
SUGGEST_SQL = f"""with {B.NODES}, q as (select n_nationkey as query_id, concat('host-', n_nationkey) as query from nation
  union all select r_regionkey + 100, case r_regionkey % 2 when 0 then 'cpu' else '性能' end from region),
e as (select query_id, concat(name, ' (', type, ')') as suggestion, row_number() over (partition by query_id
  order by name, type) as pos from q join v_node on length(query) >= 3 and
  (contains(lower(name), query) or contains(lower(type), query))),
p(i, phrase) as (values {_PHRASES}),
u as (select * from e where pos <= 5 union all select query_id, phrase, i + 100 from q join p on contains(lower(phrase), query))
select query_id, suggestion, rank from (select *, row_number() over (partition by query_id order by pos) as rank from u)
where rank <= 5"""


def three_way_fusion(spark, d):
    """Vector, keyword and graph hits of every question in one weighted list."""
    asks = B.asks(spark, d)
    v = S.similar_rows(B.doc_vectors(spark, d), B.ask_vectors(spark, d), 10)
    t = S.bm25_search(B.documents(spark, d), asks, 10)
    named = asks.select("query_id", F.concat(F.lit("service-"), (c("query_id") % 100)).alias("name"))
    g = S.best_per(named.join(B.mentions(spark, d), "name"), ["query_id", "name"], [F.asc("doc_id")], 3).select(
        "query_id", "doc_id", F.lit(R.GRAPH_HIT_SCORE).alias("score"), c("name").alias("related_entity"))
    out = S.fuse_three(v, t, g, 10, (0.6, 0.3, 0.1))
    return out.select("query_id", "doc_id", *[F.round(x, 6).alias(x) for x in (
        "vector_score", "keyword_score", "graph_score", "final_score")], "related_entity", "rank")


def _fusion_sql():
    from opsloom.plans.search import BASE, _top_sql
    return f"""{BASE}, {B.MENTIONS}, {_top_sql('vt', 'vec')}, {_top_sql('bt', 'bm')},
    gt as (select * from (select query_id, doc_id, name, row_number() over (partition by query_id order by doc_id) as r
      from v_ask join v_mention on name = concat('service-', query_id % 100)) where r <= 3),
    u as (select query_id, doc_id, score as v, 0 as b, 0 as g, null as e from vt
      union all select query_id, doc_id, 0, score, 0, null from bt
      union all select query_id, doc_id, 0, 0, 0.7, name from gt),
    f as (select query_id, doc_id, sum(v) as v, sum(b) as b, sum(g)::double as g, max(e) as e from u group by 1, 2),
    s as (select *, round(v * 0.6::double + b * 0.3::double + g * 0.1::double, 9) as fs from f)
    select query_id, doc_id, round(v, 6) as vector_score, round(b, 6) as keyword_score, round(g, 6) as graph_score,
      round(fs, 6) as final_score, e as related_entity, rank from (select *, row_number() over (partition by query_id
      order by fs desc, doc_id) as rank from s) where rank <= 10"""


def node_upsert(spark, d):
    """Lines as node versions: part names with the last price as a property."""
    lines = B.table(spark, d, "lineitem").select(
        F.concat(F.lit("part-"), "l_partkey").alias("name"), F.lit("Component").alias("type"),
        F.create_map(F.lit("flag"), c("l_returnflag"), F.concat(F.lit("line"), c("l_linenumber") % 2), c("l_linestatus"))
        .alias("props"), c("l_discount").alias("confidence"), c("l_shipdate").cast("timestamp").alias("created_at"),
        c("l_shipdate").cast("timestamp").alias("updated_at"),
        F.struct(c("l_shipdate").cast("timestamp").alias("t"), "l_orderkey", "l_linenumber", "l_quantity",
                 "l_extendedprice").alias("seq"))
    out = G.upsert_nodes(lines.filter("confidence < 0.05"),
                         lines.filter("confidence >= 0.05"))
    fmt = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x)
    return out.select("name", "type", fmt("created_at"), fmt("updated_at"), "confidence",
                      c("props")["flag"].alias("flag"), c("props")["line0"].alias("line0"),
                      c("props")["line1"].alias("line1"))


UPSERT_SQL = """with l as (select concat('part-', l_partkey) as name, *, row_number() over (partition by l_partkey order by
  l_shipdate desc, l_orderkey desc, l_linenumber desc, l_quantity desc, l_extendedprice desc) as n from lineitem)
select name, 'Component' as type, strftime(min(l_shipdate), '%Y-%m-%d') as created_at,
  strftime(max(l_shipdate), '%Y-%m-%d') as updated_at, first(l_discount order by n) as confidence,
  first(l_returnflag order by n) as flag, first(l_linestatus order by n) filter (l_linenumber % 2 = 0) as line0,
  first(l_linestatus order by n) filter (l_linenumber % 2 = 1) as line1 from l group by name"""


def _edge_upsert(key):
    def run(spark, d):
        lines = B.table(spark, d, "lineitem").select(
            F.concat(F.lit("service-"), "l_suppkey").alias("src"), F.concat(F.lit("part-"), "l_partkey").alias("dst"),
            F.when(c("l_returnflag") == "R", "USES").otherwise("CALLS").alias("type"), c("l_quantity").alias("weight"),
            c("l_shipdate").cast("timestamp").alias("created_at"),
            F.struct(c("l_shipdate").cast("timestamp").alias("t"), "l_orderkey", "l_linenumber", "l_quantity",
                     "l_extendedprice").alias("seq"))
        nodes = B.nodes(spark, d).filter(~c("name").endswith("7"))
        out = G.upsert_edges(lines.filter("weight < 25"), lines.filter("weight >= 25"), nodes, key)
        return out.select("src", "dst", "type", "weight", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))
    return run


def _edge_upsert_sql(key):
    extra = ", type" if key == "typed" else ""
    return f"""with l as (select concat('service-', l_suppkey) as src, concat('part-', l_partkey) as dst,
      case when l_returnflag = 'R' then 'USES' else 'CALLS' end as type, * from lineitem
      where l_suppkey % 10 <> 7 and l_partkey % 10 <> 7),
    n as (select *, row_number() over (partition by src, dst{extra} order by l_shipdate desc, l_orderkey desc,
      l_linenumber desc, l_quantity desc, l_extendedprice desc) as n, min(l_shipdate) over (partition by src, dst{extra}) as f
      from l) select src, dst, type, l_quantity as weight, strftime(f, '%Y-%m-%d') as created_at from n where n = 1"""


QUERIES = {
    "related_entities": (related_entities, RELATED_SQL),
    "related_three_hops": (related_three_hops, THREE_SQL),
    "upstream_services": (_chains("in"), _chain_sql("in")),
    "downstream_services": (_chains("out"), _chain_sql("out")),
    "call_paths": (call_paths, CALL_SQL),
    "shortest_paths": (_path_query(False), _path_sql(False)),
    "critical_paths": (_path_query(True), _path_sql(True)),
    "host_services": (host_services, f"with {B.EDGES} select dst as host, src as service from v_edge "
                      "where type = 'DEPLOYED_ON'"),
    "graph_statistics": (graph_statistics, f"""with {GRAPH} select 'nodes' as kind, '' as label, count(*) as n from v_node
      union all select 'edges', '', count(*) from v_edge union all select 'node type', type, count(*) from v_node group by 2
      union all select 'edge type', type, count(*) from v_edge group by 2"""),
    "service_topology": (service_topology, f"with {GRAPH}, {TOPOLOGY} select * from topo"),
    "affected_services": (valid_relations, f"""with {GRAPH}, {TOPOLOGY}, v as (select * from topo where from_service
      is not null) select (select count(*) from (select from_service from v union select to_service from v)) as affected,
      (select count(distinct from_service) from v where service = to_service) as upstream,
      (select count(distinct to_service) from v where service = from_service) as downstream"""),
    "potential_dependencies": (potential_dependencies, f"with {B.AFFECTS}, " + _shared_sql("v_affects", "issue", "component", 0.5)),
    "collocated_services": (collocated, f"with {B.EDGES}, " + _shared_sql(
        "(select * from v_edge where type = 'DEPLOYED_ON')", "dst", "src", 0.8)),
    "shared_evidence": (shared_evidence, EVIDENCE_SQL),
    "issue_patterns": (issue_patterns, f"""with {B.AFFECTS} select component, issue_type, count(*) as frequency,
      cast(0.7 as double) as confidence from v_affects group by 1, 2 having count(*) > 1"""),
    "enrichment_totals": (enrichment_totals, TOTALS_SQL),
    "topology_check": (topology_check, f"""with {B.EDGES}, w as (select concat('service-', s_suppkey) as src,
      concat('service-', (s_suppkey * 7 + s_suppkey % 2) % 97) as dst, 'CALLS' as type from supplier)
      select src, dst, type, exists (select 1 from v_edge e where e.src = w.src and e.dst = w.dst and e.type = w.type)
      as present from w"""),
    "many_dependencies": (many_dependencies, f"""with {B.EDGES} select src, count(distinct dst) as dependencies from v_edge
      where type in ('CALLS', 'ROUTES_TO') group by 1 having count(distinct dst) > 1"""),
    "entities_in_questions": (entities_in_questions, WORDS_SQL),
    "documents_by_entity": (documents_by_entity, MENTION_SQL),
    "search_by_entity": (search_by_entity, f"""with {B.NODES}, {B.MENTIONS}, {B.DOCUMENTS} select name, category,
      count(*) as n, cast(1.0 as double) as score from v_node join v_mention using (name, type) join v_kb using (doc_id)
      where type = 'Component' group by 1, 2"""),
    "find_entities": (find_entities, "select concat('service-', s_suppkey) as name, cast(s_nationkey as varchar) as nation "
                      "from supplier where s_suppkey % 3 = 1"),
    "entities_holding": (entities_holding, f"""with {B.NODES} select name, type from v_node where contains(lower(name), 'service-1')
      or contains(lower(type), 'service-1') order by name, type limit 10"""),
    "search_suggestions": (suggestions, SUGGEST_SQL),
    "hybrid_three_way": (three_way_fusion, _fusion_sql()),
    "node_upsert": (node_upsert, UPSERT_SQL),
    "edge_upsert_typed": (_edge_upsert("typed"), _edge_upsert_sql("typed")),
    "edge_upsert_pair": (_edge_upsert("pair"), _edge_upsert_sql("pair")),
}
