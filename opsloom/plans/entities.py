"""Named queries of entity and relation extraction."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.operators import entities as E
from opsloom.plans import bindings as B
from opsloom.plans.sqltext import quote

c = F.col


def _texts(spark, d):
    return B.documents(spark, d).select("doc_id", F.concat_ws("\n", "title", "content").alias("text"))


def entity_rows(spark, d):
    return E.extract_entities(_texts(spark, d))


def entity_counts(spark, d):
    return E.entity_type_counts(E.extract_entities(_texts(spark, d)))


def relation_rows(spark, d):
    texts = _texts(spark, d)
    return E.extract_relations(texts, E.extract_entities(texts))


def question_entities(spark, d):
    return E.question_entities(B.questions(spark, d))


def question_services(spark, d):
    ents = E.of_label(E.question_entities(B.questions(spark, d)), "SERVICE")
    return ents.groupBy(c("text").alias("service")).agg(F.countDistinct("query_id").alias("questions"))


def ip_entities(spark, d):
    """IP addresses alone: the part of the job that SQL can state."""
    lines = B.log_lines(spark, d).select(c("line_number").alias("doc_id"), c("raw_line").alias("text"))
    return E.extract_entities(lines).filter("label = 'IP_ADDRESS'").groupBy("text").agg(
        F.countDistinct("doc_id").alias("lines"))


IP_SQL = f"""with {B.LOG_LINES}, i as (select line_number, unnest(regexp_extract_all(raw_line, {quote(R.IP_PATTERN)}))
  as text from v_log_line) select text, count(distinct line_number) as lines from i group by 1"""


def graph_entities(spark, d):
    return E.graph_tables(B.documents(spark, d))["entity"]


def graph_mentions(spark, d):
    return E.graph_tables(B.documents(spark, d))["mention"]


def change_graph(spark, d):
    return E.change_relations(B.changes(spark, d))


_NAMED = " or ".join(f"contains(part, '{s}')" for s in R.SEED_ENTITIES["SERVICE"])
CHANGE_GRAPH_SQL = f"""with {B.CHANGES}, f as (select id, unnest(files_changed) as file_path from v_change),
s as (select distinct id, part from (select id, unnest(string_split(file_path, '/')) as part from f) where {_NAMED})
select id as source, part as target, 'MODIFIES' as relation, file_path, cast(0.9 as double) as confidence
from f join s using (id) where contains(file_path, part)"""


def change_entities(spark, d):
    return E.change_metadata_entities(B.changes(spark, d)).groupBy("text", "label", "confidence").agg(F.count("*").alias("n"))


def ticket_entities(spark, d):
    return E.ticket_metadata_entities(B.tickets(spark, d)).groupBy("text", "label", "confidence").agg(
        F.count("*").alias("n"))


def ticket_graph(spark, d):
    return E.ticket_relations(B.tickets(spark, d))


# ------------------------------------------------------------------ SQL of the spans
def _span_sql(source: str, key: str, rules, lower_after: int | None = None, append: bool = False, normal: str = "{x}") -> str:
    """CTEs that leave ``ent`` (key, ord, text, label, start, "end", confidence) of ``source`` (key, text).

    The engine's word classes know ASCII only, so other letters and digits stand as Z and other signs as # in the text that
    patterns see; both keep their places. Words of a pattern that are not ASCII stand as as many Z between word borders; what
    they match is then compared with the pattern itself.
    """
    mask = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{N}]', '#', 'g'), '[^\\x00-\\x7F]', 'Z', 'g')"
    parts = []
    for i, (label, confidence, pattern, flags) in enumerate(rules):
        low = lower_after is not None and i >= lower_after
        masked = re.sub(r"[^\x00-\x7f]+", lambda m: f"Z{{{len(m[0])}}}", pattern)
        rx = quote(("(?i)" if flags & re.I else "") + masked)
        whole = "null" if masked == pattern else quote("(?i)" + pattern.replace("\\b", ""))
        seen = "lower(mask)" if low else "mask"
        parts.append(f"select {key}, {i} as rule, '{label}' as label, cast({confidence} as double) as confidence, regexp_extract_all({seen}, {rx}) as m, "
                     f"string_split_regex({seen}, {rx}) as s, {'lower(text)' if low else 'text'} as src, {whole} as whole from masked")
    order = 'start, "end", rule, i' if append else "start, rule, i"
    swapped = "list_concat(list_concat(kept[1:pos - 1], kept[pos + 1:]), [x])" if append else "list_concat(list_concat(kept[1:pos - 1], [x]), kept[pos + 1:])"
    return f"""masked as (select {key}, text, {mask} as mask from {source}),
found as ({" union all ".join(parts)}),
place as (select *, list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0)
  as start, length(m[i]) as n from (select *, unnest(range(1, len(m) + 1)) as i from found)),
span as (select {key}, rule, i, cast(start as integer) as start, cast(start + n as integer) as "end", {normal.format(x="substr(src, cast(start as bigint) + 1, n)")} as text,
  label, confidence from place where whole is null or regexp_full_match(substr(src, cast(start as bigint) + 1, n), whole)),
turn as (select {key}, row_number() over (partition by {key} order by {order}) as k,
  {{'text': text, 'label': label, 'a': start, 'b': "end", 'c': confidence}} as x from span),
merged as (select distinct {key}, cast(0 as bigint) as k, cast([] as struct("text" varchar, "label" varchar, a integer, b integer, c double)[]) as kept from turn
  union all select {key}, k, case when pos = 0 then list_append(kept, x) when x.c > kept[pos].c then {swapped} else kept end from (
    select merged.{key}, turn.k, kept, x, coalesce(list_position(list_transform(kept, lambda z: x.a < z.b and x.b > z.a), true), 0) as pos
    from merged join turn on merged.{key} = turn.{key} and turn.k = merged.k + 1)),
last as (select {key}, unnest(kept) as e, unnest(range(len(kept))) as ord from (select {key}, max_by(kept, k) as kept from merged group by 1)),
ent as (select {key}, cast(ord as integer) as ord, e.text as text, e.label as label, e.a as start, e.b as "end", e.c as confidence from last)"""


_DOC_TEXT = "doc_text as (select doc_id, concat_ws(chr(10), title, content) as text from v_kb)"
ENTITY_CTE = f"with recursive {B.DOCUMENTS}, {_DOC_TEXT}, {_span_sql('doc_text', 'doc_id', E._TEXT_RULES)}"
_NORMAL = """case when label = 'SERVICE' then regexp_replace(lower(trim({x})), 'service[\\s_-]*([a-z]\\d*)', 'service-\\1', 'g') else {x} end"""
QUESTION_CTE = f"""with recursive {B.QUESTIONS}, q_text as (select query_id, query as text from v_question),
{_span_sql('q_text', 'query_id', E._QUESTION_RULES, 3, True, _NORMAL)}"""


def _relation_sql() -> str:
    said = " union all ".join(
        f"select doc_id, {n} as rule, '{kind}' as relation, unnest(regexp_extract_all(text, {quote(rx)}, 1)) as source_text, "
        f"unnest(regexp_extract_all(text, {quote(rx)}, 2)) as target_text from doc_text"
        for n, (kind, rx) in enumerate((k, "(?i)" + p.replace(r"\w", r"[\p{L}\p{N}_]")) for k, p in R.RELATION_PATTERNS))
    rule = "case " + " ".join(f"when (l.label = '{a}' and r.label = '{b}') or (l.label = '{b}' and r.label = '{a}') then '{k}'"
                              for a, b, k in R.NEAR_PAIR_RULES) + " end"
    return f"""{ENTITY_CTE}, said as ({said}),
one as (select doc_id, lower(text) as key, min(ord) as ord, arg_min(label, ord) as label from ent group by 1, 2)
select said.doc_id, relation, source_text, target_text, s.ord as source_ord, s.label as source_type, t.ord as target_ord, t.label as target_type,
  cast(0.8 as double) as confidence, false as inferred from said join one s on s.doc_id = said.doc_id and s.key = lower(source_text)
  join one t on t.doc_id = said.doc_id and t.key = lower(target_text)
union all select l.doc_id, {rule} as relation, l.text, r.text, l.ord, l.label, r.ord, r.label, 0.6, true
from ent l join ent r on l.doc_id = r.doc_id and l.ord < r.ord and r.start - l."end" > 0 and r.start - l."end" < {R.NEAR_PAIR_GAP}
where {rule} is not null"""


QUERIES = {
    "entity_rows": (entity_rows, f"{ENTITY_CTE} select * from ent"),
    "entity_counts": (entity_counts, f"{ENTITY_CTE} select doc_id, label, count(*) as n from ent group by 1, 2"),
    "relation_rows": (relation_rows, _relation_sql()),
    "question_entities": (question_entities, f"{QUESTION_CTE} select * from ent"),
    "question_services": (question_services, f"""{QUESTION_CTE} select text as service, count(distinct query_id) as questions from ent
      where label = 'SERVICE' group by 1"""),
    "ip_entities": (ip_entities, IP_SQL),
    "graph_entity_table": (graph_entities, f"""{ENTITY_CTE} select text as name, label as type, max(confidence) as confidence,
      min(doc_id) as source_document_id, count(*) as mentions from ent group by 1, 2"""),
    "graph_mention_table": (graph_mentions, f"{ENTITY_CTE} select distinct text as name, label as type, doc_id from ent"),
    "change_graph": (change_graph, CHANGE_GRAPH_SQL),
    "change_entities": (change_entities, f"""with {B.CHANGES}, f as (select id, unnest(files_changed) as p from v_change),
      u as (select part as text, 'SERVICE' as label, cast(0.9 as double) as confidence from
        (select unnest(string_split(p, '/')) as part from f) where {_NAMED}
      union all select l, 'COMPONENT', 0.8 from (select unnest(labels) as l from v_change)
        where lower(l) in ('backend', 'frontend', 'database', 'api'))
      select text, label, confidence, count(*) as n from u group by 1, 2, 3"""),
    "ticket_entities": (ticket_entities, f"""with {B.TICKETS}, u as (select unnest(components) as text, 'COMPONENT' as label,
      cast(0.9 as double) as confidence from v_ticket union all select type, 'ISSUE_TYPE', 1.0 from v_ticket
      union all select priority, 'PRIORITY', 1.0 from v_ticket)
      select text, label, confidence, count(*) as n from u group by 1, 2, 3"""),
    "ticket_graph": (ticket_graph, f"""with {B.TICKETS} select distinct id as source, unnest(components) as target,
      type as issue_type, priority, 'AFFECTS' as relation, cast(0.9 as double) as confidence from v_ticket"""),
}
