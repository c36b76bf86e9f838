"""Entities and relations of texts: one job from documents to an entity and a relation table.

All of it is column and join work. Built-in functions give matches without
offsets; the stretches between the matches give the places.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.operators.search import best_per

SPAN = "struct<text:string,label:string,start:int,end:int,confidence:double>"
_TEXT_RULES = ([(label, 0.8, p, re.I) for label, p in R.ENTITY_PATTERNS] + [("IP_ADDRESS", 0.9, R.IP_PATTERN, 0)]
               + [("TIMESTAMP", 0.95, p, 0) for p in R.TIMESTAMP_PATTERNS])
#: What every match of these labels holds; a short pattern that is cheap to test before the long ones.
_NEEDED_SIGNS = {"IP_ADDRESS": r"[0-9]\.[0-9]", "TIMESTAMP": r"(?U)\d:\d"}
_QUESTION_RULES = [(label, conf, p, re.I) for label, conf, p in R.QUESTION_PATTERNS]


def _needed_word(pattern: str, flags: int) -> str:
    """Longest run of letters that every match must hold; cheap to test before the regex."""
    if not flags & re.I or "|" in pattern:
        return ""
    return max(re.findall(r"[a-z]{3,}", re.sub(r"\\.|\[[^\]]*\][?*+]?|[a-z]\?", " ", pattern)), key=len, default="")


def _hits(text: Column, rules, lower_after: int | None = None) -> Column:
    """All matches of all rules with the length of the stretch before each; rules from ``lower_after`` on see lowered text."""
    folded = F.lower(F.upper(text))

    def of(i: int, label: str, confidence: float, pattern: str, flags: int) -> Column:
        src = F.lower(text) if lower_after is not None and i >= lower_after else text
        rx = F.lit(("(?iU)" if flags & re.I else "(?U)") + pattern)
        hits = F.zip_with(F.split(src, rx, -1), F.regexp_extract_all(src, rx, F.lit(0)), lambda gap, hit: F.struct(
            F.lit(i).alias("rule"), F.length(gap).alias("gap"), hit.alias("text"), F.lit(label).alias("label"),
            F.lit(confidence).cast("double").alias("confidence")))
        word = _needed_word(pattern, flags)
        choice = re.fullmatch(r"\\b\(([A-Za-z|]+)\)\\b", pattern)
        if word:
            seen = folded.contains(word)
        elif choice and flags & re.I:
            seen = reduce(operator.or_, [folded.contains(w.lower()) for w in choice[1].split("|")])
        else:
            seen = F.rlike(src, F.lit(_NEEDED_SIGNS[label])) if label in _NEEDED_SIGNS else F.lit(True)
        return F.when(text.isNotNull() & seen, hits).otherwise(F.array().cast("array<struct<rule:int,gap:int,text:string,label:string,confidence:double>>"))

    return F.concat(*[of(i, *rule) for i, rule in enumerate(rules)])


def _span_order(by_end: bool):
    def compare(a: Column, b: Column) -> Column:
        out = F.when(a["s"]["start"] < b["s"]["start"], -1).when(a["s"]["start"] > b["s"]["start"], 1)
        if by_end:
            out = out.when(a["s"]["end"] < b["s"]["end"], -1).when(a["s"]["end"] > b["s"]["end"], 1)
        return out.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)
    return compare


def merge_overlaps(spans: Column, append: bool = False) -> Column:
    """Spans in text order without overlaps: of two that overlap the surer one stays.

    The newcomer meets the first kept span it overlaps. ``append=False`` puts a
    surer newcomer in its place, ``append=True`` removes the old one and puts
    the newcomer at the end; then the order is also by end.
    """
    numbered = F.transform(spans, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    return _folded(F.transform(F.array_sort(numbered, _span_order(append)), lambda x: x["s"]), append)


def _folded(ordered: Column, append: bool) -> Column:
    start = F.array().cast(f"array<{SPAN}>")

    def add(kept: Column, new: Column) -> Column:
        touches = F.transform(kept, lambda k: (new["start"] < k["end"]) & (new["end"] > k["start"]))
        at = F.array_position(touches, F.lit(True)).cast("int")
        old = F.try_element_at(kept, at)
        before, after = F.slice(kept, F.lit(1), at - 1), F.slice(kept, at + 1, F.size(kept))
        replaced = F.concat(before, after, F.array(new)) if append else F.concat(before, F.array(new), after)
        return F.when(at == 0, F.array_append(kept, new)).when(new["confidence"] > old["confidence"], replaced).otherwise(kept)

    return F.aggregate(ordered, start, add)


def merged_spans(docs: DataFrame, key: str, text: Column, rules, lower_after: int | None = None, append: bool = False,
                 normal: Column | None = None) -> DataFrame:
    """(key, ord, text, label, start, end, confidence): the matches of all rules without overlaps, in order.

    The matches travel once, by their text's row, and stay there: running sums
    give their places, the running maximum of their ends cuts a text into
    islands of spans that hang together, and only an island is folded by the
    rule of ``merge_overlaps``. A text of many spans costs in proportion.
    ``normal`` restates a span's text before the fold.
    """
    # outer: an inner explode would infer a size filter and match the patterns a second time for it
    found = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), _hits(text, rules, lower_after).alias("_all"))
    hits = found.select("_row", key, F.posexplode_outer("_all").alias("_i", "_h"))
    hits = hits.filter("_h.text is not null").select("_row", key, "_i", "_h.*").repartition("_row")
    by_rule = W.partitionBy("_row", "rule").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("text")).over(by_rule).cast("int")
    spans = hits.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))
    order = ["start", "end", "rule", "_i"] if append else ["start", "rule", "_i"]
    ahead = W.partitionBy("_row").orderBy(*order)
    told = (spans if normal is None else spans.withColumn("text", normal)).withColumns({
        "_k": F.row_number().over(ahead), "_far": F.max("end").over(ahead.rowsBetween(W.unboundedPreceding, -1))})
    cut = told.withColumn("_island", F.sum(F.when(F.col("start") < F.col("_far"), 0).otherwise(1)).over(ahead.rowsBetween(W.unboundedPreceding, 0)))
    span = F.struct("text", "label", "start", "end", "confidence").cast(SPAN)
    islands = cut.groupBy("_row", "_island").agg(F.first(key).alias(key), F.sort_array(F.collect_list(F.struct("_k", span.alias("s")))).alias("_s"))
    plain = F.transform("_s", lambda x: x["s"])
    kept = islands.select("_row", "_island", key, F.when(F.size("_s") == 1, plain).otherwise(_folded(plain, append)).alias("_s"))
    rows = kept.select("_row", "_island", key, F.posexplode_outer("_s").alias("_n", "e"))
    place = F.row_number().over(W.partitionBy("_row").orderBy("_island", "_n")) - 1
    return rows.select(key, place.alias("ord"), "e.*")


def extract_entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ord, text, label, start, end, confidence), one row per entity of each text."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return merged_spans(named, "doc_id", F.col("text"), _TEXT_RULES)


def question_entities(questions: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Services, components, incidents and operations that questions name; service names normalized."""
    from opsloom.functions.text import normalize_service

    normal = F.when(F.col("label") == "SERVICE", normalize_service(F.trim("text"))).otherwise(F.col("text"))
    named = questions.select(F.col(query_id).alias("query_id"), F.col(query).alias("text"))
    return merged_spans(named, "query_id", F.col("text"), _QUESTION_RULES, lower_after=3, append=True, normal=normal)


def of_label(entities: DataFrame, prefix: str) -> DataFrame:
    """Services (``SERVICE``), components (``COMPONENT_``) or incidents (``INCIDENT_``)."""
    test = F.col("label") == prefix if prefix == "SERVICE" else F.col("label").startswith(prefix)
    return entities.filter(test)


# ------------------------------------------------------------------ relations
def pattern_relations(docs: DataFrame, entities: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``a depends on b`` and the like, when both ends are entities of the same text (the first with that text)."""
    def of_rule(n: int, kind: str, pattern: str) -> Column:
        ends = [F.regexp_extract_all(F.col(text), F.lit("(?iU)" + pattern), F.lit(g)) for g in (1, 2)]
        rows = F.zip_with(*ends, lambda a, b: F.struct(F.lit(n).alias("rule"), F.lit(kind).alias("relation"),
                                                       a.alias("source_text"), b.alias("target_text")))
        return F.when(F.col("_low").contains(_needed_word(pattern, re.I)), rows).otherwise(F.array().cast(
            "array<struct<rule:int,relation:string,source_text:string,target_text:string>>"))

    found = F.concat(*[of_rule(n, kind, p) for n, (kind, p) in enumerate(R.RELATION_PATTERNS)])
    folded = docs.withColumn("_low", F.lower(F.upper(text)))
    said = folded.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("pos", "r")).select(
        "doc_id", "pos", "r.relation", "r.source_text", "r.target_text")
    first = best_per(entities.withColumn("key", F.lower("text")), ["doc_id", "key"], [F.asc("ord")], 1, "n").select(
        "doc_id", "key", "ord", "label")
    source = first.select("doc_id", F.col("key").alias("s"), F.col("ord").alias("source_ord"),
                          F.col("label").alias("source_type"))
    target = first.select("doc_id", F.col("key").alias("t"), F.col("ord").alias("target_ord"),
                          F.col("label").alias("target_type"))
    return (said.withColumns({"s": F.lower("source_text"), "t": F.lower("target_text")})
            .join(source, ["doc_id", "s"]).join(target, ["doc_id", "t"]).drop("s", "t", "pos")
            .withColumns({"confidence": F.lit(0.8), "inferred": F.lit(False)}))


def near_relations(entities: DataFrame, gap: int = R.NEAR_PAIR_GAP) -> DataFrame:
    """Entity pairs of a text less than ``gap`` characters apart whose labels have a rule, either way round.

    A band join: the text is cut into stretches of ``gap`` characters and an
    entity only meets the ones that start in the next two stretches, so a long
    text spreads over many keys and never forms all its pairs.
    """
    rule = F.lit(None).cast("string")
    for a, b, kind in reversed(R.NEAR_PAIR_RULES):
        match = ((F.col("l.label") == a) & (F.col("r.label") == b)) | ((F.col("l.label") == b) & (F.col("r.label") == a))
        rule = F.when(match, F.lit(kind)).otherwise(rule)
    stretch = F.floor(F.col("end") / gap)
    left = entities.withColumn("cell", F.explode(F.array(stretch, stretch + 1))).alias("l")
    right = entities.withColumn("cell", F.floor(F.col("start") / gap)).alias("r")
    distance = F.col("r.start") - F.col("l.end")
    near = left.join(right, (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.cell") == F.col("r.cell"))
                     & (F.col("l.ord") < F.col("r.ord")) & (distance > 0) & (distance < gap))
    return near.select(
        F.col("l.doc_id").alias("doc_id"), rule.alias("relation"), F.col("l.text").alias("source_text"),
        F.col("r.text").alias("target_text"), F.col("l.ord").alias("source_ord"), F.col("l.label").alias("source_type"),
        F.col("r.ord").alias("target_ord"), F.col("r.label").alias("target_type"), F.lit(0.6).alias("confidence"),
        F.lit(True).alias("inferred")).filter("relation is not null")


def extract_relations(docs: DataFrame, entities: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pattern_relations(docs, entities, doc_id, text).unionByName(near_relations(entities))


def entity_type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("doc_id", "label").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ documents to graph tables
def graph_tables(docs: DataFrame, doc_id: str = "doc_id", title: str = "title", content: str = "content"
                 ) -> dict[str, DataFrame]:
    """Entity, document, mention and relation tables of documents, ready for the upserts."""
    full = docs.select(F.col(doc_id).alias("doc_id"), F.col(title).alias("title"),
                       F.concat_ws("\n", title, content).alias("text"))
    ents = extract_entities(full)
    return {
        "entity": ents.groupBy(F.col("text").alias("name"), F.col("label").alias("type")).agg(
            F.max("confidence").alias("confidence"), F.min("doc_id").alias("source_document_id"),
            F.count("*").alias("mentions")),
        "document": full.select("doc_id", "title"),
        "mention": ents.select(F.col("text").alias("name"), F.col("label").alias("type"), "doc_id").distinct(),
        "relation": extract_relations(full, ents),
    }


def change_metadata_entities(changes: DataFrame) -> DataFrame:
    """Services in changed paths (0.9) and selected labels (0.8) of merge requests."""
    services = R.SEED_ENTITIES["SERVICE"]
    named = F.lit(False)
    for s in services:
        named = named | F.col("text").contains(s)
    parts = changes.select("id", F.explode("files_changed").alias("path")).select(
        "id", F.explode(F.split("path", "/")).alias("text")).filter(named).select(
        "id", "text", F.lit("SERVICE").alias("label"), F.lit(0.9).alias("confidence"))
    labels = changes.select("id", F.explode("labels").alias("text")).filter(
        F.lower("text").isin(R.CHANGE_LABELS)).select(
        "id", "text", F.lit("COMPONENT").alias("label"), F.lit(0.8).alias("confidence"))
    return parts.unionByName(labels)


def change_relations(changes: DataFrame) -> DataFrame:
    """Merge request MODIFIES the services that its paths name."""
    files = changes.select("id", F.explode("files_changed").alias("file_path"))
    ents = change_metadata_entities(changes).filter("label = 'SERVICE'").select("id", F.col("text").alias("target")).distinct()
    return files.join(ents, "id").filter(F.col("file_path").contains(F.col("target"))).select(
        F.col("id").alias("source"), "target", F.lit("MODIFIES").alias("relation"), "file_path",
        F.lit(0.9).alias("confidence"))


def ticket_metadata_entities(tickets: DataFrame) -> DataFrame:
    """Components (0.9), issue type (1.0) and priority (1.0) of tickets."""
    return tickets.select("id", F.explode("components").alias("text")).select(
        "id", "text", F.lit("COMPONENT").alias("label"), F.lit(0.9).alias("confidence")).unionByName(
        tickets.select("id", F.inline(F.array(
            F.struct(F.col("type").alias("text"), F.lit("ISSUE_TYPE").alias("label"), F.lit(1.0).alias("confidence")),
            F.struct(F.col("priority").alias("text"), F.lit("PRIORITY").alias("label"), F.lit(1.0).alias("confidence"))))))


def ticket_relations(tickets: DataFrame) -> DataFrame:
    """Issue AFFECTS each of its components, once."""
    return tickets.select(F.col("id").alias("source"), F.explode("components").alias("target"), F.col("type").alias(
        "issue_type"), "priority").distinct().withColumns({"relation": F.lit("AFFECTS"), "confidence": F.lit(0.9)})
