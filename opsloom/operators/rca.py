"""Root-cause scoring: evidence relevance, causes, solutions, ranking, for a table of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions import requests as Q
from opsloom.functions.text import any_of
from opsloom.operators.filters import has_both_ends, has_service
from opsloom.operators.search import best_per

_DIGITS = 9


def _points(text: Column, words: list[str], each: float) -> Column:
    out = F.lit(0.0)
    for w in words:
        out = out + F.when(text.contains(w), each).otherwise(0.0)
    return out


def _capped(total: Column) -> Column:
    return F.round(F.least(total, F.lit(1.0)), _DIGITS)


# ------------------------------------------------------------------ relevance
def log_relevance(query: Column, level: Column, timestamp: Column, content: Column, service: Column, score: Column,
                  as_of: Column) -> Column:
    """Level, recency within a day, six words in line or question, service named, search score."""
    age = as_of.cast("double") - timestamp.cast("double")
    day = 24 * 3600.0
    q, text = F.lower(query), F.lower(content)
    total = (F.when(level == "ERROR", 0.4).when(level == "WARN", 0.2).otherwise(0.0)
             + F.when(age < day, 0.2 * (1 - age / day)).otherwise(0.0))
    for w in R.RELEVANCE_WORDS:
        total = total + F.when(text.contains(w) | q.contains(w), 0.1).otherwise(0.0)
    named = (F.coalesce(service, F.lit("")) != "") & q.contains(F.lower(service))
    total = total + F.when(named, 0.3).otherwise(0.0) + F.coalesce(score, F.lit(0.0)) * 0.3
    return _capped(total)


def knowledge_relevance(query: Column, category: Column, title: Column, content: Column, score: Column) -> Column:
    cat, t, x = (F.lower(F.coalesce(c, F.lit(""))) for c in (category, title, content))
    total = (F.when(any_of(cat, ["故障", "troubleshooting"]), 0.3).otherwise(0.0)
             + F.when(any_of(cat, ["排查", "diagnostic"]), 0.3).otherwise(0.0)
             + _points(t, R.KNOWLEDGE_TERMS, 0.2) + _points(x, R.KNOWLEDGE_TERMS, 0.1))
    words = F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda w: F.length(w) > 2)
    per_word = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(t.contains(w), 0.15).otherwise(0.0)
                           + F.when(x.contains(w), 0.1).otherwise(0.0))
    return _capped(total + per_word + F.coalesce(score, F.lit(0.0)) * 0.4)


def entity_relevance(query: Column, kind: Column, name: Column, related: Column, confidence: Column) -> Column:
    q, n, k = F.lower(query), F.lower(name), F.upper(kind)
    by_type = F.lit(0.0)
    for points, kinds in R.ENTITY_TYPE_RELEVANCE:
        by_type = F.when(k.isin(kinds), points).otherwise(by_type)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    by_name = F.when(q.contains(n), 0.4).when(F.exists(words, lambda w: n.contains(w)), 0.2).otherwise(0.0)
    return _capped(by_type + by_name + F.least(related * 0.05, F.lit(0.2)) + F.coalesce(confidence, F.lit(0.5)) * 0.2)


def merge_evidence(rows: DataFrame, limit: int, mode: str = "balanced") -> DataFrame:
    """Evidence of several types (query_id, result_type, item_id, relevance) in one list.

    ``balanced``: logs up to a half, documents a third, entities a sixth, then
    the best of what is left; ``as_written``: the plain best.
    """
    best = [F.desc("relevance"), F.asc("result_type"), F.asc("item_id")]
    if mode == "as_written":
        return best_per(rows, ["query_id"], best, limit)
    # whatever the final list holds is among the best ``limit`` of its type
    typed = best_per(rows, ["query_id", "result_type"], best, limit, "type_rank")
    quota = (F.when(F.col("result_type") == "log", limit // 2).when(F.col("result_type") == "knowledge", limit // 3)
             .otherwise(limit // 6))
    marked = typed.withColumn("in_quota", F.col("type_rank") <= quota)
    return best_per(marked, ["query_id"], [F.desc("in_quota"), *best], limit).drop("type_rank")


# ------------------------------------------------------------------ causes of questions with evidence
def log_causes(evidence: DataFrame) -> DataFrame:
    """One cause per evidence row by the first rule that fits.

    Input: query_id, content, service_name, hybrid_score. Rows without a real service are skipped.
    """
    x, low, s = F.col("content"), F.lower("content"), F.col("service_name")
    score = F.col("hybrid_score")
    usage = any_of(low, ["usage", "使用"]) | any_of(x, ["MB", "GB", "%"])
    head = F.concat(F.substring(x, 1, 50), F.lit("..."))
    cause = (
        F.when(any_of(low, R.FAILURE_WORDS), F.concat(s, F.lit("服务出现故障: "), head))
        .when(low.contains("cpu") & any_of(low, ["high", "critical", "过高"]), F.concat(s, F.lit("服务CPU资源不足")))
        .when(any_of(low, ["memory", "内存"]) & usage, F.concat(s, F.lit("服务内存使用情况: "), x))
        .when(any_of(low, ["memory", "内存"]), F.concat(s, F.lit("服务内存相关问题")))
        .when(any_of(low, ["timeout", "connection"]), F.concat(s, F.lit("服务连接超时")))
        .when(any_of(low, ["disk", "io"]), F.concat(s, F.lit("服务磁盘IO问题")))
        .when(score > 0.7, F.concat(s, F.lit("服务可能存在问题: "), head)))
    plain = (any_of(low, R.FAILURE_WORDS) | (low.contains("cpu") & any_of(low, ["high", "critical", "过高"]))
             | any_of(low, ["memory", "内存", "timeout", "connection", "disk", "io"]))
    return evidence.filter(has_service()).select(
        "query_id", cause.alias("cause"), F.round(F.when(plain, score).otherwise(score * 0.8), _DIGITS).alias("confidence"),
        F.lit("log").alias("evidence_type"), s.alias("source")).filter("cause is not null")


def relation_causes(relations: DataFrame, first: int = 3) -> DataFrame:
    """Causes from the first relations of each question (query_id, from_service, to_service, relation)."""
    few = best_per(relations.filter(has_both_ends()), ["query_id"],
                   [F.asc("from_service"), F.asc("to_service"), F.asc("relation")], first, "n")
    depends = F.col("relation") == "DEPENDS_ON"
    return few.filter(F.col("relation").isin("DEPENDS_ON", "DEPLOYED_ON")).select(
        "query_id",
        F.when(depends, F.concat("from_service", F.lit("依赖的"), "to_service", F.lit("服务问题")))
        .otherwise(F.concat("to_service", F.lit("主机资源问题"))).alias("cause"),
        F.when(depends, 0.7).otherwise(0.6).alias("confidence"),
        F.when(depends, "dependency").otherwise("deployment").alias("evidence_type"), F.col("from_service").alias("source"))


def symptom_causes(questions: DataFrame) -> DataFrame:
    """Causes that the question text alone suggests."""
    rows = questions.select("query_id", F.inline(Q.question_symptoms(F.col("query"))))
    slow = F.col("type") == "performance"
    return rows.filter(F.col("type").isin("performance", "connectivity")).select(
        "query_id", F.when(slow, "系统性能瓶颈").otherwise("网络连接问题").alias("cause"), F.lit(0.6).alias("confidence"),
        F.lit("symptom").alias("evidence_type"), F.when(slow, "system").otherwise("network").alias("source"))


def rank_causes(questions: DataFrame, logs: DataFrame, relations: DataFrame, k: int = 3) -> DataFrame:
    """Primary cause (rank 1) and alternatives; symptoms only where nothing else was found.

    The causes found and the symptoms meet in one list, so that the search behind the former runs once.
    """
    every = logs.unionByName(relations).withColumn("_soft", F.lit(0)).unionByName(symptom_causes(questions).withColumn("_soft", F.lit(1)))
    least = F.min("_soft").over(Window.partitionBy("query_id"))
    chosen = every.withColumn("_least", least).filter("_soft = _least").drop("_soft", "_least")
    text, source = F.col("cause"), F.col("source")
    valid = ~(any_of(text, ["None", "unknown"]) | source.isNull() | source.isin("None", "unknown")
              | (F.trim(text) == ""))
    return best_per(chosen.filter(valid), ["query_id"],
                    [F.desc("confidence"), F.asc("cause"), F.asc("evidence_type")], k)


def cause_solutions(causes: DataFrame, top: int = 2) -> DataFrame:
    """First fitting solution for each of the top causes."""
    text = F.col("cause")
    low_memory = F.lower(text).contains("memory")
    rule = F.lit(None).cast("struct<solution:string,priority:string,minutes:int>")
    for word, solution, priority, minutes in reversed(R.CAUSE_SOLUTIONS):
        test = text.contains(word)
        if word == "内存":
            test = test | low_memory
        elif word == "内存使用情况":
            test = (text.contains("内存") | low_memory) & (text.contains("使用情况") | F.lower(text).contains("usage"))
        rule = F.when(test, F.struct(F.lit(solution).alias("solution"), F.lit(priority).alias("priority"),
                                     F.lit(minutes).alias("minutes"))).otherwise(rule)
    return causes.filter(F.col("rank") <= top).withColumn("_r", rule).filter("_r is not null").select(
        "query_id", "rank", "cause", "_r.*")


def evidence_mismatch(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """True where memory trouble of service d1 is claimed but the evidence only speaks of disks."""
    low = F.lower("content")
    seen = evidence.groupBy("query_id").agg(
        F.bool_or(low.contains("memory")).alias("memory"), F.bool_or(any_of(low, ["disk", "io"])).alias("disk"))
    q = F.lower("query")
    claims = any_of(q, ["service-d1", "service d1"]) & any_of(q, ["内存", "memory"])
    return questions.join(seen, "query_id", "left").select(
        "query_id", (claims & F.coalesce("disk", F.lit(False)) & ~F.coalesce("memory", F.lit(False))).alias("mismatch"))


# ------------------------------------------------------------------ causes and solutions by symptom
def symptom_cause_table(questions: DataFrame) -> DataFrame:
    """(query_id, cause, cause_type, confidence): rule table joined on symptom type, highest confidence per cause."""
    kinds = Q.symptom_rows(questions).select("query_id", "symptom_type").distinct()
    found = F.lit(None)
    for kind in dict.fromkeys(k for k, *_ in R.CAUSES_OF_SYMPTOM):
        rows = F.array(*[F.struct(F.lit(c).alias("cause"), F.lit(conf).alias("confidence"), F.lit(t).alias("cause_type"))
                         for k, c, conf, t in R.CAUSES_OF_SYMPTOM if k == kind])
        found = F.when(F.col("symptom_type") == kind, rows).otherwise(found)
    return kinds.select("query_id", F.inline(found)).groupBy("query_id", "cause").agg(
        F.max_by("cause_type", "confidence").alias("cause_type"), F.max("confidence").alias("confidence"))


def solution_scores(causes: DataFrame, k: int = 5) -> DataFrame:
    """Every solution of every cause with its score; the first k per question with rank and band."""
    other = [s for s in R.SOLUTIONS_OF_CAUSE if s[0] == ""]
    options = None

    def rows(items):
        return F.array(*[F.struct(F.lit(s).alias("solution"), F.lit(f).alias("feasibility"), F.lit(i).alias("impact"),
                                  F.lit(r).alias("risk"), F.lit(h).alias("hours")) for _, s, f, i, r, h in items])

    options = rows(other)
    for kind in dict.fromkeys(s[0] for s in R.SOLUTIONS_OF_CAUSE if s[0]):
        options = F.when(F.col("cause_type") == kind, rows([s for s in R.SOLUTIONS_OF_CAUSE if s[0] == kind])).otherwise(options)
    each = causes.select("query_id", "cause", "cause_type", "confidence", F.inline(options))
    score = (F.col("feasibility") * 0.3 + F.col("impact") * 0.4 + (1 - F.col("risk")) * 0.2
             + (1 - F.least(F.col("hours") / 24, F.lit(1.0))) * 0.1) * F.col("confidence")
    ranked = best_per(each.withColumn("score", F.round(score, _DIGITS)), ["query_id"],
                      [F.desc("score"), F.asc("solution"), F.asc("cause")], k)
    band = F.when(F.col("score") > 0.7, "高").when(F.col("score") > 0.5, "中").otherwise("低")
    return ranked.withColumn("priority", band)


def recommendations(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Best solution with its risk band, three alternatives, success metrics by symptom class."""
    risk = None
    for bound, text in R.RISK_BANDS:
        test = F.col("risk") > bound
        risk = F.when(test, text) if risk is None else risk.when(test, text)
    best = ranked.filter("rank = 1").select("query_id", F.col("solution").alias("recommendation"),
                                            F.col("score").alias("confidence"), risk.alias("risk_assessment"))
    # three rows per question at most
    rest = ranked.filter(F.col("rank").between(2, 4)).groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "solution"))), lambda r: r["solution"]), "|")
        .alias("alternatives"))
    kind = Q.symptom_category(F.col("query"))
    metrics = F.lit("|".join(R.SUCCESS_METRICS[""]))
    for name in ("performance", "availability"):
        metrics = F.when(kind == name, "|".join(R.SUCCESS_METRICS[name])).otherwise(metrics)
    return questions.select("query_id", metrics.alias("success_metrics")).join(best, "query_id").join(rest, "query_id", "left")


def key_information(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """Titles (5), solutions (3), practices (3), related topics and confidence per question.

    ``hits``: query_id, title, content of the found documents; ``entities``: query_id, name, type.
    """
    from opsloom.functions.documents import practice_snippet, solution_snippet

    low, x = F.lower("content"), F.col("content")
    rows = hits.select(
        "query_id", F.nullif("title", F.lit("")).alias("point"),
        F.when(x.contains("解决方案") | low.contains("solution"), solution_snippet(x)).alias("solution"),
        F.when(x.contains("最佳实践") | low.contains("best practice"), practice_snippet(x)).alias("practice"))
    out = hits.groupBy("query_id").agg(F.count("*").alias("documents"))
    for name, n in (("point", 5), ("solution", 3), ("practice", 3)):
        few = best_per(rows.filter(F.col(name).isNotNull()).select("query_id", name).distinct(), ["query_id"],
                       [F.asc(name)], n, "n")
        out = out.join(few.groupBy("query_id").agg(F.array_sort(F.collect_list(name)).alias(f"{name}s")), "query_id", "left")
    topics = best_per(entities, ["query_id"], [F.asc("name"), F.asc("type")], 5, "n").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.concat("name", F.lit(" ("), "type", F.lit(")")))).alias("topics"))
    both = out.join(topics, "query_id", "full_outer")
    sure = F.least(F.lit(0.8), F.coalesce("documents", F.lit(0)) * 0.2)
    return both.withColumn("confidence", F.round(F.when(F.col("topics").isNotNull(), F.greatest(sure, F.lit(0.6)))
                                                 .otherwise(sure), 6))


def first_recommendations(evidence: DataFrame) -> DataFrame:
    """What to do first, from the number of ERROR rows, documents and entities found per question."""
    kind = F.col("result_type")
    n = evidence.groupBy("query_id").agg(
        F.sum(F.when((kind == "log") & (F.col("log_level") == "ERROR"), 1).otherwise(0)).alias("errors"),
        F.sum(F.when(kind == "knowledge", 1).otherwise(0)).alias("documents"),
        F.sum(F.when(kind == "entity", 1).otherwise(0)).alias("entities"))
    def row(name, action, priority):
        return F.when(F.col(name) > 0, F.struct(F.lit(action).alias("action"), F.lit(priority).alias("priority"),
                                                F.col(name).alias("found")))
    return n.select("query_id", F.inline(F.array_compact(F.array(
        row("errors", "检查错误日志", "high"), row("documents", "参考相关文档", "medium"),
        row("entities", "检查相关组件", "medium")))))
