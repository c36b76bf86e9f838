"""Columns that describe a table of questions: filters, class, type, priority, symptoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions.text import any_of, first_match, words_found


def context_filters(query: Column, as_of: Column) -> dict[str, Column]:
    """Search filters that the question text implies."""
    low = F.lower(query)
    recent = query.contains(R.RECENT_WORD)
    return {
        "filter_service": first_match(low, [(s, s) for s in R.CONTEXT_SERVICES]),
        "filter_level": first_match(low, [(w, w.upper()) for w in R.CONTEXT_LEVELS]),
        "filter_host": first_match(low, [(h, h) for h in R.CONTEXT_HOSTS]),
        "filter_from": F.when(recent, as_of - F.expr("interval 24 hours")),
        "filter_to": F.when(recent, as_of),
    }


def is_incident_question(query: Column) -> Column:
    return any_of(F.lower(query), R.INCIDENT_QUESTION_WORDS)


def _ladder(text: Column, patterns, default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def problem_type(query: Column) -> Column:
    return _ladder(query, R.PROBLEM_TYPES, "general")


def priority(query: Column) -> Column:
    return _ladder(F.lower(query), R.PRIORITY_PATTERNS, "low")


def complexity(query: Column) -> Column:
    return _ladder(F.lower(query), R.COMPLEXITY_PATTERNS, "low")


def classify_requests(df: DataFrame, as_of: Column, query: str = "query") -> DataFrame:
    """Filters, class, problem type, keywords, priority and complexity of each question."""
    text = F.col(query)
    return df.withColumns({
        **context_filters(text, as_of),
        "is_incident": is_incident_question(text),
        "problem_type": problem_type(text),
        "request_keywords": words_found(F.lower(text), R.REQUEST_WORDS),
        "priority": priority(text),
        "complexity": complexity(text),
    })


def symptom_rows(df: DataFrame, query: str = "query") -> DataFrame:
    """One row per (question, symptom keyword) of the keyword table."""
    low = F.lower(F.col(query))
    found = F.array_compact(F.array(*[
        F.when(low.contains(word), F.struct(F.lit(kind).alias("symptom_type"), F.lit(word).alias("keyword"),
                                            F.lit(0.8).alias("confidence")))
        for kind, words in R.SYMPTOM_WORDS for word in words]))
    return df.select("*", F.inline(found))


def question_symptoms(query: Column) -> Column:
    """Array of (type, symptom, severity) named by the question."""
    low = F.lower(query)
    return F.array_compact(F.array(*[
        F.when(low.contains(word), F.struct(F.lit(kind).alias("type"), F.lit(symptom).alias("symptom"),
                                            F.lit(level).alias("severity")))
        for word, kind, symptom, level in R.QUESTION_SYMPTOMS]))


def symptom_severity(query: Column) -> Column:
    low = F.lower(query)
    return (F.when(any_of(low, R.HIGH_SEVERITY_WORDS), "high")
            .when(any_of(low, R.MEDIUM_SEVERITY_WORDS), "medium").otherwise("low"))


def symptom_category(query: Column) -> Column:
    low = F.lower(query)
    words = dict(R.SYMPTOM_WORDS)
    return (F.when(any_of(low, words["performance"]), "performance").when(any_of(low, words["error"]), "functional")
            .when(any_of(low, words["availability"]), "availability").otherwise("general"))
