"""Log preparation: parse raw lines and enrich them, all as column expressions.

Both jobs are narrow: no shuffle, batch or stream alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions.text import any_of, distinct_sorted, first_group, first_match, strip, words_found

_SEP = "\u001f"
_FIELDS = ("ts", "level", "thread", "service", "ip", "component", "message")


def _split_layouts(line: Column, layouts, fields=_FIELDS) -> Column:
    """Array [layout, field, ...] of the first layout that matches, else null.

    Each layout runs one match and one replace; all fields come out of that one
    replace. The free-text field is last, so a separator inside it stays there.
    """
    chosen = None
    for name, pattern, groups in layouts:
        body = _SEP.join([name] + [f"${groups.index(f) + 1}" if f in groups else "" for f in fields])
        hit, value = line.rlike(pattern), F.regexp_replace(line, pattern, body)
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return F.split(chosen, _SEP, len(fields) + 1)


def _utc(text: Column) -> Column:
    """Timestamp of an ISO text; no zone means UTC; null when unreadable."""
    iso = F.translate(text, ",", ".")
    return F.try_to_timestamp(F.when(iso.endswith("Z"), iso).otherwise(F.concat(iso, F.lit("Z"))))


def keep_lines(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """Strip the lines, drop blank ones and ``#`` comments."""
    # filter on the line as read, so that pushing the filter down does not copy the strip
    return df.filter(~F.col(line).rlike(r"^\s*(#|$)")).withColumn(line, strip(F.col(line)))


def parse_lines(df: DataFrame, as_of: Column) -> DataFrame:
    """First layout: one row per line with level, service, host, message.

    Needs ``raw_line``, ``line_number``, ``log_file``. A line no layout fits is
    kept with level UNKNOWN and the time ``as_of``.
    """
    file = F.lower(F.col("log_file"))
    parts = F.col("_parts")
    service = F.nullif(parts[4], F.lit(""))
    by_file = first_match(file, [(token, name) for token, name, _ in R.FILE_HOSTS])
    host = first_match(file, [(token, name) for token, _, name in R.FILE_HOSTS])
    return (
        keep_lines(df)
        .withColumn("_parts", _split_layouts(F.col("raw_line"), R.LINE_LAYOUTS))
        .withColumns({
            "timestamp": F.coalesce(_utc(parts[1]), as_of),
            "level": F.coalesce(parts[2], F.lit("UNKNOWN")),
            "service_name": F.when(parts.isNull(), F.lit("unknown"))
            .otherwise(F.coalesce(service, by_file, F.lit(""))),
            "hostname": F.when(parts.isNull(), F.lit("unknown")).otherwise(F.coalesce(host, F.lit("unknown"))),
            "message": F.coalesce(parts[7], F.col("raw_line")),
            "pattern_used": F.coalesce(parts[0], F.lit("fallback")),
        })
        .drop("_parts")
    )


def made_up_ip(service: Column) -> Column:
    """Stable address for a service without one."""
    number = F.conv(F.substring(F.md5(service), 1, 8), 16, 10).cast("bigint")
    return F.concat(F.lit("10.1.0."), (F.pmod(number, F.lit(254)) + 1).cast("string"))


def parse_entries(df: DataFrame, as_of: Column, formats: str = "standard") -> DataFrame:
    """Second layout: the log_entry table.

    ``formats='standard'`` keeps a line that fits nothing as an INFO row of the
    service ``unknown``; ``formats='extended'`` knows four more layouts and
    drops what still does not fit.
    """
    extended = formats == "extended"
    layouts = R.ENTRY_LAYOUTS + (R.EXTENDED_LAYOUTS if extended else [])
    parts = F.col("_parts")

    def field(name: str) -> Column:
        return F.nullif(parts[_FIELDS.index(name) + 1], F.lit(""))

    parsed = keep_lines(df).withColumn("_parts", _split_layouts(F.col("raw_line"), layouts))
    if extended:
        parsed = parsed.filter(parts.isNotNull())
    service = F.coalesce(field("service"), F.lit("unknown"))
    message = F.coalesce(parts[7], F.col("raw_line"))
    return (
        parsed.withColumns({"service_name": service, "message": message})
        .withColumns({
            "timestamp": F.coalesce(_utc(field("ts")), as_of),
            "log_level": F.coalesce(F.upper(field("level")), F.lit("INFO")),
            "host_name": F.concat(F.col("service_name"), F.lit("-host")),
            "host_ip": F.when(parts.isNull(), F.lit("10.1.0.1")).otherwise(F.coalesce(
                field("ip"), first_group(F.col("message"), R.DOTTED_QUAD), made_up_ip(F.col("service_name")))),
            "component": field("component"),
            "thread_id": field("thread"),
            "layout": F.coalesce(parts[0], F.lit("fallback")),
        })
        .drop("_parts")
    )


def message_fields(df: DataFrame, message: str = "message") -> DataFrame:
    """Request id, error code, duration, metrics and topic tags of each message.

    A row that only fell back (layout ``fallback``) keeps empty fields.
    """
    text, low = F.col(message), F.col("_low")
    parsed = F.col("layout") != "fallback" if "layout" in df.columns else F.lit(True)
    has_memory = parsed & low.contains("memory")
    memory = first_group(text, R.MEMORY_SIZE, 1, has_memory).cast("double")
    unit = F.when(F.lower(F.regexp_extract(text, R.MEMORY_SIZE, 2)) == "gb", 1024.0).otherwise(1.0)
    out = df.withColumn("_low", F.lower(text)).withColumns({
        "request_id": first_group(text, R.REQUEST_ID, 1, parsed & low.contains("request")),
        "error_code": first_group(text, R.ERROR_CODE, 1, parsed & low.contains("error")),
        "duration_ms": first_group(text, R.DURATION_MS, 1, parsed & text.contains("ms")).cast("double"),
        "cpu_percent": first_group(text, R.CPU_PERCENT, 1, parsed & low.contains("cpu")).cast("double"),
        "memory_mb": F.when(has_memory, memory * unit),
    })
    performance = [F.when(F.col(c).isNotNull(), F.lit("performance")) for c in ("cpu_percent", "memory_mb")]
    topics = [F.when(any_of(low, words), F.lit(tag)) for tag, words in R.TOPIC_TAGS]
    return out.withColumns({
        "tags": F.when(parsed, F.array_compact(F.array(*performance, *topics)))
        .otherwise(F.array().cast("array<string>")),
        "metadata": F.map_filter(
            F.create_map(F.lit("cpu_percent"), F.col("cpu_percent"), F.lit("memory_mb"), F.col("memory_mb")),
            lambda _, v: v.isNotNull()),
    }).drop("_low")


def message_template(message: Column) -> Column:
    """Message with times, ids and numbers replaced: the key for grouping alike messages."""
    return strip(reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), R.TEMPLATE_STEPS, message))


def is_failure(level: Column) -> Column:
    return level.isin("ERROR", "CRITICAL")


def summary(level: Column, service: Column, text: Column) -> Column:
    """One line on what happened; ``text`` is the lowered message, here and below."""
    issue = F.coalesce(*[F.when(any_of(text, words), F.lit(end)) for words, end in R.SUMMARY_RULES],
                       F.lit(" reported an error condition"))
    return F.concat(service, F.when(is_failure(level), issue)
                    .when(level == "WARN", " has warning condition").otherwise(" normal operation log"))


def category(level: Column, text: Column) -> Column:
    issue = F.coalesce(*[F.when(any_of(text, words), F.lit(name)) for words, name in R.CATEGORY_RULES],
                       F.lit("application_error"))
    return (F.when(is_failure(level), issue).when(level == "WARN", "warning")
            .when(any_of(text, ["start", "init"]), "system_event").otherwise("normal_operation"))


def severity(level: Column, text: Column) -> Column:
    """Score 0..1: base by level plus word bonuses, capped, two decimals."""
    base = F.coalesce(*[F.when(level == name, F.lit(score)) for name, score in R.LEVEL_SEVERITY.items()], F.lit(0.1))
    total = base
    for word, bonus in R.SEVERITY_BONUS.items():
        total = total + F.when(text.contains(word), F.lit(bonus)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), total), 2)


def embedding_text(service: Column, level: Column, component: Column, message: Column, tags: Column) -> Column:
    """Labelled parts joined by `` | ``; missing parts are left out."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Service: "), service),
        F.concat(F.lit("Level: "), level),
        F.concat(F.lit("Component: "), component),
        F.concat(F.lit("Message: "), message_template(message)),
        F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))),
    )


def keywords(text: Column) -> Column:
    numbers = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda v: F.concat(F.lit("metric_"), v))
               for p in R.LOG_METRICS]
    return distinct_sorted(words_found(text, R.LOG_KEYWORDS), *numbers)


def pattern_entities(text: Column, patterns: list[str], prefix: str) -> Column:
    """All matches of some patterns, each with a prefix."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    return F.transform(F.concat(*found), lambda v: F.concat(F.lit(prefix), v))


def entities(text: Column) -> Column:
    return distinct_sorted(pattern_entities(text, R.LOG_SERVICES, "service:"),
                           words_found(text, R.LOG_TECH, "tech:"))


def enrich_entries(df: DataFrame) -> DataFrame:
    """Summary, category, severity, embedding text, keywords and entities of log entries."""
    level, service, message, text = F.col("log_level"), F.col("service_name"), F.col("message"), F.col("_low")
    return df.withColumn("_low", F.lower(message)).withColumns({
        "content": embedding_text(service, level, F.col("component"), message, F.col("tags")),
        "summary": summary(level, service, text),
        "category": category(level, text),
        "severity_score": severity(level, text),
        "keywords": keywords(text),
        "entities": entities(text),
    }).drop("_low")


def log_entries(df: DataFrame, as_of: Column, formats: str = "standard") -> DataFrame:
    """Raw lines to enriched entries in one narrow stage."""
    return enrich_entries(message_fields(parse_entries(df, as_of, formats)))


def file_facts(name: Column) -> Column:
    """Incident id, problem type and service that an incident file name carries."""
    pieces = F.split(F.replace(name, F.lit(".log"), F.lit("")), "_")
    return F.struct(
        F.coalesce(F.concat(F.lit("INC-"), F.try_element_at(pieces, F.lit(2))), F.lit("INC-UNKNOWN"))
        .alias("incident_id"),
        F.coalesce(first_match(name, R.FILE_PROBLEMS), F.lit("unknown")).alias("problem_type"),
        F.coalesce(first_match(name, R.FILE_SERVICES), F.lit("unknown")).alias("primary_service"),
    )


def parse_foreign(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """Access log, web-server error log, JSON line and syslog; the rest stays raw as ``unknown``."""
    fields = ("timestamp", "ip", "method", "path", "protocol", "status", "size", "level", "pid", "tid",
              "hostname", "program", "message")
    parts = F.col("_parts")
    out = df.withColumn("_parts", _split_layouts(strip(F.col(line)), R.FOREIGN_LAYOUTS, fields))
    columns = {"format_type": F.coalesce(parts[0], F.lit("unknown"))}
    columns.update({f: F.nullif(parts[i + 1], F.lit("")) for i, f in enumerate(fields)})
    json = F.when(parts[0] == "application_json", F.col(line))
    columns["level"] = F.coalesce(columns["level"], F.get_json_object(json, "$.level"))
    columns["message"] = F.coalesce(columns["message"], F.get_json_object(json, "$.message"))
    columns["timestamp"] = F.coalesce(columns["timestamp"], F.get_json_object(json, "$.timestamp"))
    return out.withColumns(columns).drop("_parts")
