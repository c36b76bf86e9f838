"""Named queries over log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions import logs as L
from opsloom.functions.text import normalize_service, text_key
from opsloom.operators.filters import made_once, search_filter
from opsloom.plans import bindings as B
from opsloom.plans.sqltext import any_like, bonus_sum, chain, found_list, quote, ts_text

c = F.col


def as_of():
    return F.lit(B.AS_OF).cast("timestamp")


def _fmt(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSS")


# ------------------------------------------------------------------ SQL building blocks
_STRIP = r"regexp_replace(raw_line, '^\s+|\s+$', '', 'g')"


def _layout_sql(layouts) -> str:
    """CTE body: layout name and fields per line."""
    fields = ("ts", "level", "thread", "service", "ip", "component", "message")
    arms = []
    for name, pattern, groups in layouts:
        parts = [f"'{name}'"] + [
            f"regexp_extract(line, {quote(pattern)}, {groups.index(f) + 1})" if f in groups else "''" for f in fields]
        arms.append(f"when regexp_matches(line, {quote(pattern)}) then [{', '.join(parts)}]")
    return (f"select *, case {' '.join(arms)} end as p from (select *, {_STRIP} as line from v_log_line) "
            "where not regexp_matches(line, '^(#|$)')")


LINES_SQL = f"""{B.LOG_LINES},
parts as ({_layout_sql(R.LINE_LAYOUTS)}),
lines as (select line_number, log_file, line as raw_line,
  coalesce({ts_text('p[2]')}, '2024-02-01 00:00:00.000') as ts_text,
  coalesce(p[3], 'UNKNOWN') as level,
  case when p is null then 'unknown' else coalesce(nullif(p[5], ''),
    case when contains(lower(log_file), 'service_b') then 'service-b'
         when contains(lower(log_file), 'service_a') then 'service-a' else '' end) end as service_name,
  case when p is null then 'unknown' when contains(lower(log_file), 'service_b') then 'd1-app-01'
       when contains(lower(log_file), 'service_a') then 'd1-app-02' else 'unknown' end as hostname,
  coalesce(p[8], line) as message, coalesce(p[1], 'fallback') as pattern_used from parts)"""

_IP = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"


def _entries_sql(layouts, extended: bool = False, lines: str = B.LOG_LINES) -> str:
    keep = "where p is not null" if extended else ""
    return f"""{lines},
parts as ({_layout_sql(layouts)}),
raw_entries as (select *, coalesce(nullif(p[5], ''), 'unknown') as service_name,
  coalesce(p[8], line) as message from parts {keep}),
entries as (select line_number, ts, user_id, value, coalesce(p[1], 'fallback') as layout, service_name, message,
  coalesce({ts_text('p[2]')}, '2024-02-01 00:00:00.000') as ts_text,
  coalesce(upper(nullif(p[3], '')), 'INFO') as log_level, concat(service_name, '-host') as host_name,
  case when p is null then '10.1.0.1' else coalesce(nullif(p[6], ''), nullif(regexp_extract(message, '{_IP}', 1), ''),
    concat('10.1.0.', cast(concat('0x', substr(md5(service_name), 1, 8)) as bigint) % 254 + 1)) end as host_ip,
  nullif(p[7], '') as component, nullif(p[4], '') as thread_id from raw_entries)"""


ENTRIES_SQL = _entries_sql(R.ENTRY_LAYOUTS)


def _opt(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(message, {quote(pattern)}, {group}), '')"


_TAGS = ", ".join(
    [f"case when {any_like('lower(message)', words)} then '{tag}' end" for tag, words in R.TOPIC_TAGS])
FIELDS_SQL = f"""{ENTRIES_SQL},
numbers as (select *, layout <> 'fallback' as ok, {_opt(R.REQUEST_ID)} as rid, {_opt(R.ERROR_CODE)} as ecode,
  cast({_opt(R.DURATION_MS)} as double) as dur, cast({_opt(R.CPU_PERCENT)} as double) as cpu,
  cast({_opt(R.MEMORY_SIZE)} as double) *
    case when upper({_opt(R.MEMORY_SIZE, 2)}) = 'GB' then 1024.0 else 1.0 end as mem from entries),
fields as (select *, case when ok then rid end as request_id, case when ok then ecode end as error_code,
  case when ok then dur end as duration_ms, case when ok then cpu end as cpu_percent,
  case when ok then mem end as memory_mb,
  case when ok then list_filter([case when cpu is not null then 'performance' end,
    case when mem is not null then 'performance' end, {_TAGS}], lambda x: x is not null)
    else cast([] as varchar[]) end as tags from numbers)"""

_TEMPLATE = chain("message", R.TEMPLATE_STEPS)
_TEMPLATE = rf"regexp_replace({_TEMPLATE}, '^\s+|\s+$', '', 'g')"


def _cases(rules, default, text="lower(message)"):
    return "case " + " ".join(f"when {any_like(text, w)} then {quote(v)}" for w, v in rules) + f" else '{default}' end"


_SUMMARY = (f"concat(service_name, case when log_level in ('ERROR', 'CRITICAL') then "
            f"{_cases(R.SUMMARY_RULES, ' reported an error condition')} "
            "when log_level = 'WARN' then ' has warning condition' else ' normal operation log' end)")
_CATEGORY = (f"case when log_level in ('ERROR', 'CRITICAL') then {_cases(R.CATEGORY_RULES, 'application_error')} "
             "when log_level = 'WARN' then 'warning' when contains(lower(message), 'start') or "
             "contains(lower(message), 'init') then 'system_event' else 'normal_operation' end")
_BASE = "case log_level " + " ".join(f"when '{k}' then cast({v} as double)" for k, v in R.LEVEL_SEVERITY.items())
_SEVERITY = (f"round(least(cast(1.0 as double), {_BASE} else cast(0.1 as double) end + "
             f"{bonus_sum('lower(message)', R.SEVERITY_BONUS)}), 2)")
_CONTENT = (f"concat_ws(' | ', concat('Service: ', service_name), concat('Level: ', log_level), "
            f"case when component is not null then concat('Component: ', component) end, "
            f"concat('Message: ', {_TEMPLATE}), "
            "case when len(tags) > 0 then concat('Tags: ', array_to_string(tags, ', ')) end)")
_METRICS = [f"list_transform(regexp_extract_all(lower(message), {quote(p)}, 1), lambda v: concat('metric_', v))"
            for p in R.LOG_METRICS]


def sorted_list(*lists: str) -> str:
    """SQL text: distinct values of several lists, sorted."""
    joined = lists[0]
    for more in lists[1:]:
        joined = f"list_concat({joined}, {more})"
    return f"list_sort(list_distinct({joined}))"


_KEYWORDS = sorted_list(found_list("lower(message)", R.LOG_KEYWORDS), *_METRICS)
_ENTITIES = sorted_list(
    *[f"list_transform(regexp_extract_all(lower(message), '{p}'), lambda v: concat('service:', v))"
      for p in R.LOG_SERVICES],
    found_list("lower(message)", R.LOG_TECH, "tech:"))
DERIVED_SQL = f"""{FIELDS_SQL},
derived as (select *, {_SUMMARY} as summary, {_CATEGORY} as category, {_SEVERITY} as severity_score,
  {_CONTENT} as content, array_to_string({_KEYWORDS}, ',') as keywords,
  array_to_string({_ENTITIES}, ',') as entities from fields)"""


# ------------------------------------------------------------------ queries
def parsed_lines(spark, d):
    return L.parse_lines(B.log_lines(spark, d), as_of())


def entries(spark, d):
    return L.message_fields(L.parse_entries(B.log_lines(spark, d), as_of()))


def enriched(spark, d):
    return L.log_entries(B.log_lines(spark, d), as_of())


def parse_first_layout(spark, d):
    return parsed_lines(spark, d).select(
        "line_number", "log_file", _fmt("timestamp").alias("ts_text"), "level", "service_name", "hostname",
        "message", "pattern_used")


def parse_second_layout(spark, d):
    return L.parse_entries(B.log_lines(spark, d), as_of()).select(
        "line_number", "layout", _fmt("timestamp").alias("ts_text"), "service_name", "host_ip", "host_name",
        "log_level", "message", "component", "thread_id")


_EXT = {
    "spark": "case event_id % 4 when 0 then concat({t}, 'Z [INFO ] service-', chr(cast(97 + user_id % 6 as int)),"
             " ' thread-pool-', event_id % 9, ': Processing request from 10.1.0.', event_id % 200)"
             " when 1 then concat({t}, 'Z service-', chr(cast(97 + user_id % 6 as int)),"
             " ' ERROR: Database connection failed')"
             " when 2 then concat({b}, ',', substr({t}, 21, 3), ' service-f WARNING payment_module: API slow ',"
             " event_id) else concat('no layout at all ', event_id) end",
}


def _extended_lines(spark, d):
    ev = B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = _EXT["spark"].format(t="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")",
                                b="date_format(ts, 'yyyy-MM-dd HH:mm:ss')")
    return ev.selectExpr(f"{text} as raw_line", "event_id as line_number", "'app.log' as log_file")


_EXT_SQL = "v_log_line as (select {} as raw_line, event_id as line_number, ts, user_id, value from events)".format(
    _EXT["spark"].format(t="strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')", b="strftime(ts, '%Y-%m-%d %H:%M:%S')"))


def parse_extended_layouts(spark, d):
    return L.parse_entries(_extended_lines(spark, d), as_of(), "extended").select(
        "line_number", "layout", _fmt("timestamp").alias("ts_text"), "service_name", "log_level", "message",
        "component", "thread_id", "host_ip")


def message_field_extraction(spark, d):
    return entries(spark, d).select(
        "line_number", "request_id", "error_code", "duration_ms", "cpu_percent", "memory_mb",
        F.array_join("tags", ",").alias("tags"))


def template_counts(spark, d):
    return (L.parse_entries(B.log_lines(spark, d), as_of())
            .groupBy(L.message_template(F.col("message")).alias("template"))
            .agg(F.count("*").alias("n"), F.min("line_number").alias("first_line")))


def embedding_rows(spark, d):
    return enriched(spark, d).select("line_number", "content", "summary", "category", "severity_score")


def keyword_entity_arrays(spark, d):
    return enriched(spark, d).select("line_number", F.array_join("keywords", ",").alias("keywords"),
                                     F.array_join("entities", ",").alias("entities"))


def service_health(spark, d):
    """Flagship: per service ERROR, WARN and total, mean severity, top category."""
    e = enriched(spark, d)
    per_category = e.groupBy("service_name", "category").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("log_level") == "ERROR", 1).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("log_level") == "WARN", 1).otherwise(0)).alias("warnings"),
        F.sum("severity_score").alias("severity"))
    return per_category.groupBy("service_name").agg(
        F.sum("n").alias("total"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"),
        F.round(F.sum("severity") / F.sum("n"), 6).alias("mean_severity"),
        F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("top_category"))


SERVICE_HEALTH_SQL = f"""with {DERIVED_SQL},
cat as (select service_name, category, count(*) as n, sum(severity_score) as s,
  sum(case when log_level = 'ERROR' then 1 else 0 end) as e,
  sum(case when log_level = 'WARN' then 1 else 0 end) as w from derived group by 1, 2)
select service_name, cast(sum(n) as bigint) as total, cast(sum(e) as bigint) as errors,
  cast(sum(w) as bigint) as warnings, round(sum(s) / sum(n), 6) as mean_severity,
  first(category order by n desc, category) as top_category from cat group by 1"""


def log_profile(spark, d):
    """Counts of one log: lines, parsed, severe rows, services, and by level and category."""
    e = enriched(spark, d)
    counts = e.groupBy("log_level", "category", "layout", "service_name").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("severity_score") > 0.7, 1).otherwise(0)).alias("severe"))
    return counts.groupBy("log_level", "category").agg(
        F.sum("n").alias("lines"), F.sum(F.when(F.col("layout") != "fallback", F.col("n")).otherwise(0)).alias("parsed"),
        F.sum("severe").alias("severe"), F.countDistinct("service_name").alias("services"))


def incident_file_facts(spark, d):
    files = B.log_lines(spark, d).groupBy("log_file").agg(F.count("*").alias("lines"))
    return files.select("log_file", "lines", L.file_facts(F.col("log_file")).alias("f")).select(
        "log_file", "lines", "f.*")


def incident_log_rows(spark, d):
    """Rows of incident files: facts of the file added to tags and metadata."""
    facts = L.file_facts(F.col("log_file"))
    rows = parsed_lines(spark, d).filter(F.col("log_file").rlike(r"^incident_.*\.log$")).withColumn("f", facts)
    tags = F.concat(F.array("f.incident_id", "f.problem_type", F.concat(F.lit("service:"), F.col("f.primary_service"))),
                    L.keywords(F.lower("message")))
    return rows.select(
        F.format_string("incident_%s_%d", F.col("f.incident_id"), F.col("line_number")).alias("source_id"),
        F.format_string("[%s] %s", F.col("level"), F.col("service_name")).alias("title"),
        F.array_join(tags, ",").alias("tags"), "f.incident_id", "f.problem_type")


_FACTS = """concat('INC-', split_part(replace(log_file, '.log', ''), '_', 2)) as incident_id,
  case when contains(log_file, 'cpu') then 'cpu_overload' when contains(log_file, 'disk') then 'disk_io_bottleneck'
    when contains(log_file, 'network') then 'network_partition' when contains(log_file, 'memory') then 'memory_leak'
    else 'unknown' end as problem_type,
  case when contains(log_file, 'service_a') then 'service-a' when contains(log_file, 'service_b') then 'service-b'
    when contains(log_file, 'service_c') then 'service-c' else 'unknown' end as primary_service"""

_FOREIGN = {
    "text": "case event_id % 5 when 0 then concat('10.0.', user_id % 200, '.', event_id % 250, ' - - [', {apache},"
            " '] \"GET /', event_type, '/', event_id, ' HTTP/1.1\" ', 200 + (event_id % 3) * 100, ' ', event_id)"
            " when 1 then concat({nginx}, ' [error] ', event_id % 99, '#', user_id, ': upstream timed out ', event_id)"
            " when 2 then concat('{{\"level\": \"WARN\", \"message\": \"m ', event_id, '\", \"timestamp\": \"', {iso}, '\"}}')"
            " when 3 then concat({sys}, ' host-', user_id, ' sshd[', event_id, ']: accepted key ', event_id)"
            " else concat('free text ', event_id) end",
}


def foreign_layouts(spark, d):
    ev = B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = _FOREIGN["text"].format(
        apache="date_format(ts, 'dd/MM/yyyy:HH:mm:ss')", nginx="date_format(ts, 'yyyy/MM/dd HH:mm:ss')",
        iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", sys="date_format(ts, 'MMM dd HH:mm:ss')")
    return L.parse_foreign(ev.selectExpr(f"{text} as raw_line", "event_id as line_number")).select(
        "line_number", "format_type", "timestamp", "ip", "method", "path", "status", "level", "hostname", "program",
        "message")


def _foreign_sql():
    text = _FOREIGN["text"].format(
        apache="strftime(ts, '%d/%m/%Y:%H:%M:%S')", nginx="strftime(ts, '%Y/%m/%d %H:%M:%S')",
        iso="strftime(ts, '%Y-%m-%dT%H:%M:%S')", sys="strftime(ts, '%b %d %H:%M:%S')")
    spec = {name: (pattern, groups) for name, pattern, groups in R.FOREIGN_LAYOUTS}

    def pick(field):
        arms = [f"when '{n}' then regexp_extract(raw_line, {quote(p)}, {g.index(field) + 1})"
                for n, (p, g) in spec.items() if field in g]
        extra = (f" when 'application_json' then json_extract_string(raw_line, '$.{field}')"
                 if field in ("level", "message", "timestamp") else "")
        return f"case format_type {' '.join(arms)}{extra} end as {field}"

    kinds = " ".join(f"when regexp_matches(raw_line, {quote(p)}) then '{n}'" for n, (p, _) in spec.items())
    names = ("timestamp", "ip", "method", "path", "status", "level", "hostname", "program", "message")
    return (f"with raw as (select {text} as raw_line, event_id as line_number from events), "
            f"kind as (select *, case {kinds} else 'unknown' end as format_type from raw) "
            f"select line_number, format_type, {', '.join(pick(f) for f in names)} from kind")


def service_name_forms(spark, d):
    ev = B.table(spark, d, "events")
    forms = ev.select(F.expr(
        "concat(element_at(array('Service ', 'service_', 'SERVICE-', 'service'), cast(event_id % 4 + 1 as int)),"
        " chr(cast(65 + user_id % 6 as int)), user_id % 3)").alias("name"))
    return forms.groupBy(normalize_service(F.col("name")).alias("service")).agg(F.count("*").alias("n"))


def flat_log_rows(spark, d):
    """Flat loader: lines of the strict layout as ``[LEVEL] service: message`` with four keyword rules."""
    rows = parsed_lines(spark, d).filter((c("pattern_used") == "standard") & c("log_file").endswith(".log"))
    low = F.lower("message")
    words = F.array_compact(F.array(
        F.when(c("message").contains("CPU"), F.lit("CPU")), F.when(low.contains("error"), F.lit("error")),
        F.when(low.contains("timeout"), F.lit("timeout")), F.nullif("service_name", F.lit(""))))
    return rows.select("line_number", F.format_string("[%s] %s: %s", "level", "service_name", "message").alias("content"),
                       F.array_join(words, ",").alias("keywords"))


def filtered_entries(spark, d):
    """Closed time range, services and levels in one filter over parsed entries."""
    e = made_once(enriched(spark, d).select("line_number", "service_name", "log_level", "severity_score", "timestamp"))
    kept = e.filter(search_filter(service=["service-a", "service-b"], level=["ERROR", "WARN"],
                                  times=(F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))))
    return kept.select("line_number", "service_name", "log_level", "severity_score")


def text_keys(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text_key(F.col("text")).alias("text_md5"))


def keyword_filtered(spark, d):
    """Entries that share a keyword with the asked ones, per service and level."""
    made = made_once(enriched(spark, d).select("service_name", "log_level", "line_number", "keywords"))
    rows = made.filter(search_filter(level=["ERROR", "WARN", "INFO"], keywords=R.LOG_KEYWORDS[:3]))
    return rows.groupBy("service_name", "log_level").agg(F.count("*").alias("n"), F.min("line_number").alias("first_line"))


_ASKED = "[" + ", ".join(quote(k) for k in R.LOG_KEYWORDS[:3]) + "]"
KEYWORD_SQL = f"""with {DERIVED_SQL} select service_name, log_level, count(*) as n, min(line_number) as first_line from derived
  where log_level in ('ERROR', 'WARN', 'INFO') and list_has_any(string_split(keywords, ','), {_ASKED}) group by 1, 2"""


QUERIES = {
    "keyword_filtered": (keyword_filtered, KEYWORD_SQL),
    "log_parse_first_layout": (parse_first_layout, f"with {LINES_SQL} select line_number, log_file, ts_text, level, "
                               "service_name, hostname, message, pattern_used from lines"),
    "log_parse_second_layout": (parse_second_layout, f"with {ENTRIES_SQL} select line_number, layout, ts_text, "
                                "service_name, host_ip, host_name, log_level, message, component, thread_id "
                                "from entries"),
    "log_parse_extended_layouts": (parse_extended_layouts, "with " + _entries_sql(
        R.ENTRY_LAYOUTS + R.EXTENDED_LAYOUTS, True, _EXT_SQL) + " select line_number, layout, ts_text, service_name, "
        "log_level, message, component, thread_id, host_ip from entries"),
    "log_message_fields": (message_field_extraction, f"with {FIELDS_SQL} select line_number, request_id, error_code, "
                           "duration_ms, cpu_percent, memory_mb, array_to_string(tags, ',') as tags from fields"),
    "log_template_counts": (template_counts, f"with {ENTRIES_SQL} select {_TEMPLATE} as template, count(*) as n, "
                            "min(line_number) as first_line from entries group by 1"),
    "log_embedding_rows": (embedding_rows, f"with {DERIVED_SQL} select line_number, content, summary, category, "
                           "severity_score from derived"),
    "log_keywords_entities": (keyword_entity_arrays,
                              f"with {DERIVED_SQL} select line_number, keywords, entities from derived"),
    "log_service_health": (service_health, SERVICE_HEALTH_SQL),
    "log_profile": (log_profile, f"""with {DERIVED_SQL} select log_level, category, count(*) as lines,
      cast(sum(case when layout <> 'fallback' then 1 else 0 end) as bigint) as parsed,
      cast(sum(case when severity_score > 0.7 then 1 else 0 end) as bigint) as severe,
      count(distinct service_name) as services from derived group by 1, 2"""),
    "incident_file_facts": (incident_file_facts, f"with {B.LOG_LINES} select log_file, count(*) as lines, {_FACTS} "
                            "from v_log_line group by log_file"),
    "incident_log_rows": (incident_log_rows, f"""with {LINES_SQL}, f as (select *, {_FACTS} from lines)
      select concat('incident_', incident_id, '_', line_number) as source_id,
      concat('[', level, '] ', service_name) as title,
      array_to_string(list_concat([incident_id, problem_type, concat('service:', primary_service)],
        {_KEYWORDS}), ',') as tags, incident_id, problem_type from f"""),
    "flat_log_rows": (flat_log_rows, f"""with {LINES_SQL} select line_number, concat('[', level, '] ', service_name, ': ', message)
      as content, array_to_string(list_filter([case when contains(message, 'CPU') then 'CPU' end, case when contains(lower(message),
      'error') then 'error' end, case when contains(lower(message), 'timeout') then 'timeout' end, nullif(service_name, '')],
      lambda x: x is not null), ',') as keywords from lines where pattern_used = 'standard'"""),
    "filtered_entries": (filtered_entries, f"""with {DERIVED_SQL} select line_number, service_name, log_level, severity_score
      from derived where service_name in ('service-a', 'service-b') and log_level in ('ERROR', 'WARN')
      and ts_text between '2024-01-05 00:00:00.000' and '2024-01-20 00:00:00.000'"""),
    "log_foreign_layouts": (foreign_layouts, _foreign_sql()),
    "service_name_normalization": (service_name_forms, r"""with f as (select concat(
      ['Service ', 'service_', 'SERVICE-', 'service'][cast(event_id % 4 + 1 as int)],
      chr(cast(65 + user_id % 6 as int)), user_id % 3) as name from events)
      select regexp_replace(lower(name), 'service[\s_-]*([a-z]\d*)', 'service-\1', 'g') as service, count(*) as n
      from f group by 1"""),
    "text_keys": (text_keys, "select doc_id, md5(text) as text_md5 from documents"),
}
