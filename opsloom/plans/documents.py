"""Named queries over documents, merge requests, tickets and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions import documents as D
from opsloom.functions import privacy as P
from opsloom.functions import requests as Q
from opsloom.functions.text import clip
from opsloom.plans import bindings as B
from opsloom.plans.logs import as_of, sorted_list
from opsloom.plans.sqltext import any_like, found_list, quote
from opsloom.session import spread

c = F.col


def _joined(name):
    return F.array_join(name, ",").alias(name)


# ------------------------------------------------------------------ chunks
def wiki_chunks(spark, d):
    docs = B.documents(spark, d).withColumns({"id": c("doc_id").cast("string"),
                                             "last_updated": F.lit(None).cast("timestamp")})
    return D.wiki_documents(docs, as_of(), end=".").select(
        "source_id", "title", "content", _joined("keywords"), _joined("entities"), "author", "category",
        "chunk_index", "chunk_size", "total_chunks", "parent_id")


_WIKI_KEYS = sorted_list("tags", found_list("lower(chunk)", R.WIKI_TECH_WORDS), found_list("chunk", R.WIKI_OPS_WORDS))
_WIKI_ENTS = sorted_list(*[f"list_transform(regexp_extract_all(lower(chunk), '{p}'), lambda v: concat('service:', v))"
                           for p in R.WIKI_SERVICES], found_list("lower(chunk)", R.WIKI_TECH, "technology:"))
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WIKI_SQL = f"""with recursive {B.DOCUMENTS},
sent as (select doc_id, string_split(content, '.') as s from v_kb where length(content) > 512),
pack as (
  select doc_id, s, 0 as i, '' as open, cast(null as varchar) as done, 0 as n from sent
  union all
  select doc_id, s, i + 1,
    case when length(concat(open, s[i + 1])) <= 512 then concat(open, s[i + 1], '.') else concat(s[i + 1], '.') end,
    case when length(concat(open, s[i + 1])) > 512 and open <> '' then open end,
    n + case when done is not null then 1 else 0 end
  from pack where i < len(s)),
closed as (select doc_id, n as idx, {_TRIM.format('done')} as chunk from pack where done is not null
  union all
  select doc_id, n + case when done is not null then 1 else 0 end, {_TRIM.format('open')} from pack where i = len(s)
  union all select doc_id, 0, content from v_kb where length(content) <= 512),
sized as (select *, count(*) over (partition by doc_id) as total from closed)
select concat('wiki_', doc_id, '_', idx) as source_id,
  case when total > 1 then concat(title, ' (Part ', idx + 1, ')') else title end as title, chunk as content,
  array_to_string({_WIKI_KEYS}, ',') as keywords, array_to_string({_WIKI_ENTS}, ',') as entities, author, category,
  idx as chunk_index, length(chunk) as chunk_size, total as total_chunks, cast(doc_id as varchar) as parent_id
from sized join v_kb using (doc_id)"""


def overlap_chunks(spark, d):
    docs = B.documents(spark, d).select("doc_id", "content")
    return D.chunk_rows(docs, D.pack_with_overlap(c("content"))).select("doc_id", "chunk_index", "chunk")


_SENTENCE = r"[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$"
OVERLAP_SQL = f"""with recursive {B.DOCUMENTS},
sent as (select doc_id, flatten(list_transform(regexp_extract_all(content, '{_SENTENCE}'), lambda x:
  list_transform(range(greatest(1, cast(ceil(length(x) / 512.0) as bigint))), lambda k: substr(x, k * 512 + 1, 512)))) as s from v_kb),
pack as (
  select doc_id, s, 0 as i, '' as open, cast(null as varchar) as done, 0 as n from sent
  union all
  select doc_id, s, i + 1,
    case when length(concat(open, s[i + 1])) <= 512 then concat(open, s[i + 1]) else concat(right(open, 50), s[i + 1]) end,
    case when length(concat(open, s[i + 1])) > 512 and open <> '' then open end,
    n + case when done is not null then 1 else 0 end
  from pack where i < len(s))
select doc_id, n as chunk_index, {_TRIM.format('done')} as chunk from pack where done is not null
union all
select doc_id, n + case when done is not null then 1 else 0 end, {_TRIM.format('open')} from pack
  where i = len(s) and open <> ''"""


def long_overlap_chunks(spark, d):
    """The 1000/100 form: a chunk starts with the end of its own first sentence."""
    docs = B.documents(spark, d).select("doc_id", "content")
    return D.chunk_rows(docs, D.pack_with_overlap(c("content"), 1000, 100, style="sentence")).select("doc_id", "chunk_index", "chunk")


LONG_OVERLAP_SQL = (OVERLAP_SQL.replace("512", "1000").replace("right(open, 50)", "right(s[i + 1], 100)")
                    .replace(_TRIM.format("done"), "done").replace(_TRIM.format("open"), "open"))


# ------------------------------------------------------------------ merge requests and tickets
def change_rows(spark, d):
    return D.change_documents(B.changes(spark, d).withColumns(
        {"author": F.lit("x"), "created_at": as_of()}), as_of()).select(
        "source_id", "title", "content", _joined("keywords"), _joined("entities"))


_LOWTXT = "lower(concat_ws(' ', title, description))"
_SUFFIXES = ", ".join(quote(x) for x in R.CODE_SUFFIXES)
_OWN_FILE = (f"list_filter([case when regexp_extract(lower(p), '[^/]\\.([^./]+)$', 1) in ({_SUFFIXES}) then "
             "concat('language:', regexp_extract(lower(p), '[^/]\\.([^./]+)$', 1)) end, "
             "case when contains(lower(p), 'docker') then 'docker' end, "
             "case when contains(lower(p), 'config') then 'configuration' end], lambda x: x is not null)")
CHANGE_SQL = f"""with {B.CHANGES}
select concat('gitlab_', id) as source_id, title,
  concat_ws(chr(10), case when title <> '' then concat('标题: ', title) end,
    case when description <> '' then concat('描述: ', description) end,
    concat('变更文件: ', array_to_string(files_changed, ', ')), concat('标签: ', array_to_string(labels, ', '))) as content,
  array_to_string({sorted_list('labels', f"flatten(list_transform(files_changed, lambda p: {_OWN_FILE}))",
                               found_list(_LOWTXT, R.CHANGE_WORDS))}, ',') as keywords,
  array_to_string({sorted_list(
      "flatten(list_transform(files_changed, lambda p: list_transform(list_filter(string_split(p, '/'), "
      "lambda x: contains(lower(x), 'service')), lambda x: concat('service:', x))))",
      "list_transform(list_filter(labels, lambda x: lower(x) in ('backend', 'frontend', 'database', 'api')), "
      "lambda x: concat('component:', x))")}, ',') as entities
from v_change"""


def ticket_rows(spark, d):
    return D.ticket_documents(B.tickets(spark, d).withColumns(
        {"reporter": F.lit("x"), "key": c("id")}), as_of()).select(
        "source_id", "title", "content", "category", _joined("keywords"), _joined("entities"))


TICKET_SQL = f"""with {B.TICKETS}
select concat('jira_', id) as source_id, title,
  concat_ws(chr(10), case when title <> '' then concat('工单: ', title) end,
    case when description <> '' then concat('描述: ', description) end,
    concat('组件: ', array_to_string(components, ', '))) as content, type as category,
  array_to_string({sorted_list("[type, concat('priority:', priority), concat('status:', status)]", 'components',
                               found_list(_LOWTXT, R.TICKET_WORDS))}, ',') as keywords,
  array_to_string({sorted_list(
      "list_transform(components, lambda x: concat(case when contains(lower(x), 'service') or "
      "contains(lower(x), 'server') then 'service:' else 'component:' end, x))",
      found_list(_LOWTXT, R.TICKET_TECH, 'technology:'))}, ',') as entities
from v_ticket"""


# ------------------------------------------------------------------ flat loader
def flat_rows(spark, d):
    """Content templates of the flat loader, only rows with more than 50 characters."""
    kb = B.documents(spark, d).select(
        F.concat(F.lit("wiki:"), c("doc_id").cast("string")).alias("row_id"),
        F.concat("title", F.lit(": "), "content").alias("content"))
    change = B.changes(spark, d).select(
        F.concat(F.lit("gitlab:"), "id").alias("row_id"),
        F.concat(F.lit("Project: "), "title", F.lit(", Description: "), "description").alias("content"))
    ticket = B.tickets(spark, d).select(
        F.concat(F.lit("jira:"), "id").alias("row_id"),
        F.concat(F.lit("Issue: "), "title", F.lit(", Description: "), "description").alias("content"))
    low = F.lower("content")
    words = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in
                                      ("service", "kubernetes", "cpu", "memory")]))
    return kb.unionByName(change).unionByName(ticket).filter(F.length("content") > 50).select(
        "row_id", F.length("content").alias("n_chars"), F.array_join(words, ",").alias("keywords"))


_FLAT_WORDS = found_list("lower(content)", ["service", "kubernetes", "cpu", "memory"])
FLAT_SQL = f"""with {B.DOCUMENTS}, {B.CHANGES}, {B.TICKETS},
u as (select concat('wiki:', doc_id) as row_id, concat(title, ': ', content) as content from v_kb
  union all select concat('gitlab:', id), concat('Project: ', title, ', Description: ', description) from v_change
  union all select concat('jira:', id), concat('Issue: ', title, ', Description: ', description) from v_ticket)
select row_id, length(content) as n_chars, array_to_string({_FLAT_WORDS}, ',') as keywords from u
where length(content) > 50"""


# ------------------------------------------------------------------ hits
def hit_shapes(spark, d):
    kb = B.documents(spark, d)
    shape = D.evidence_shape(c("source_type"), c("log_file"), c("content"))
    return kb.select(
        "doc_id", clip(c("content"), 500).alias("shown"), shape.alias("e"),
        D.is_case(c("title"), c("content")).alias("is_case"),
        D.solution_snippet(c("content")).alias("solution"), D.practice_snippet(c("content")).alias("practice"),
    ).select("doc_id", "shown", "e.*", "is_case", "solution", "practice")


def _snippet_sql(words, before, least):
    out = []
    for w in words:
        at = f"(strpos(lower(content), {quote(w)}) - 1)"
        start = f"greatest(0, {at} - {before})"
        piece = _TRIM.format(f"substr(content, {start} + 1, {at} + 200 - {start})")
        out.append(f"case when {at} >= 0 and length({piece}) > {least} then {piece} end")
    return "coalesce(" + ", ".join(out)


HIT_SQL = f"""with {B.DOCUMENTS}
select doc_id, case when length(content) > 500 then concat(substr(content, 1, 500), '...') else content end as shown,
  case source_type when 'wiki' then 'Wiki知识库' when 'jira' then 'JIRA工单系统' when 'gitlab' then 'GitLab项目' end
    as file_path,
  case source_type when 'wiki' then '知识文档' when 'jira' then '工单记录' when 'gitlab' then '代码仓库' end as data_type,
  case when content = '' then '' else concat(substr(content, 1, 200), '...') end as content_preview,
  {any_like("concat(lower(title), lower(content))", R.CASE_WORDS)} as is_case,
  {_snippet_sql(R.SOLUTION_WORDS, 50, 20)}, substr(content, 1, 200)) as solution,
  {_snippet_sql(R.PRACTICE_WORDS, 30, 15)}, '') as practice
from v_kb"""


def highlights(spark, d):
    kb = B.documents(spark, d)
    return kb.select("doc_id", D.highlight(c("content"), F.lit("zzqq memory connection mysql"), 200).alias("highlight"))


_LOC = ("coalesce(" + ", ".join(f"nullif(strpos(lower(content), '{w}'), 0)"
                                for w in ("zzqq", "memory", "connection", "mysql")) + ") - 1")
HIGHLIGHT_SQL = f"""with {B.DOCUMENTS},
a as (select doc_id, content, length(content) as len, {_LOC} as pos from v_kb),
b as (select *, greatest(0, pos - 100) as f from a), e as (select *, least(len, f + 200) as l from b),
s as (select *, case when f = 0 then 0 when strpos(substr(content, f + 1), ' ') > 0
    then f + strpos(substr(content, f + 1), ' ') else len + 1 end as st,
  case when l = len then l when strpos(reverse(substr(content, 1, l + 1)), ' ') > 0
    then l + 1 - strpos(reverse(substr(content, 1, l + 1)), ' ') else 0 end as en from e)
select doc_id, case when pos is null then
    case when len > 200 then concat(substr(content, 1, 200), '...') else content end
  else concat(case when st > 0 then '...' else '' end, substr(content, st + 1, greatest(0, en - st)),
    case when en < len then '...' else '' end) end as highlight from s"""


# ------------------------------------------------------------------ questions
def request_classes(spark, d):
    out = Q.classify_requests(B.questions(spark, d), as_of())
    return out.select(
        "query_id", "filter_service", "filter_level", "filter_host",
        F.date_format("filter_from", "yyyy-MM-dd HH:mm:ss").alias("filter_from"), "is_incident", "problem_type",
        F.array_join("request_keywords", ",").alias("request_keywords"), "priority", "complexity")


def _first_sql(text, values, shown=lambda v: v):
    return "case " + " ".join(f"when contains({text}, '{v}') then '{shown(v)}'" for v in values) + " end"


def _ladder_sql(text, patterns, default):
    return "case " + " ".join(f"when regexp_matches({text}, '{p}') then '{n}'" for n, p in patterns) + f" else '{default}' end"


REQUEST_SQL = f"""with {B.QUESTIONS} select query_id,
  {_first_sql('lower(query)', R.CONTEXT_SERVICES)} as filter_service,
  {_first_sql('lower(query)', R.CONTEXT_LEVELS, str.upper)} as filter_level,
  {_first_sql('lower(query)', R.CONTEXT_HOSTS)} as filter_host,
  case when contains(query, '最近') then '2024-01-31 00:00:00' end as filter_from,
  {any_like('lower(query)', R.INCIDENT_QUESTION_WORDS)} as is_incident,
  {_ladder_sql('query', R.PROBLEM_TYPES, 'general')} as problem_type,
  array_to_string({found_list('lower(query)', R.REQUEST_WORDS)}, ',') as request_keywords,
  {_ladder_sql('lower(query)', R.PRIORITY_PATTERNS, 'low')} as priority,
  {_ladder_sql('lower(query)', R.COMPLEXITY_PATTERNS, 'low')} as complexity from v_question"""


# ------------------------------------------------------------------ sensitive data, cleaning, quality
def _pii(spark, d):
    docs = spread(B.table(spark, d, "documents")).select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("id"),
                                                 c("text").alias("content"), c("source"))
    chats = B.table(spark, d, "conversations").select(
        F.concat(F.lit("c"), c("conv_id").cast("string"), F.lit("_"), c("turn").cast("string")).alias("id"),
        c("text").alias("content"), c("role").alias("source"))
    return docs.unionByName(chats)


_PII = """v_pii as (select concat('d', doc_id) as id, text as content, source from documents
  union all select concat('c', conv_id, '_', turn), text, role from conversations)"""


def sensitive_matches(spark, d):
    found = _pii(spark, d).select("id", F.explode_outer(P.sensitive_matches(c("content"))).alias("pattern", "found")).filter(
        "pattern is not null")
    return found.select("id", "pattern", F.size("found").alias("n"), F.array_join("found", "|").alias("matches"))


def _sensitive_sql():
    arms = []
    for name, pattern in R.SENSITIVE_PATTERNS.items():
        group = 1 if name in ("password", "api_key") else 0
        arms.append(f"select id, '{name}' as pattern, regexp_extract_all(content, {quote('(?i)' + pattern)}, {group})"
                    " as f from v_pii")
    return (f"with {_PII}, m as ({' union all '.join(arms)}) select id, pattern, len(f) as n, "
            "array_to_string(f, '|') as matches from m where len(f) > 0")


def masked_texts(spark, d):
    return _pii(spark, d).select("id", P.mask_sensitive(c("content")).alias("masked"),
                                 P.sanitize(c("content")).alias("sanitized"))


def _mask_sql():
    out, mark = "content", r"([^\s\"]+)".replace("\\\"", '"')
    for name, p in R.SENSITIVE_PATTERNS.items():
        if name in ("password", "api_key"):
            pat, rep = "(?i)(" + p.replace(mark, "") + r')[^\s"]+', rf"\1[REDACTED_{name.upper()}]"
        elif name == "jwt_token":
            pat, rep = "(?i)" + p, "[REDACTED_JWT_TOKEN]"
        elif name == "credit_card":
            pat, rep = r"(?i)\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?(\d{4})\b", r"****\1"
        elif name == "phone_number":
            pat, rep = r"(?i)\b\d{3}[-\.\s]?\d{3}[-\.\s]?(\d{4})\b", r"****\1"
        elif name == "email":
            pat, rep = (r"(?i)\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", r"\1***@\2")
        else:
            pat, rep = "(?i)" + p, f"[MASKED_{name.upper()}]"
        out = f"regexp_replace({out}, {quote(pat)}, {quote(rep)}, 'g')"
    san = "content"
    for name, p in R.SANITIZE_PATTERNS:
        san = f"regexp_replace({san}, {quote('(?i)' + p)}, '[REDACTED_{name.upper()}]', 'g')"
    return f"with {_PII} select id, {out} as masked, {san} as sanitized from v_pii"


def sensitivity_classes(spark, d):
    cls = P.sensitivity_class(c("content"), c("source") == "system")
    return _pii(spark, d).groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


_ANY = quote("(?i)" + "|".join(f"(?:{p})" for p in R.SENSITIVE_PATTERNS.values()))


def cleaned_documents(spark, d):
    docs = spread(B.table(spark, d, "documents")).select("doc_id", c("text").alias("content"))
    """Every text with its verdict; refused ones keep their cleaned form."""
    return P.clean_documents(docs, least=R.MIN_CONTENT, most=R.MAX_CONTENT).select(
        "doc_id", "content", F.length("content").alias("n"), "kept", "reason")


_SAN = "content"
for _n, _p in R.SANITIZE_PATTERNS:
    _SAN = f"regexp_replace({_SAN}, {quote('(?i)' + _p)}, '[REDACTED_{_n.upper()}]', 'g')"
CLEAN_SQL = rf"""with x as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text,
  '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as content from documents),
y as (select doc_id, {_SAN} as content, case when length(content) < 10 then 'too short' when length(content) > 100000 then 'too long' end
  as reason from x)
select doc_id, content, length(content) as n, reason is null as kept, reason from y"""


def document_quality(spark, d):
    """Five-part score; accuracy from the label, timeliness by age bucket, relevance by length."""
    kb = B.documents(spark, d).join(B.table(spark, d, "labels"), "doc_id", "left")
    parts = {
        "completeness": P.completeness([c("title"), c("content"), c("author"), c("doc_id")],
                                       [c("category"), c("quality"), c("toxic")]),
        "accuracy": F.coalesce(c("quality").cast("double"), F.lit(0.5)),
        "consistency": 1.0 - F.coalesce(c("toxic").cast("double"), F.lit(0.0)),
        "timeliness": 1.0 / (1 + c("doc_id") % 4),
        "relevance": F.least(F.lit(1.0), F.length("content") / 1000.0),
    }
    return kb.select("doc_id", *[F.round(v, 6).alias(k) for k, v in parts.items()],
                     F.round(P.quality_score(parts), 6).alias("overall_score"))


QUALITY_SQL = f"""with {B.DOCUMENTS}, j as (select * from v_kb left join labels using (doc_id)),
p as (select doc_id, ((title <> '')::int + (content <> '')::int + (author <> '')::int + 1) / 4.0::double * 0.8 +
  (((category <> '')::int + (quality is not null)::int + (toxic is not null)::int) / 3.0::double) * 0.2
    as completeness,
  coalesce(quality::double, 0.5) as accuracy, 1.0::double - coalesce(toxic::double, 0.0) as consistency,
  1.0::double / (1 + doc_id % 4) as timeliness, least(1.0::double, length(content) / 1000.0::double) as relevance
  from j)
select doc_id, round(completeness, 6) as completeness, round(accuracy, 6) as accuracy,
  round(consistency, 6) as consistency, round(timeliness, 6) as timeliness, round(relevance, 6) as relevance,
  round(completeness * 0.3 + accuracy * 0.25 + consistency * 0.2 + timeliness * 0.15 + relevance * 0.1, 6)
    as overall_score from p"""


def quality_rates(spark, d):
    """Complete, validated, fresh and consistent share with threshold flags, one pass."""
    kb = B.documents(spark, d).join(B.table(spark, d, "labels"), "doc_id", "left")
    flags = {
        "completeness_rate": (c("title") != "") & (c("content") != ""), "accuracy_rate": c("quality") == 1,
        "timeliness_score": c("doc_id") % 4 != 3, "consistency_score": F.coalesce(c("toxic"), F.lit(0)) == 0,
    }
    rates = kb.agg(*[F.avg(F.when(v, 1.0).otherwise(0.0)).alias(k) for k, v in flags.items()])
    return rates.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.round(c(k), 6).alias("rate"), (c(k) < R.QUALITY_THRESHOLDS[k]).alias("alert"))
        for k in flags])))


RATES_SQL = f"""with {B.DOCUMENTS}, j as (select * from v_kb left join labels using (doc_id)),
r as (select avg(case when title <> '' and content <> '' then 1.0 else 0.0 end) as a,
  avg(case when quality = 1 then 1.0 else 0.0 end) as b, avg(case when doc_id % 4 <> 3 then 1.0 else 0.0 end) as e,
  avg(case when coalesce(toxic, 0) = 0 then 1.0 else 0.0 end) as f from j)
select 'completeness_rate' as metric, round(a, 6) as rate, a < 0.95 as alert from r
union all select 'accuracy_rate', round(b, 6), b < 0.90 from r
union all select 'timeliness_score', round(e, 6), e < 0.85 from r
union all select 'consistency_score', round(f, 6), f < 0.95 from r"""


def distribution_shares(spark, d):
    """Documents of quality 0.6 or more, share per language and source type."""
    kb = B.documents(spark, d).join(B.table(spark, d, "labels"), "doc_id", "left")
    good = kb.filter(F.coalesce(c("quality").cast("double"), F.lit(0.7)) >= 0.6)
    counts = good.groupBy("category", "source_type").agg(F.count("*").alias("n"),
                                                        F.sum(F.size(F.split("content", r"\s+"))).alias("tokens"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("category", "source_type", "n", "tokens", F.round(c("n") / total, 6).alias("share"))


SHARE_SQL = f"""with {B.DOCUMENTS}, g as (select v_kb.* from v_kb left join labels using (doc_id)
  where coalesce(quality::double, 0.7) >= 0.6)
select category, source_type, count(*) as n,
  cast(sum(len(regexp_split_to_array(content, '\\s+'))) as bigint) as tokens,
  round(count(*)::double / sum(count(*)) over (), 6) as share from g group by 1, 2""".replace("\\\\", "\\")


QUERIES = {
    "wiki_chunk_rows": (wiki_chunks, WIKI_SQL),
    "overlap_chunks": (overlap_chunks, OVERLAP_SQL),
    "overlap_chunks_1000": (long_overlap_chunks, LONG_OVERLAP_SQL),
    "merge_request_rows": (change_rows, CHANGE_SQL),
    "ticket_rows": (ticket_rows, TICKET_SQL),
    "flat_loader_rows": (flat_rows, FLAT_SQL),
    "hit_shapes_snippets": (hit_shapes, HIT_SQL),
    "search_highlights": (highlights, HIGHLIGHT_SQL),
    "request_classes": (request_classes, REQUEST_SQL),
    "sensitive_matches": (sensitive_matches, _sensitive_sql()),
    "masked_texts": (masked_texts, _mask_sql()),
    "sensitivity_classes": (sensitivity_classes, f"with {_PII} select case when regexp_matches(content, {_ANY}) then "
                            "'SENSITIVE' when source = 'system' then 'CONFIDENTIAL' else 'INTERNAL' end as class, "
                            "count(*) as n from v_pii group by 1"),
    "cleaned_documents": (cleaned_documents, CLEAN_SQL),
    "document_quality": (document_quality, QUALITY_SQL),
    "quality_rates": (quality_rates, RATES_SQL),
    "distribution_shares": (distribution_shares, SHARE_SQL),
}
