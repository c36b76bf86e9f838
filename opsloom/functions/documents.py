"""Document preparation: keywords, entities, text assembly, chunks, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions.logs import pattern_entities
from opsloom.functions.text import any_of, clip, distinct_sorted, strip, words_found

_NONE = "array<string>"


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.array().cast(_NONE))


# ------------------------------------------------------------------ wiki
def wiki_keywords(content: Column, tags: Column) -> Column:
    return distinct_sorted(_or_empty(tags), words_found(F.lower(content), R.WIKI_TECH_WORDS),
                           words_found(content, R.WIKI_OPS_WORDS))


def wiki_entities(content: Column) -> Column:
    low = F.lower(content)
    return distinct_sorted(pattern_entities(low, R.WIKI_SERVICES, "service:"),
                           words_found(low, R.WIKI_TECH, "technology:"))


# ------------------------------------------------------------------ merge requests
def change_keywords(labels: Column, files: Column, title: Column, description: Column) -> Column:
    """Labels, language of the changed files, path hints, bug/feature/fix."""
    def of_file(path: Column) -> Column:
        low = F.lower(path)
        name = F.element_at(F.split(low, "/"), -1)
        # the suffix starts at the last dot, which must not be the first character of the name
        suffix = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
        return F.array_compact(F.array(
            F.when(suffix.isin(R.CODE_SUFFIXES), F.concat(F.lit("language:"), suffix)),
            F.when(low.contains("docker"), F.lit("docker")),
            F.when(low.contains("config"), F.lit("configuration")),
        ))

    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return distinct_sorted(_or_empty(labels), F.flatten(F.transform(_or_empty(files), of_file)),
                           words_found(text, R.CHANGE_WORDS))


def change_entities(labels: Column, files: Column) -> Column:
    def of_file(path: Column) -> Column:
        named = F.filter(F.split(path, "/"), lambda part: F.lower(part).contains("service"))
        return F.transform(named, lambda part: F.concat(F.lit("service:"), part))

    marked = F.filter(_or_empty(labels), lambda x: F.lower(x).isin(R.CHANGE_LABELS))
    return distinct_sorted(F.flatten(F.transform(_or_empty(files), of_file)),
                           F.transform(marked, lambda x: F.concat(F.lit("component:"), x)))


def change_text(title: Column, description: Column, files: Column, labels: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.when(title != "", F.concat(F.lit("标题: "), title)),
        F.when(description != "", F.concat(F.lit("描述: "), description)),
        F.concat(F.lit("变更文件: "), F.array_join(files, ", ")),
        F.concat(F.lit("标签: "), F.array_join(labels, ", ")),
    )


# ------------------------------------------------------------------ tickets
def ticket_keywords(kind: Column, priority: Column, status: Column, components: Column, title: Column,
                    description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    own = F.array_compact(F.array(kind, F.concat(F.lit("priority:"), priority), F.concat(F.lit("status:"), status)))
    return distinct_sorted(own, _or_empty(components), words_found(text, R.TICKET_WORDS))


def ticket_entities(components: Column, title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))

    def named(c: Column) -> Column:
        kind = F.when(F.lower(c).rlike("service|server"), F.lit("service:")).otherwise(F.lit("component:"))
        return F.concat(kind, c)

    return distinct_sorted(F.transform(_or_empty(components), named), words_found(text, R.TICKET_TECH, "technology:"))


def ticket_text(title: Column, description: Column, components: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.when(title != "", F.concat(F.lit("工单: "), title)),
        F.when(description != "", F.concat(F.lit("描述: "), description)),
        F.concat(F.lit("组件: "), F.array_join(components, ", ")),
    )


# ------------------------------------------------------------------ chunks
def pack_sentences(content: Column, size: int = R.CHUNK_SIZE, end: str = R.SENTENCE_END) -> Column:
    """Whole text to chunks of at most ``size`` characters, cut only at sentence ends.

    A sentence longer than ``size`` stays whole. Every sentence gets its end
    mark back, also the empty one after the last mark.
    """
    state = F.struct(F.array().cast(_NONE).alias("done"), F.lit("").alias("open"))

    def add(acc: Column, sentence: Column) -> Column:
        longer = F.concat(acc["open"], sentence)
        fits = F.length(longer) <= size
        closed = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(
            F.array_append(acc["done"], strip(acc["open"])))
        return F.struct(closed.alias("done"),
                        F.concat(F.when(fits, longer).otherwise(sentence), F.lit(end)).alias("open"))

    def close(acc: Column) -> Column:
        return F.array_append(acc["done"], strip(acc["open"]))

    sentences = F.split(content, end if end != "." else r"\.", -1)
    packed = F.aggregate(sentences, state, add, close)
    return F.when(F.length(content) <= size, F.array(content)).otherwise(packed)


def pack_with_overlap(content: Column, size: int = 512, overlap: int = 50,
                      sentence: str = r"[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$", style: str = "tail") -> Column:
    """Chunks that repeat some text of the one before; every character is in some chunk.

    A sentence over ``size`` is cut into pieces of ``size``, as many as it takes.
    ``style='tail'``: a new chunk starts with the last ``overlap`` characters of
    the chunk before. ``style='sentence'``: a new chunk starts with the last
    ``overlap`` characters of its own first sentence, as specified for the
    1000/100 form. The last chunk is written in both.
    """
    state = F.struct(F.array().cast(_NONE).alias("done"), F.lit("").alias("open"))
    tail = style == "tail"

    def pieces(s: Column) -> Column:
        count = F.greatest(F.ceil(F.length(s) / size).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substr(s, k * size + 1, F.lit(size)))

    def add(acc: Column, s: Column) -> Column:
        longer = F.concat(acc["open"], s)
        fits = F.length(longer) <= size
        written = strip(acc["open"]) if tail else acc["open"]
        restart = F.concat(F.right(acc["open"] if tail else s, F.lit(overlap)), s)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], written)).alias("done"),
                        F.when(fits, longer).otherwise(restart).alias("open"))

    def close(acc: Column) -> Column:
        last = strip(acc["open"]) if tail else acc["open"]
        return F.when(acc["open"] != "", F.array_append(acc["done"], last)).otherwise(acc["done"])

    sentences = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(sentence), F.lit(0)), pieces))
    return F.aggregate(sentences, state, add, close)


def chunk_rows(df: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk with chunk_index, total_chunks and chunk_size."""
    return (
        df.withColumn("_chunks", chunks)
        # outer: an inner explode would infer a size filter and cut the text a second time for it
        .select("*", F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_index", "chunk"))
        .filter("chunk_index is not null").withColumn("chunk_size", F.length("chunk")).drop("_chunks")
    )


# ------------------------------------------------------------------ document rows of each source
def wiki_documents(df: DataFrame, as_of: Column, size: int = R.CHUNK_SIZE, end: str = R.SENTENCE_END) -> DataFrame:
    """id, title, content, category, tags, author, last_updated -> search rows, one per chunk."""
    category, author = R.DOCUMENT_DEFAULTS["wiki"]
    some = df.filter((F.coalesce("content", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != ""))
    rows = chunk_rows(some, pack_sentences(F.coalesce(F.col("content"), F.lit("")), size, end))
    part = F.concat(F.col("title"), F.lit(" (Part "), (F.col("chunk_index") + 1).cast("string"), F.lit(")"))
    return rows.select(
        F.concat(F.lit("wiki_"), F.col("id"), F.lit("_"), F.col("chunk_index").cast("string")).alias("source_id"),
        F.when(F.col("total_chunks") > 1, part).otherwise(F.col("title")).alias("title"),
        F.col("chunk").alias("content"), F.lit("wiki").alias("source_type"),
        F.coalesce("category", F.lit(category)).alias("category"),
        wiki_keywords(F.col("chunk"), F.col("tags")).alias("keywords"),
        wiki_entities(F.col("chunk")).alias("entities"),
        F.coalesce("author", F.lit(author)).alias("author"),
        F.coalesce("last_updated", as_of).alias("timestamp"),
        "chunk_index", "chunk_size", "total_chunks", F.col("id").alias("parent_id"),
    )


def change_documents(df: DataFrame, as_of: Column) -> DataFrame:
    """Merge requests -> search rows; requests without any text are dropped."""
    c = F.col
    content = change_text(c("title"), c("description"), c("files_changed"), c("labels"))
    return df.withColumn("content", content).filter(c("content") != "").select(
        F.concat(F.lit("gitlab_"), c("id")).alias("source_id"), "title", "content",
        F.lit("gitlab").alias("source_type"), F.lit(R.DOCUMENT_DEFAULTS["gitlab"][0]).alias("category"),
        change_keywords(c("labels"), c("files_changed"), c("title"), c("description")).alias("keywords"),
        change_entities(c("labels"), c("files_changed")).alias("entities"),
        F.coalesce("author", F.lit("")).alias("author"), F.coalesce("created_at", as_of).alias("timestamp"))


def ticket_documents(df: DataFrame, as_of: Column) -> DataFrame:
    """Tickets -> search rows; tickets without any text are dropped."""
    c = F.col
    content = ticket_text(c("title"), c("description"), c("components"))
    return df.withColumn("content", content).filter(c("content") != "").select(
        F.concat(F.lit("jira_"), F.coalesce(c("id"), c("key"))).alias("source_id"), "title", "content",
        F.lit("jira").alias("source_type"), F.coalesce(c("type"), F.lit("工单")).alias("category"),
        ticket_keywords(c("type"), c("priority"), c("status"), c("components"), c("title"), c("description"))
        .alias("keywords"),
        ticket_entities(c("components"), c("title"), c("description")).alias("entities"),
        F.coalesce("reporter", F.lit("")).alias("author"), F.coalesce("created", as_of).alias("timestamp"))


# ------------------------------------------------------------------ snippets and shapes of hits
def highlight(content: Column, query: Column, size: int = 200) -> Column:
    """``size`` characters around the first query word found, moved to blanks."""
    low = F.lower(content)
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    found = F.filter(F.transform(words, lambda w: F.instr(low, w)),
                     lambda p: p > 0)
    at = F.try_element_at(found, F.lit(1)) - 1
    length = F.length(content)
    first = F.greatest(F.lit(0), at - size // 2)
    last = F.least(length, first + size)
    # start: one past the next blank; without any blank, past the end
    next_blank = F.instr(F.substr(content, first + 1), F.lit(" "))
    start = F.when(first == 0, 0).otherwise(F.when(next_blank > 0, first + next_blank).otherwise(length + 1))
    # end: back to the blank at or before it
    head = F.substr(content, F.lit(1), last + 1)
    back = F.instr(F.reverse(head), F.lit(" "))
    stop = F.when(last == length, last).otherwise(F.when(back > 0, F.length(head) - back).otherwise(F.lit(0)))
    body = F.substr(content, start + 1, F.greatest(F.lit(0), stop - start))
    marked = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(stop < length, "...").otherwise(""))
    return F.when((content == "") | (query == "") | at.isNull(), clip(content, size)).otherwise(marked)


def _window(content: Column, words: list[str], before: int, size: int, least: int) -> list[Column]:
    low = F.lower(content)
    out = []
    for word in words:
        at = F.instr(low, word) - 1
        start = F.greatest(F.lit(0), at - before)
        piece = strip(F.substr(content, start + 1, at + size - start))
        out.append(F.when((at >= 0) & (F.length(piece) > least), piece))
    return out


def solution_snippet(content: Column) -> Column:
    """Text around the first solution word in priority order, else the first 200 characters."""
    return F.coalesce(*_window(content, R.SOLUTION_WORDS, 50, 200, 20), F.substring(content, 1, 200))


def practice_snippet(content: Column) -> Column:
    return F.coalesce(*_window(content, R.PRACTICE_WORDS, 30, 200, 15), F.lit(""))


def is_case(title: Column, content: Column) -> Column:
    return any_of(F.concat(F.lower(title), F.lower(content)), R.CASE_WORDS)


def evidence_shape(source: Column, log_file: Column, content: Column) -> Column:
    """Display name, data type and preview of one piece of evidence."""
    name = F.when(source == "logs", log_file)
    kind = F.when(source == "logs", "日志文件")
    for value, shown, data_type in R.SOURCE_DISPLAY:
        name, kind = name.when(source == value, shown), kind.when(source == value, data_type)
    preview = F.when(F.coalesce(content, F.lit("")) == "", "").otherwise(
        F.concat(F.substring(content, 1, 200), F.lit("...")))
    return F.struct(name.otherwise(F.concat(source, F.lit("数据源"))).alias("file_path"),
                    kind.otherwise("其他数据").alias("data_type"), preview.alias("content_preview"))
