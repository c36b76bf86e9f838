"""Spelling variants: words one edit apart, found by pivotal grams, hung on their most frequent form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, sliced, small_batches, stored, table

#: Least letters and occurrences of words that take part; runs of that many letters, each taken whole.
LETTERS, LEAST = 5, 3
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}")
#: Words that a task counts before it hands the counts on.
HELD = 200_000
#: A run whose hash this divides loses a letter, as the contract of the query says.
DROPPED = 97
#: Letters of a gram; edits between near words; grams of a prefix, of which EDITS + 1 disjoint ones are pivots.
GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1
#: A form is at least so many times as frequent.
TIMES = 2


def word_counts(docs: DataFrame, noise: bool = False) -> DataFrame:
    """word, n over whole texts; counted in the task before anything is shuffled.

    With ``noise`` a run whose hash with the document's id DROPPED divides
    loses one letter; rows without an id lose none.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for whole in batches:
            for batch in sliced(whole, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if not text:
                        continue
                    head = zlib.crc32(f"{doc_id}:".encode())
                    # bytes.lower leaves all but A-Z as it is
                    own = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                    for word, n in own.items():
                        if noise and doc_id is not None and (h := zlib.crc32(word.encode(), head)) % DROPPED == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < LETTERS:
                                continue
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield batch_of(schema, {"word": list(counts), "n": list(counts.values())})
                    counts = {}
        yield batch_of(schema, {"word": list(counts), "n": list(counts.values())})

    parts = small_batches(docs).select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def gram_order(words: DataFrame) -> dict[str, tuple[int, float]]:
    """gram -> (rank, list length). Rare grams come first, those whose lists of (gram, place, length) are short.

    The letters allow (26 + 64) ** 2 = 8,100 grams, so the order is small
    whatever the number of words is.
    """
    letters = words.select(F.split("word", "").alias("c"))
    grams = letters.select(F.size("c").alias("len"), F.posexplode(F.zip_with(
        F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda x, y: F.concat(x, y))).alias("at", "gram"))
    lists = grams.groupBy("gram", "at", "len").agg(F.count("*").cast("double").alias("c"))
    rows = lists.groupBy("gram").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("mean")).collect()
    rows.sort(key=lambda r: (r["mean"], r["gram"]))
    return {r["gram"]: (i, r["mean"]) for i, r in enumerate(rows)}


def prefix_of(word: str, order: dict[str, tuple[int, float]]) -> tuple[list[int], int]:
    """Places of the PREFIX rarest grams, further ones of the last gram too, and the last one's rank."""
    ranked = sorted((order[word[i:i + GRAM]][0], i) for i in range(len(word) - GRAM + 1))
    last = ranked[min(PREFIX, len(ranked)) - 1][0]
    return sorted(i for r, i in ranked if r <= last), last


def pivots_of(word: str, places: list[int], order: dict[str, tuple[int, float]]) -> list[int]:
    """EDITS + 1 places of disjoint grams with the least sum of list lengths, by dynamic programming.

    best[k] is the cheapest choice of k grams that end at or before a place;
    of PREFIX grams at least EDITS + 1 are always disjoint.
    """
    ends: list[tuple[int, list]] = [(-1, [(0.0, [])] + [None] * (EDITS + 1))]  # after a place: per count the best choice
    for i in places:
        cost = order[word[i:i + GRAM]][1]
        before = next(best for end, best in reversed(ends) if end <= i - GRAM or end < 0)
        now = list(ends[-1][1])
        for k in range(1, EDITS + 2):
            if before[k - 1] is not None:
                option = (before[k - 1][0] + cost, before[k - 1][1] + [i])
                if now[k] is None or option < now[k]:
                    now[k] = option
        ends.append((i, now))
    return ends[-1][1][EDITS + 1][1]


def _keyed(words: DataFrame, order: dict[str, tuple[int, float]]) -> DataFrame:
    """word, n, len, last, pivot, key, far, body, for each prefix gram from both ends and for each pivot from one.

    One edit leaves what is before it or what is behind it as it was: either
    the first pivot and all to its left, or the second and all to its right.
    These whole sides are the keys, which fixes the place of the gram too.
    ``far`` holds the two letters of the other end: they are equal as well, or
    the edit touches them and all but three letters (``body``) is shared.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("len", pa.int32()), ("last", pa.int32()), ("pivot", pa.bool_()), ("key", pa.string()), ("far", pa.string()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                out: list[tuple] = []
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                    places, last = prefix_of(word, order)
                    first, second = pivots_of(word, places, order)
                    head = (word, n, len(word), last)
                    left, right = (word[-2:], word[:-3]), (word[:2], word[3:])
                    out.append((*head, True, "<" + word[:first + GRAM], *left))
                    out.append((*head, True, ">" + word[second:], *right))
                    for i in places:
                        out.append((*head, False, "<" + word[:i + GRAM], *left))
                        out.append((*head, False, ">" + word[i:], *right))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return words.select("word", "n").mapInArrow(run, "word string, n long, len int, last int, pivot boolean, key string, far string, body string")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, m: pairs of words one insertion, deletion or replacement apart, each both ways.

    Of two near words the one whose prefix ends earlier in the order of grams
    finds a pivot of its own among the other's prefix grams. Sides that many
    words share (hot keys) are split by the join; candidates are verified as
    they meet and never written.
    """
    keyed = stored(_keyed(words, gram_order(words)), "pivot-keys")
    pivots = keyed.where("pivot").select(F.col("word").alias("a"), F.col("n").alias("x"), F.col("last").alias("la"), "key", F.col("far").alias("fa"),
                                         "body", F.explode(F.array(*[F.col("len") + d for d in range(-EDITS, EDITS + 1)])).alias("len"))
    grams = keyed.where("not pivot").select(F.col("word").alias("b"), F.col("n").alias("y"), F.col("last").alias("lb"), "key", F.col("far").alias("fb"), "len")
    may = (F.col("fa") == F.col("fb")) | F.startswith("b", "body") | F.endswith("b", "body")
    close = (F.col("la") <= F.col("lb")) & may & (F.levenshtein("a", "b", EDITS) == EDITS)
    found = pivots.join(grams, (pivots["key"] == grams["key"]) & (pivots["len"] == grams["len"]) & close)
    pairs = stored(found.select("a", "x", "b", "y").distinct(), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("x").alias("n"), F.col("b").alias("other"), F.col("y").alias("m"))
    turned = pairs.select(F.col("b").alias("word"), F.col("y").alias("n"), F.col("a").alias("other"), F.col("x").alias("m"))
    return both.unionByName(turned).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): the last word of the chain of forms, by doubling the stride.

    Every step at least doubles the count, so that a chain is as long as the
    logarithm of the largest count at most and few rounds reach its end.
    """
    now = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of (word, n).

    Empty table: no rows. A word without near words is its own root.
    """
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("top"))
    own = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("top.m") >= TIMES * F.col("n"), F.col("top")).alias("top"))
    forms = stored(own.select("word", "n", "n_near", F.col("top.other").alias("form"), (-F.col("top.m")).alias("form_n")), "forms")
    return (forms.join(roots(forms), "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))


def op13_pivotal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents. Null texts have no words, null ids no deleted letters."""
    return variants(stored(word_counts(table(spark, sf_dir, "documents"), noise=True), "words"))


OP13_SQL = r"""
with recursive bits as (select list_transform(range(256), lambda b: list_reduce([b] || range(8),
                 lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as tab),
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
low as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs
        where length(run) >= 5 group by all),
hashed as (select run, n, xor(list_reduce([cast(4294967295 as bigint)] || flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
                 lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [cast(195 as bigint), cast(unicode(c) - 64 as bigint)] end)),
                 lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) as h, doc_id is null as bare
           from low, bits),
w as (select case when not bare and h % 97 = 0 then concat(left(run, h % length(run)), substring(run, h % length(run) + 2)) else run end as word,
             cast(sum(n) as bigint) as n from hashed group by 1 having sum(n) >= 3 and length(word) >= 5),
cut as (select word, n, i, concat(left(word, i), substring(word, i + 2)) as rest from (select word, n, unnest(range(length(word))) as i from w)),
pairs as (select a.word, b.word as other, b.n as m from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
          union select a.word, b.word, b.n from cut a join w b on a.rest = b.word
          union select b.word, a.word, a.n from cut a join w b on a.rest = b.word),
near as (select word, count(*) as n_near, min((-m, other)) as top from pairs group by 1),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -top[1] >= 2 * w.n then top[2] end as form,
                 case when -top[1] >= 2 * w.n then -top[1] end as form_n from w left join near using (word)),
walk as (select word, word as at, form as next from forms
         union all select walk.word, walk.next, f.form from walk join forms f on f.word = walk.next where walk.next is not null)
select f.word, n, n_near, form, form_n, walk.at as root from forms f join walk on walk.word = f.word and walk.next is null
"""
