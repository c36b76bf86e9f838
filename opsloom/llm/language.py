"""Language identification: script ranges, word scores, Viterbi labels of mixed-language text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.common import fold, sliced, small_batches, table

#: Labelled documents that are learned from, at most; drawn by a hash of the id.
SAMPLE = 20_000
#: Hashed letter triples per language.
BUCKETS = 1 << 15
#: Loss of log likelihood at every change of language inside a text.
SWITCH = 10.0
#: A language is a candidate for a script that so large a share of its words is written in.
SHARE = 0.01
CACHED = 250_000
_WORD = re.compile(r"[^\W\d_]+")

# Blocks of Unicode by script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
]
_NAMES = list(dict.fromkeys(s for s, _, _ in SCRIPTS)) + ["other"]
_STARTS = np.array(sorted(lo for _, lo, _ in SCRIPTS))
_ENDS = np.array([hi for _, _, hi in sorted(SCRIPTS, key=lambda x: x[1])])
_SCRIPT = np.array([_NAMES.index(s) for s, _, _ in sorted(SCRIPTS, key=lambda x: x[1])])


def _triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word number of every letter triple, word borders included, and each word's script."""
    codes = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    border = codes == 2
    word = np.cumsum(border) - 1
    first = codes[1:][border[:-1]][:len(words)].astype(np.int64)
    slot = np.clip(np.searchsorted(_STARTS, first, "right") - 1, 0, None)
    script = np.where((first >= _STARTS[slot]) & (first <= _ENDS[slot]), _SCRIPT[slot], len(_NAMES) - 1)
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)
    bucket = ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64) % BUCKETS
    keep = ~border[1:-1]
    return bucket[keep], word[:-2][keep], script


@dataclass
class Model:
    """Log probability of each triple per language, and the languages that each script leaves."""
    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Word by language; a script that no language uses leaves all of them, without a preference."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        bucket, word, script = _triples(words)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.add.reduceat(self.table[bucket], starts, axis=0)
        ok = self.allowed[script]
        known = ok.any(axis=1)
        out[~known] = 0
        out[known] = np.where(ok[known], out[known], out[known].min(axis=1, keepdims=True) - 2 * SWITCH)
        return out


def fit(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model | None:
    """Counts of triples by language over ``sample`` labelled documents at most; None where none is labelled.

    Only text and lang of rows whose fold is not 1 are used. One vector per
    language reaches the driver.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1)).select("doc_id", "lang", "text")
    n = labelled.count()
    if not n:
        return None
    if n > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in sliced(whole, "text"):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    words = _WORD.findall(text.lower())
                    if words:
                        bucket, _, script = _triples(words)
                        own = sums.setdefault(lang, np.zeros(buckets + len(_NAMES)))
                        own[:buckets] += np.bincount(bucket, minlength=buckets)
                        own[buckets:] += np.bincount(script, minlength=len(_NAMES))
        for lang, own in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [own.tobytes()]})

    def added(keys: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [keys[0]], "counts": [np.sum([np.frombuffer(c) for c in parts["counts"]], axis=0).tobytes()]})

    parts = labelled.mapInArrow(counted, "lang string, counts binary").withColumn("salt", F.spark_partition_id() % 16)
    once = parts.groupBy("lang", "salt").applyInPandas(added, "lang string, counts binary")
    rows = sorted((r["lang"], np.frombuffer(r["counts"])) for r in once.groupBy("lang").applyInPandas(added, "lang string, counts binary").collect())
    if not rows:
        return None
    counts = np.array([c for _, c in rows])
    grams, scripts = counts[:, :buckets] + 0.1, counts[:, buckets:]
    return Model([lang for lang, _ in rows], np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(),
                 (scripts / scripts.sum(axis=1, keepdims=True) >= SHARE).T.copy())


def viterbi(scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word of many texts, all texts in step.

    ``words`` holds the score rows of the texts one after the other,
    ``lengths`` their numbers of words. Step t treats word t of each text that
    has one; a change of language costs ``switch``.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    count = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
    value = np.zeros((len(lengths), scores.shape[1]), np.float64)
    back = np.full((len(words), scores.shape[1]), -1, np.int8 if scores.shape[1] < 128 else np.int32)
    for t, a in enumerate(count):
        v, rows = value[:a], first[:a] + t
        if t:
            best = v.argmax(axis=1)
            moved = v[np.arange(a), best][:, None] - switch
            leave = moved > v
            back[rows] = np.where(leave, best[:, None], -1)
            v = np.where(leave, moved, v)
        value[:a] = v + scores[words[rows]]
    state, out = value.argmax(axis=1), np.zeros(len(words), np.int64)
    for t in range(len(count) - 1, -1, -1):
        a = count[t]
        rows = first[:a] + t
        out[rows] = state[:a]
        prior = back[rows, state[:a]]
        state[:a] = np.where(prior >= 0, prior, state[:a])
    return out


class _Words(dict):
    """word -> row of its scores; new words are scored together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.rows = model, [], np.zeros((0, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def scored(self) -> np.ndarray:
        if self.new:
            self.rows = np.concatenate([self.rows, self.model.scores(self.new)])
            self.new = []
        return self.rows


SPANS = "array<struct<first_word:int,words:int,lang:string>>"


def label(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """All columns of ``docs`` and _lang_pred, _lang_score, _lang_spans.

    The prediction is the language with most letters on the best path, the
    first by name among equals; the score is its share of them. Spans are
    maximal runs of one language, in words. Without text, letters or a model:
    ``und``, 0, no spans. Whole texts are read, whatever their length.
    """
    added = T.StructType(docs.schema.fields + [T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType()),
                                               T.StructField("_lang_spans", T._parse_datatype_string(SPANS))])
    span_type = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(model) if model else None
        for whole in batches:
            for batch in sliced(whole, "text"):
                rows = batch.num_rows
                pred, share, spans = ["und"] * rows, [0.0] * rows, [[] for _ in range(rows)]
                if known is not None:
                    if len(known) > CACHED:
                        known = _Words(model)
                    ids, sizes, lengths = [], [], []
                    for text in batch.column("text").to_pylist():
                        words = _WORD.findall(text.lower()) if text else []
                        if text and not text.isascii():
                            words = [w for w in words if w.isascii() or any(map(str.isalpha, w))]
                        ids.extend(map(known.__getitem__, words))
                        sizes.extend(map(len, words))
                        lengths.append(len(words))
                    lengths, sizes = np.array(lengths, np.int64), np.array(sizes, np.float64)
                    path = viterbi(known.scored(), np.array(ids, np.int64), lengths, switch)
                    k, doc = len(model.langs), np.repeat(np.arange(rows), lengths)
                    letters = np.bincount(doc * k + path, sizes, rows * k).reshape(rows, k)
                    cuts = np.flatnonzero(np.diff(doc * k + path, prepend=-1))
                    ends, begin = np.append(cuts[1:], len(path)), np.cumsum(lengths) - lengths
                    for a, b in zip(cuts.tolist(), ends.tolist()):
                        spans[doc[a]].append({"first_word": a - begin[doc[a]], "words": b - a, "lang": model.langs[path[a]]})
                    best = letters.argmax(axis=1)
                    for i in np.flatnonzero(lengths):
                        pred[i], share[i] = model.langs[best[i]], float(letters[i, best[i]] / letters[i].sum())
                arrays = [*batch.columns, pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(spans, span_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_lang_pred", "_lang_score", "_lang_spans"])

    return small_batches(docs).mapInArrow(run, added)


#: Words of a span that is sure of its language; a text of fewer words is one span.
SURE = 3


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Documents in languages: some letters, and at least ``least`` of the words in spans of SURE words or more.

    The languages may be as many as they like. Where no document is labelled,
    nothing can be learned, and all texts with letters are kept. Columns come
    back as they were, whatever their names are.
    """
    model = fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # under names of its own; the text travels once
    told = label(docs.select(*[F.col(c).alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)]), model)
    words = F.aggregate("_lang_spans", F.lit(0), lambda n, s: n + s["words"])
    sure = F.aggregate("_lang_spans", F.lit(0), lambda n, s: n + F.when(s["words"] >= F.least(F.lit(SURE), words), s["words"]).otherwise(0))
    return told.where((F.col("_lang_pred") != "und") & (sure >= least * words)).select(
        *[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return label(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", held, F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))
