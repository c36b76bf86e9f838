"""Toxicity scores from a learned lexicon, matched through Levenshtein automata, and the words around each match."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, fold, sliced, table

#: Labelled documents that are learned from, at most; drawn by a hash of the id.
SAMPLE = 20_000
#: Terms and stems of the lexicon, at most; the strongest ones.
TERMS = 4_000
#: A learned term is so much likelier in a toxic document than in another one.
ODDS = 12.0
#: Words on either side that decide whether a match is quoted.
CONTEXT = 5
CACHED = 250_000
_STRIP = ".,;:!?()[]{}<>«»“”„‘’\"'`…-–—*_#~|/\\%&$+="
_QUOTES = ("\"", "“", "”", "„", "«", "»", "‘", "’", "'")

# Words that report what others say.
REPORTS = frozenset("""said says saying called calls calling quoted quote quotes wrote writes written reported reports
    word words term terms slur slurs insult insults phrase moderation moderator sagte sagt nannte schrieb zitat zitiert
    wort beleidigung dit dite appelé écrit cité citation mot insulte dijo dice llamó escribió cita palabra insulto""".split())


def allowed(term: str) -> int:
    """Edits a term may be misspelled by."""
    n = len(term.rstrip("*"))
    return 0 if n < 5 else 1 if n < 9 else 2


class Matcher:
    """The lexicon's trie, crossed with the Levenshtein automata of its terms.

    A state is the set of (trie node, edits so far) that some reading of the
    letters leads to; the deterministic steps between such sets are worked out
    when first needed and kept. A word that leaves the lexicon's neighbourhood
    reaches the empty set after a few letters. ``stem*`` matches every word
    that begins like the stem.
    """

    def __init__(self, lexicon: dict[str, float], clean: frozenset[str] = frozenset()):
        self.clean = clean
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.edits: list[int] = [0]  # most edits of any term below
        self.own: list[int] = [-1]  # edits of the term that ends here
        for term, weight in sorted(lexicon.items()):
            node, k = 0, allowed(term)
            self.edits[0] = max(self.edits[0], k)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for column, value in ((self.word, 0.0), (self.stem, 0.0), (self.edits, 0), (self.own, -1)):
                        column.append(value)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], k)
            column = self.stem if term.endswith("*") else self.word
            column[node] = max(column[node], weight)
            self.own[node] = max(self.own[node], k)
        self.start = self._closed({0: 0})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, tuple] = {}

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With the nodes that are reached by leaving out letters of a term."""
        stack = list(nodes)
        while stack:
            n = stack.pop()
            for child in self.children[n].values():
                if nodes[n] + 1 <= self.edits[child] and nodes[n] + 1 < nodes.get(child, 9):
                    nodes[child] = nodes[n] + 1
                    stack.append(child)
        return frozenset(nodes.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out: dict[int, int] = {}
        for n, e in state:
            if e + 1 <= self.edits[n]:
                out[n] = min(out.get(n, 9), e + 1)
            for letter, child in self.children[n].items():
                cost = e + (letter != c)
                if cost <= self.edits[child] and cost < out.get(child, 9):
                    out[child] = cost
        self.steps[state, c] = closed = self._closed(out)
        return closed

    def _end(self, state: frozenset) -> tuple:
        """(weight, edits) of the best whole term and the best stem that the state accepts."""
        best = []
        for column in (self.word, self.stem):
            hits = [(column[n] * 0.7 ** e, -e) for n, e in state if column[n] and e <= self.own[n]]
            best.append(max(hits, default=(0.0, 0)))
        self.ends[state] = tuple(best)
        return self.ends[state]

    def find(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the best match; weight 0 if there is none."""
        if len(self.steps) > CACHED:
            self.steps.clear()
            self.ends.clear()
        state, best = self.start, (0.0, 0)
        for c in word:
            state = self.steps.get((state, c)) or self._step(state, c)
            if not state:
                break
            stem = (self.ends.get(state) or self._end(state))[1]
            best = max(best, stem)
        else:
            if word:
                best = max(best, (self.ends.get(state) or self._end(state))[0])
        weight, edits = best[0], -best[1]
        return (0.0, 0) if edits and word in self.clean else (weight, edits)


class _Tokens(dict):
    """Written word -> (weight, edits), () for no match."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, token: str):
        weight, edits = self.matcher.find(token.strip(_STRIP))
        self[token] = out = (weight, edits) if weight > 0 else ()
        return out


def matches(tokens: list[str], found: list) -> list[tuple[int, float, int, bool]]:
    """(place, weight, edits, quoted) of each match.

    Quoted: an opening mark before the word and a closing one behind it, both
    within the window, or a reporting word within the window.
    """
    out = []
    for i, hit in enumerate(found):
        if hit:
            before, after = tokens[max(0, i - CONTEXT):i + 1], tokens[i:i + 1 + CONTEXT]
            marks = any(t.startswith(_QUOTES) for t in before) and any(t.rstrip(".,;:!?").endswith(_QUOTES) for t in after)
            told = any(t.strip(_STRIP) in REPORTS for t in before[:-1] + after[1:])
            out.append((i, hit[0], hit[1], marks or told))
    return out


FEATURES = 6


def features(tokens: list[str], found: list) -> list[float]:
    """Masses of exact, misspelled and quoted matches, their number, their density, any."""
    exact = fuzzy = quoted = 0.0
    hits = matches(tokens, found)
    for _, weight, edits, inside in hits:
        if inside:
            quoted += weight
        elif edits:
            fuzzy += weight
        else:
            exact += weight
    plain = sum(not q for *_, q in hits)
    return [float(np.log1p(exact)), float(np.log1p(fuzzy)), float(np.log1p(quoted)), float(np.log1p(plain)),
            100 * plain / (len(tokens) + 20), float(plain > 0)]


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Texts with their mean label, outside the held-out fold."""
    marks = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > limit:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(marks, "doc_id").select("text", "toxic")


def _term_counts(sample: DataFrame) -> DataFrame:
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                sums = (Counter(), Counter())
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                    words = {w for t in set(text.lower().split()) if len(w := t.strip(_STRIP)) > 3}
                    sums[toxic != 1].update(words | {w[:k] + "*" for w in words for k in (4, 5) if len(w) > k})
                terms = list(sums[0] | sums[1])
                yield batch_of(schema, {"term": terms, "toxic": [sums[0][t] for t in terms], "other": [sums[1][t] for t in terms]})

    return sample.mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (bias last) of an L2 logistic regression, by Newton steps; match weights are not negative but for the quoted mass."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.diag([penalty] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    def __init__(self, matcher: Matcher | None, weights: np.ndarray):
        self.matcher, self.weights = matcher, weights


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Scorer:
    """Lexicon and weights from ``sample`` labelled documents at most, outside the held-out fold.

    Words and word beginnings that are ODDS times likelier in toxic documents
    make the lexicon, ``terms`` of them at most. Other words of at least two
    clean documents never count as misspellings. Without labelled toxic rows
    every score is the share of toxic labels, 0 where there are no labels.
    """
    rows = _sample(docs, labels, sample).persist()
    try:
        n_toxic, n_all = rows.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count("*")).first()
        n_toxic = n_toxic or 0
        if not n_toxic or n_toxic == n_all:
            share = n_toxic / n_all if n_all else 0.0
            return Scorer(None, np.array([np.log((share + 1e-9) / (1 - share + 1e-9))]))
        counts = _term_counts(rows).persist()
        odds = ((F.col("toxic") + 0.2) / n_toxic) / ((F.col("other") + 0.2) / (n_all - n_toxic))
        least = max(3, round(0.003 * n_toxic))
        strong = counts.where((F.col("toxic") >= least) & (odds >= ODDS)).select("term", F.log(odds).alias("weight"))
        lexicon = {r["term"]: float(r["weight"]) for r in strong.orderBy(F.desc("weight"), "term").limit(terms).collect()}
        matcher = Matcher(lexicon)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [w for w in batch.column("term").to_pylist() if w not in lexicon and matcher.find(w)[1]]
                yield pa.RecordBatch.from_pydict({"term": pa.array(hit, pa.string())})

        often = counts.where((F.col("other") >= 2) & (F.col("other") * n_toxic >= F.col("toxic") * (n_all - n_toxic)) & ~F.col("term").endswith("*"))
        matcher = Matcher(lexicon, frozenset(r["term"] for r in often.select("term").mapInArrow(near, "term string").collect()))
        counts.unpersist()
        seen = _scored(rows, matcher).select("toxic", "_features").collect()
        x, y = np.array([r["_features"] for r in seen]), np.array([r["toxic"] == 1 for r in seen], float)
        w = _regression(x, y)
        if not x[:, 2].any():  # no quoted match was seen: it counts a little for the match it is
            w[2] = 0.2 * max(0.0, w[0])
        return Scorer(matcher, w)
    finally:
        rows.unpersist()


def _scored(docs: DataFrame, matcher: Matcher) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("_features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = _Tokens(matcher), [0.0] * FEATURES
        for whole in batches:
            for batch in sliced(whole, "text"):
                if len(known) > CACHED:
                    known = _Tokens(matcher)
                find, out = known.__getitem__, []
                for text in batch.column("text").to_pylist():
                    tokens = text.lower().split() if text else []
                    found = list(map(find, tokens))
                    out.append(features(tokens, found) if any(found) else none)
                keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.list_(pa.float64()))],
                                                 names=[*(batch.schema.names[i] for i in keep), "_features"])

    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, model: Scorer) -> DataFrame:
    """The columns of ``docs`` but text, and _score in 0..1; null and empty texts get the score of a text without matches."""
    w = [float(v) for v in model.weights]
    if model.matcher is None:
        return docs.drop("text").withColumn("_score", F.lit(float(1 / (1 + np.exp(-w[0])))))
    total = F.lit(w[-1])
    for i, v in enumerate(w[:-1]):
        total = total + F.col("_features")[i] * v
    return _scored(docs, model.matcher).withColumn("_score", 1 / (1 + F.exp(-total))).drop("_features")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return scores(docs, model).select("doc_id", held, F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
