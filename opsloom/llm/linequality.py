"""Quality rules: counts of words, symbols and repeats, and content lines marked by a linear-chain random field."""

from __future__ import annotations

import operator
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.common import fold, sliced, small_batches, table

#: Labelled documents that are learned from, at most, drawn by a hash of the id; ones of more lines are not.
SAMPLE, LINES = 1000, 128
#: Labelled rows of the last of so many folds are left for tests.
FOLDS = 5
#: Rounds in which single lines of bad documents are labelled anew, and gradient steps of each and of the chain.
ROUNDS, STEPS = 2, 100
#: Rules of the contract: least words, window of repeats, share of repeated words in hundredths.
LEAST_WORDS, WINDOW, REPEATED = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])  # bytes of other scripts count as letters
_MARK = b".,;:?!"
FEATURES = 12


def line_features(line: bytes, words: list[bytes], again: bool) -> tuple[float, ...]:
    """Shares of letters, marks and repeats in a line of at least one word; ``again``: an earlier line is the same."""
    n, size = len(words), len(line)
    letters = size - len(line.translate(None, _LETTER))
    rest = line.translate(None, _LETTER)
    marks = len(rest) - len(rest.translate(None, _MARK))
    digits = len(rest) - len(rest.translate(None, _DIGIT))
    upper = size - len(line.translate(None, _UPPER))
    odd = len(rest.translate(None, _MARK + _DIGIT + b" \t\r\v\f'\"()-"))
    return (
        1.0, upper / (letters + 1), min(1.0, 3 * odd / size), min(1.0, marks / n), digits / size,
        1 - len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, float(again), min(1.0, n / 40),
        float(words[-1][-1:] in (b".", b"!", b"?", b":")), min(1.0, letters / n / 16), float(n < 4),
    )


@dataclass
class Field:
    """Weights of a chain of two labels: features by label, label to label, first label; least share of content."""
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray
    share: float = 0.5

    def viterbi(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label of every line of many texts; x holds the lines of the texts one after the other."""
        score = x @ self.emit
        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        open_ = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
        value, back = np.zeros((len(lengths), 2)), np.zeros((len(x), 2), np.int8)
        for t, a in enumerate(open_):
            rows = first[:a] + t
            if t:
                ways = value[:a, :, None] + self.move
                back[rows] = ways.argmax(axis=1)
                value[:a] = ways.max(axis=1) + score[rows]
            else:
                value[:a] = self.start + score[rows]
        label, out = value.argmax(axis=1), np.zeros(len(x), np.int64)
        for t in range(len(open_) - 1, -1, -1):
            rows = first[:open_[t]] + t
            out[rows] = label[:open_[t]]
            label[:open_[t]] = back[rows, label[:open_[t]]]
        return out


def _likelihood(field: Field, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Gradient of the log likelihood of the labels by forward and backward sums; x and y are padded to (text, line)."""
    texts, steps, _ = x.shape
    here = np.arange(steps) < lengths[:, None]
    score = x @ field.emit
    ahead, behind = np.zeros((texts, steps, 2)), np.zeros((texts, steps, 2))
    ahead[:, 0] = field.start + score[:, 0]
    for t in range(1, steps):
        ways = ahead[:, t - 1, :, None] + field.move
        ahead[:, t] = np.where(here[:, t, None], np.logaddexp(ways[:, 0], ways[:, 1]) + score[:, t], ahead[:, t - 1])
    for t in range(steps - 2, -1, -1):
        ways = field.move + (score[:, t + 1] + behind[:, t + 1])[:, None, :]
        behind[:, t] = np.where(here[:, t + 1, None], np.logaddexp(ways[:, :, 0], ways[:, :, 1]), 0)
    whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
    one = np.exp(ahead + behind - whole) * here[:, :, None]
    true = np.eye(2)[y] * here[:, :, None]
    pair = np.exp(ahead[:, :-1, :, None] + field.move + (score + behind)[:, 1:, None, :] - whole[..., None]) * here[:, 1:, None, None]
    moved = true[:, :-1, :, None] * true[:, 1:, None, :]
    return [np.einsum("tlf,tlk->fk", x, true - one), (moved - pair).sum(axis=(0, 1)), (true - one)[:, 0].sum(axis=0)]


def _climb(parts: list[np.ndarray], gradient: Callable[[], list[np.ndarray]], steps: int, rate: float = 0.2) -> None:
    """Adam; changes the parts in place."""
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        for k, g in enumerate(gradient()):
            g = g - 1e-4 * parts[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            parts[k] += rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-9)


def learn(texts: list[np.ndarray], sizes: list[np.ndarray], good: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> Field | None:
    """The field from the lines' features of good and bad documents, and the share of content that parts them best.

    Lines of good documents are content. Those of bad ones are boilerplate at
    first; then a field without moves says line by line which of them are
    content, though at least one stays boilerplate. With these labels the
    whole field is learned. None without both kinds.
    """
    if not (good.any() and (~good).any()):
        return None
    lengths = np.array([len(t) for t in texts])
    flat, cuts = np.concatenate(texts), np.cumsum(lengths)[:-1]
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    y = np.repeat(np.where(good, CONTENT, BOILERPLATE), lengths)
    bad = np.repeat(~good, lengths)
    for _ in range(rounds):
        def by_line() -> list[np.ndarray]:
            score = flat @ field.emit
            return [flat.T @ (np.eye(2)[y] - np.exp(score - np.logaddexp(score[:, :1], score[:, 1:]))) / len(flat)]

        _climb([field.emit], by_line, steps)
        label = np.split((flat @ field.emit).argmax(axis=1), cuts)
        found = np.concatenate([k if k.any() else np.full(len(k), BOILERPLATE) for k in label])
        y = np.where(bad, found, CONTENT)
    x, marked = np.zeros((len(texts), lengths.max(), FEATURES)), np.zeros((len(texts), lengths.max()), np.int64)
    for i, (t, k) in enumerate(zip(texts, np.split(y, cuts))):
        x[i, :len(t)], marked[i, :len(t)] = t, k
    _climb([field.emit, field.move, field.start], lambda: [g / len(flat) for g in _likelihood(field, x, marked, lengths)], steps)
    label = np.split(field.viterbi(flat, lengths), cuts)
    share = np.array([s[k == CONTENT].sum() / max(1, s.sum()) for s, k in zip(sizes, label)])
    tried = np.unique(np.append(share, 1.0))
    middle = np.append(tried[0], (tried[1:] + tried[:-1]) / 2)
    # among bounds that part the two kinds equally well the one that keeps most
    wrong = [(np.mean(share[good] < b) + np.mean(share[~good] >= b), b) for b in middle]
    field.share = float(min(wrong)[1])
    return field


def _lines(text: str | None) -> tuple[list[bytes], list[list[bytes]]]:
    lines = text.encode("utf-8", "surrogatepass").split(b"\n") if text else []
    words = [line.split() for line in lines]  # bytes are split at blank, tab, line feed, vertical tab, form feed, carriage return
    return [line for line, w in zip(lines, words) if w], [w for w in words if w]


def _described(text: str | None) -> tuple[list[tuple], list[int], int, list[bytes]]:
    """Features and sizes (code points in words) of the lines with a word, number of repeated lines, words."""
    lines, split = _lines(text)
    seen: set[bytes] = set()
    features, sizes, repeated = [], [], 0
    plain = text is not None and text.isascii()
    for line, words in zip(lines, split):
        again = line in seen
        repeated += again
        seen.add(line)
        features.append(line_features(line, words, again))
        joined = b"".join(words)
        sizes.append(len(joined) if plain else len(joined.decode("utf-8", "surrogatepass")))
    return features, sizes, repeated, [w for words in split for w in words]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Field | None:
    """The field from ``sample`` labelled documents of at most ``lines`` lines; None where good or bad ones are missing.

    Of rows that share an id the least text and label are taken. Only the
    lines' features reach the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", FOLDS) != FOLDS - 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    drawn = known.where(F.abs(F.xxhash64("doc_id") / F.lit(float(1 << 63))) < sample / max(1, n))
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("quality").alias("quality"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                out: list[list] = [[], [], [], []]
                for doc_id, text, quality in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "quality"))):
                    features, sizes, _, _ = _described(text)
                    if 0 < len(features) <= lines:
                        for column, value in zip(out, (doc_id, quality, np.array(features, np.float32).tobytes(), sizes)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()),
                                                  pa.array(out[3], pa.list_(pa.int64()))], names=["doc_id", "quality", "features", "sizes"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality")).mapInArrow(
        described, "doc_id long, quality int, features binary, sizes array<long>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return learn([np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows],
                 [np.array(r["sizes"]) for r in rows], np.array([r["quality"] == 1 for r in rows], bool))


def repeated_words(words: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Per text the words in windows of WINDOW words that it holds twice or more; ``words`` of the texts one after the other."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n = len(ids) - WINDOW + 1
    if n < 1:
        return np.zeros(len(lengths), np.int64)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    mixed = doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(WINDOW):
        mixed = (mixed ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    at, mixed = at[order], mixed[order]
    near = mixed[1:] == mixed[:-1]
    same = near & (doc[at[1:]] == doc[at[:-1]])
    for k in range(WINDOW):
        same &= ids[at[1:] + k] == ids[at[:-1] + k]
    if (near != same).any():  # two windows share a hash: order by the words themselves
        order = np.lexsort([*(ids[at + k] for k in range(WINDOW)), doc[at]])
        at = at[order]
        same = doc[at[1:]] == doc[at[:-1]]
        for k in range(WINDOW):
            same &= ids[at[1:] + k] == ids[at[:-1] + k]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(ids) + 1, np.int64)
    cover += np.bincount(at[twice], minlength=len(cover)) - np.bincount(at[twice] + WINDOW, minlength=len(cover))
    return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=len(lengths))


ADDED = [("_n_words", T.LongType(), pa.int64()), ("_word_chars", T.LongType(), pa.int64()), ("_n_symbols", T.LongType(), pa.int64()),
         ("_n_dup_lines", T.LongType(), pa.int64()), ("_n_repeat_words", T.LongType(), pa.int64()), ("_base_failed", T.BooleanType(), pa.bool_()),
         ("_content", T.DoubleType(), pa.float64()), ("_labels", T.BinaryType(), pa.binary()), ("_kept", T.BooleanType(), pa.bool_())]


def judged(docs: DataFrame, field: Field | None) -> DataFrame:
    """All columns of ``docs`` and those of ADDED, for whole texts.

    ``_labels`` has a byte per line with a word, 0 for content and 1 for
    boilerplate; ``_content`` is the share of code points of words in content
    lines. A text is kept if it fails no base rule and its share is at least
    the field's. Without a field all lines are content. Null and empty texts
    have no words and fail. Ties of two paths go to content.
    """
    schema = T.StructType(docs.schema.fields + [T.StructField(name, kind) for name, kind, _ in ADDED])
    share = field.share if field else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 2 << 20):
                features, sizes, words, rows = [], [], [], []
                for text in batch.column("text").to_pylist():
                    own, size, repeated, split = _described(text)
                    raw = text.encode("utf-8", "surrogatepass") if text else b""
                    rows.append((len(split), sum(size), len(raw) - len(raw.translate(None, SYMBOLS)), repeated, len(own)))
                    features.extend(own)
                    sizes.extend(size)
                    words.extend(split)
                n, chars, symbols, repeated, lines = np.array(rows, np.int64).T
                again = repeated_words(words, n)
                x, sizes = np.array(features, np.float64).reshape(-1, FEATURES), np.array(sizes, np.int64)
                label = field.viterbi(x, lines) if field else np.zeros(len(x), np.int64)
                doc = np.repeat(np.arange(len(rows)), lines)
                content = np.bincount(doc, sizes * (label == CONTENT), len(rows)) / np.maximum(chars, 1)
                failed = (n < LEAST_WORDS) | (100 * again > REPEATED * n)
                marks = label.astype(np.uint8).tobytes()
                ends = np.cumsum(lines)
                values = [n, chars, symbols, repeated, again, failed, content,
                          [marks[e - k:e] for e, k in zip(ends.tolist(), lines.tolist())], ~failed & (content >= share)]
                arrays = [*batch.columns, *(pa.array(v, kind) for v, (_, _, kind) in zip(values, ADDED))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *(name for name, _, _ in ADDED)])

    return small_batches(docs).mapInArrow(run, schema)


def op12_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judged(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), F.col("_content").alias("content_share"))
