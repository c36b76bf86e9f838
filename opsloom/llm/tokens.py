"""Token ids of whole texts, from a vocabulary file of the tokenizers library."""

from __future__ import annotations

import array
import gc
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, sliced, small_batches

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Bytes of pieces and ids that a worker keeps; beyond half of them those not asked for since the last time go. Pieces
#: of over PIECE characters are not kept; an entry takes ENTRY bytes besides its text.
CACHED, PIECE, ENTRY = 96 << 20, 64, 200
#: Sampled ids for each part of the id ranges.
PER_PART = 64
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_EDGE = r"\n -&(-@\[-`{-~"
#: A word that every pre-tokenizer of this kind cuts out whole: letters up to a plain ASCII sign, with the blank before
#: it. The apostrophe is no such sign (contractions), and a run of white space before it belongs to the other pieces.
_CUT = re.compile(rf"((?: |(?<![^{_EDGE}])(?<!\s\s))[{_LETTERS}]+(?=[{_EDGE}]|\Z))")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+\Z")
_loaded: dict[tuple, Callable] = {}


def _shown() -> dict[int, str]:
    """Blank and Latin letters as byte-level vocabularies show their UTF-8 bytes: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in (32, *range(192, 256))}


def _model_words(tokenizer, spec: dict):
    """For words of Latin letters: the model alone, with the normalizer's and pre-tokenizer's known effect; None if unlike the whole."""
    shown = _shown()
    fold = "Lowercase" in json.dumps(spec.get("normalizer"))
    model = tokenizer.model

    def direct(word: str) -> list[int]:
        if fold:
            word = word.strip().lower()
        return [t.id for t in model.tokenize(word.translate(shown))]

    probes = ["the", " the", "The", " ThE", "zq", " zq", "a", " I", "Ntt", " internationalization", "don", " ll", "EWRe", "É", " été", "Öl", " ÑANDÚ", "straße", " ÿþ"]
    return direct if all(direct(w) == tokenizer.encode(w, add_special_tokens=False).ids for w in probes) else None


def encoder(path: str, added: bool = False) -> Callable[[str], bytes]:
    """text -> its ids, little-endian, two bytes each (four where the vocabulary is larger).

    Texts are cut at places where the whole text is cut anyway, and the ids of
    a piece are remembered, so that a word is encoded once per worker. With
    ``added`` the strings of added tokens get their own ids, as the library
    does it unless told otherwise; without it they are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    kind = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    direct = _model_words(tokenizer, spec)
    tokens = spec.get("added_tokens") or [] if added else []
    # the library cuts the text at plain ones before anything else, the longest of several first
    own = {t["content"]: array.array(kind, [t["id"]]).tobytes() for t in tokens}
    apart = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")").split if own else None
    cuttable = not any(t[k] for t in tokens for k in ("normalized", "lstrip", "rstrip", "single_word"))

    class Pieces(dict):
        held, before = 0, {}

        def __missing__(self, piece: str) -> bytes:
            out = self.before.get(piece)
            if out is None:
                ids = direct(piece) if direct and _PLAIN.match(piece) else tokenizer.encode(piece, add_special_tokens=False).ids
                out = array.array(kind, ids).tobytes()
                if len(piece) > PIECE:
                    return out
            if self.held > CACHED // 2:
                self.before, self.held = dict(self), 0
                self.clear()
            self[piece] = out
            self.held += ENTRY + len(piece) + len(out)
            return out

    find, split = Pieces().__getitem__, _CUT.split

    def encode(text: str) -> bytes:
        if not cuttable:
            return array.array(kind, tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if apart and any(t in text for t in own):
            return b"".join(own[p] if i % 2 else b"".join(map(find, filter(None, split(p)))) for i, p in enumerate(apart(text)))
        return b"".join(map(find, filter(None, split(text))))

    encode.width = 2 if kind == "H" else 4
    return encode


def cached_encoder(name: str, added: bool = False) -> Callable[[str], bytes]:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if (name, added) not in _loaded:
        _loaded.clear()
        _loaded[name, added] = encoder(name if os.path.sep in name else public_tokenizers.path(name), added)
        gc.set_threshold(500_000, 50, 100)  # many small kept objects, hardly any cycles
    return _loaded[name, added]


LEAST_ID = -(1 << 63)


def id_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Bounds between ``parts`` ranges of doc_id from a sample of ids alone; null ids count as the least."""
    n = docs.count()
    drawn = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id")).sample(min(1.0, PER_PART * parts / max(1, n)), 17)
    ids = np.sort(np.array([r["id"] for r in drawn.collect()], np.int64))
    return ids[np.arange(1, parts) * len(ids) // parts] if len(ids) else ids


def part_of(bounds: np.ndarray, ids: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The range of each id. An id that is several bounds (a hot one) is dealt to the ranges between them by its salt."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return (low + salt % (high - low + 1)).astype(np.int32)


ENCODED = "part int, doc_id long, source string, n long, width int, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1, added: bool = False) -> DataFrame:
    """One row per document, dealt by ranges of doc_id and in that order inside a part.

    n counts the ids with the closing ``end_id``. Null text is empty. Texts are
    encoded where they are read, so that ids and not texts are shuffled and no
    text is read for the ranges. Null ids come first. Rows of one id stay
    apart; they lie beside each other, in the order of their ids.
    """
    small_batches(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = id_bounds(docs, parts)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached_encoder(tokenizer, added)
        end = np.array([end_id], "<u2" if encode.width == 2 else "<u4").tobytes()
        for whole in batches:
            for batch in sliced(whole, "text"):
                ids = [encode(t) + end if t else end for t in batch.column("text").to_pylist()]
                own = batch.column("doc_id").fill_null(LEAST_ID).to_numpy()
                part = part_of(bounds, own, np.fromiter(map(zlib.crc32, ids), np.int64, len(ids)))
                yield batch_of(schema, {"part": part, "doc_id": batch.column("doc_id"), "source": batch.column("source"),
                                        "n": [len(x) // encode.width for x in ids], "width": [encode.width] * len(ids), "ids": ids})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, ENCODED)
    return rows.repartitionById(parts, "part").sortWithinPartitions("doc_id", "ids", "source")


TOKENS = "part int, row long, doc_id long, source string, n long, before long, width int, ids binary"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1, added: bool = False) -> DataFrame:
    """``encoded`` rows with their number in the part and the ids of earlier documents of the same source in it."""
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()),
                        ("before", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, before = 0, {}
        for batch in batches:
            starts = []
            for source, k in zip(batch.column("source").to_pylist(), batch.column("n").to_pylist()):
                starts.append(before.get(source, 0))
                before[source] = starts[-1] + k
            own = {c: batch.column(c) for c in ("part", "doc_id", "source", "n", "width", "ids")}
            yield batch_of(schema, own | {"row": range(row, row + batch.num_rows), "before": starts})
            row += batch.num_rows

    return encoded(docs, tokenizer, end_id, added).mapInArrow(run, TOKENS)


def wide(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4")
