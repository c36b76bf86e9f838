"""Mixture-controlled packing of documents into token windows by deficit round-robin."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, stored, table
from opsloom.llm.tokens import BYTE_BPE, tokenized, wide

WINDOW = 2048
#: Windows of one block; the unit whose schedule is worked out in one go.
BLOCK = 256
#: A source waits until its deficit is worth a piece of this many tokens.
LEAST = 64


class Schedule:
    """Which tokens of which source's queue lie where.

    The queue of source s holds totals[s] tokens. Targets are the shares of
    the totals, so that all queues run dry together. By the start of block b
    source s has been served floor(totals[s] * b * size / all) tokens, the
    largest source the rest: what a block owes a source is carried to the
    next in closed form, and any task can start at any block. Inside a block
    the windows are filled one after the other by deficit round-robin.
    """

    def __init__(self, totals: list[int], window: int = WINDOW, block: int = BLOCK, least: int = LEAST):
        self.totals, self.window, self.least = totals, window, least
        self.all = sum(totals)
        self.big = max(range(len(totals)), key=lambda s: (totals[s], -s)) if totals else 0
        # a block serves its largest source more than the others' rounding can take back
        self.block = max(block, -(-4 * len(totals) ** 2 // window))
        self.size = self.block * window
        self.blocks = -(-self.all // self.size)
        self._known: dict[int, dict[int, list[tuple[int, int, int, int]]]] = {}

    def served(self, s: int, b: int) -> int:
        if b >= self.blocks:
            return self.totals[s]
        if s != self.big:
            return self.totals[s] * b * self.size // self.all
        return b * self.size - sum(t * b * self.size // self.all for k, t in enumerate(self.totals) if k != s)

    def block_of(self, s: int, at: int) -> int:
        low, high = 0, self.blocks - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.served(s, mid) <= at else (low, mid - 1)
        return low

    def fill(self, b: int) -> dict[int, list[tuple[int, int, int, int]]]:
        """source -> its pieces in queue order: (first token, length, sequence, offset)."""
        if b in self._known:
            return self._known[b]
        at = np.array([self.served(s, b) for s in range(len(self.totals))], dtype=np.int64)
        left = np.array([self.served(s, b + 1) for s in range(len(self.totals))], dtype=np.int64) - at
        total = int(left.sum())
        rest = total % self.window
        lengths = [self.window] * (total // self.window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        share, deficit = left / max(1, total), np.zeros(len(left))
        out: dict[int, list[tuple[int, int, int, int]]] = {}

        def give(s: int, n: int, sequence: int, offset: int) -> None:
            out.setdefault(s, []).append((int(at[s]), n, sequence, offset))
            at[s] += n
            left[s] -= n
            deficit[s] -= n

        for w, length in enumerate(lengths):
            sequence, offset = b * self.block + w, 0
            deficit += share * length
            due = np.flatnonzero((deficit >= self.least) & (left > 0))
            for s in np.roll(due, -(w % max(1, len(due)))).tolist():
                n = min(int(deficit[s]), int(left[s]), length - offset)
                if n > 0:
                    give(s, n, sequence, offset)
                    offset += n
            while offset < length:  # the window is never left open: the largest deficits are served early
                s = int(np.argmax(np.where(left > 0, deficit, -np.inf)))
                n = min(int(left[s]), length - offset, max(self.least, int(deficit[s])))
                give(s, n, sequence, offset)
                offset += n
        if len(self._known) >= 64:
            self._known.pop(next(iter(self._known)))
        self._known[b] = out
        return out

    def pieces(self, s: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """The pieces that cover tokens start .. start + n of the queue."""
        b, at, end = self.block_of(s, start), start, start + n
        while at < end:
            own = self.fill(b).get(s, [])
            low, high = 0, len(own)
            while low < high:  # first piece that ends behind ``at``
                mid = (low + high) // 2
                low, high = (mid + 1, high) if own[mid][0] + own[mid][1] <= at else (low, mid)
            for first, length, sequence, offset in own[low:]:
                stop = min(first + length, end)
                yield at, stop - at, sequence, offset + at - first
                at = stop
                if at == end:
                    return
            b += 1


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, row_id long, ids binary")


def pack(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = 1, window: int = WINDOW, with_ids: bool = True,
         added: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens. ``ids`` are a piece's little-endian 32-bit ids.

    ``row_id`` tells the rows of one doc_id apart.

    Queues hold a source's documents in order of doc_id. Every window gets the
    sources in the shares of their tokens, up to LEAST tokens that a source
    waits for. Windows are full; only the last tokens of the corpus, fewer
    than a window, make sequences of powers of two. No padding remains.

    Null text: only the end id. Null sources are one queue. Repeated rows are
    packed each. Empty table: no rows. One number per source goes to the driver.
    """
    rows = stored(tokenized(docs, tokenizer, end_id, added), "packed-ids")
    per = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    sums = {r[0]: r[1] for r in per.groupBy("source").agg(F.sum("n")).collect()}
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    number, totals = {s: i for i, s in enumerate(names)}, [sums[s] for s in names]
    base = per.select(F.col("part").alias("p"), F.col("source").alias("s"),
                      (F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"))
    base = stored(base, "packed-bases")  # its size is then known: where it is small, the ids need no shuffle
    placed = rows.join(base, (rows["part"] == base["p"]) & rows["source"].eqNullSafe(base["s"])).select(
        "doc_id", "source", "n", (F.col("base") + F.col("before")).alias("at"), "width", "ids",
        F.expr("shiftleft(cast(part as bigint), 40) + row").alias("row_id"))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                       + [("source", pa.string()), ("row_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(totals, window)
        names = [f.name for f in schema]
        for batch in batches:
            out: list[tuple] = []
            for doc, source, n, at, width, ids, row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "n", "at", "width", "ids", "row_id"))):
                data = memoryview(wide(ids, width).tobytes())
                for first, length, sequence, offset in plan.pieces(number[source], at, n):
                    start = first - at
                    own = data[4 * start:4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(own), n, sequence, offset, source, row, bytes(own) if with_ids else None))
                if len(out) > 50_000:
                    yield batch_of(schema, dict(zip(names, zip(*out))))
                    out = []
            if out:
                yield batch_of(schema, dict(zip(names, zip(*out))))

    return placed.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the ids of each sequence, little-endian, 32 bits each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), with_ids=False, added=True))
