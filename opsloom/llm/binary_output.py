"""Token ids as binary shards with Elias-Fano document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, stored, table
from opsloom.llm.tokens import WORD_BPE, encoded, wide

#: Bytes of ids after which a shard is closed.
SHARD_BYTES = 4 << 20
#: One select sample per so many values.
SAMPLE = 256
_MAGIC = b"TOKEF001"


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value, with direct access.

    A value's low bits lie in a packed array. Its high part h is the bit at
    h + i of the upper bits, i being its place. ``samples`` holds the place of
    every SAMPLE-th one bit, so that select scans one short stretch.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        low = np.packbits((v[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        upper[ones] = 1
        return cls(n, bits, low.tobytes(), np.packbits(upper, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple["EliasFano", int]:
        n, bits, low, high, samples = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        out = cls(n, bits, bytes(data[at:at + low]), bytes(data[at + low:at + low + high]),
                  np.frombuffer(data[at + low + high:at + low + high + 8 * samples], "<u8"))
        return out, at + low + high + 8 * samples

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def __getitem__(self, i: int) -> int:
        """Value i, by select from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        seen, byte = i // SAMPLE * SAMPLE, at // 8
        upper = np.frombuffer(self.high, np.uint8)
        skip = at % 8
        while True:
            places = np.flatnonzero(np.unpackbits(upper[byte:byte + 64], bitorder="little"))
            places = places[places >= skip]
            if seen + len(places) > i:
                one = byte * 8 + int(places[i - seen])
                return (one - i << self.low_bits) + int(self._low(i, 1)[0])
            seen, byte, skip = seen + len(places), byte + 64, 0

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) + self._low(0, self.n)


def encode_shard(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """The file image of documents in ascending id order, null ids first.

    Head, Elias-Fano boundaries (0, then the end of each document), Elias-Fano
    document ids above the least one, then the ids one after the other.
    """
    ends = np.cumsum([0, *(len(x) // width for x in ids)])
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    head = _MAGIC + struct.pack("<BQQq", width, len(ids), len(doc_ids) - len(known), base)
    return b"".join([head, EliasFano.of(ends).to_bytes(), EliasFano.of(np.array([d - base for d in known], np.uint64)).to_bytes(), *ids])


class Shard:
    """Reads a file image; ``bounds[i]`` and ``document(i)`` need no table of offsets."""

    def __init__(self, image: bytes):
        data = memoryview(image)
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not a token shard")
        self.width, self.n, nulls, base = struct.unpack_from("<BQQq", data, 8)
        self.bounds, at = EliasFano.from_bytes(data, 8 + struct.calcsize("<BQQq"))
        ids, at = EliasFano.from_bytes(data, at)
        self.doc_ids = [None] * nulls + [base + int(v) for v in ids.values()]
        self.tokens = np.frombuffer(data[at:], "<u2" if self.width == 2 else "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.tokens[self.bounds[i]:self.bounds[i + 1]]


SHARDS = "part int, seq int, docs long, ids long, image binary"
DOCUMENTS = "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 1, shard_bytes: int = SHARD_BYTES,
                 added: bool = False) -> DataFrame:
    """Tokenizes and writes shard images to a table in the shared folder; returns it as read back.

    Shards follow each other by (part, seq) in ascending document order.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("image", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, ids, size, seq, part, width = [], [], 0, 0, 0, 2

        def close() -> pa.RecordBatch:
            return batch_of(schema, {"part": [part], "seq": [seq], "docs": [len(ids)], "ids": [size // width],
                                     "image": [encode_shard(doc_ids, ids, width)]})
        for batch in batches:
            for d, x, part, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "part", "width"))):
                doc_ids.append(d)
                ids.append(x)
                size += len(x)
                if size >= shard_bytes:
                    yield close()
                    doc_ids, ids, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    return stored(encoded(docs, tokenizer, end_id, added).select("doc_id", "ids", "part", "width").mapInArrow(run, SHARDS), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard images."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image"))):
                shard = Shard(image)
                at = np.fromiter((shard.bounds[i] for i in range(shard.n + 1)), np.int64, shard.n + 1)  # offsets by select
                tokens = memoryview(wide(shard.tokens.tobytes(), shard.width).tobytes())
                yield batch_of(schema, {"part": [part] * shard.n, "seq": [seq] * shard.n, "doc_id": shard.doc_ids, "start": at[:-1],
                                        "n_tokens": np.diff(at), "ids_crc32": [zlib.crc32(tokens[4 * a:4 * b]) for a, b in zip(at, at[1:])]})

    local = shards.select("part", "seq", "image").mapInArrow(run, DOCUMENTS)
    sizes = shards.select("part", "seq", "ids")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("all"))
    first = parts.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("base"))
    within = sizes.withColumn("own", F.sum("ids").over(W.partitionBy("part").orderBy("seq")) - F.col("ids"))
    base = within.join(first, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("base"))
    return local.join(base, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: only the end id. Null ids come first, repeated ids one after the other. Empty table: no rows."""
    return read_documents(write_shards(table(spark, sf_dir, "documents"), added=True))
