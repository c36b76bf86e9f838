"""Near-duplicates by SimHash, verified through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, sliced, stored, table
from opsloom.llm.graphs import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Reference fingerprints; every pair that differs in RADIUS bits differs by RADIUS at most in each distance to them.
PIVOTS = np.random.default_rng(20240101).integers(0, 1 << 64, 16, dtype=np.uint64)
#: Fingerprints that share a key, at most, before the key is made longer.
CROWD = 4096
#: Runs up to this length are compared place by place for all runs at once.
SHORT = 16


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if over half of the shingles' hashes have it. No words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return majority(np.array([digest(b" ".join(words), SEED)], np.uint64))
    return majority(np.array([digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(SHINGLE)))], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have."""
    h = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k:k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, print (the fingerprint as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
                yield batch_of(schema, {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "print": prints})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest long, print long")


def _masks(level: int) -> list[int]:
    """Bits that each key of a level holds.

    Level 0: two of five blocks, for of five blocks two at least are free of
    the RADIUS = 3 differing bits. Each later level takes one of four blocks
    of the bits that its parent leaves out, again one at least being free.
    Key i of a level has the parent i // 4.
    """
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), 5)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    for _ in range(level):
        masks = [m | sum(1 << int(b) for b in part) for m in masks
                 for part in np.array_split([b for b in range(64) if not m >> b & 1], 4)]
    return masks


def _keyed(prints: DataFrame, level: int) -> DataFrame:
    """A row per key of each fingerprint; below level 0 only the keys under the row's own one."""
    masks = np.array(_masks(level), np.uint64)
    schema = pa.schema([("key", pa.int32()), ("value", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            if level:
                keys = batch.column("key").to_numpy(zero_copy_only=False)[:, None] * 4 + np.arange(4)
            else:
                keys = np.broadcast_to(np.arange(len(masks)), (len(p), len(masks)))
            values = p[:, None] & masks[keys]
            yield batch_of(schema, {"key": keys.ravel().astype(np.int32), "value": values.ravel().view(np.int64),
                                    "print": np.repeat(p, keys.shape[1]).view(np.int64)})

    return prints.mapInArrow(run, "key int, value long, print long")


def _near(a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray) -> np.ndarray:
    """Which pairs differ in RADIUS bits at most: the pivot tables discard, the survivors are verified."""
    out = np.flatnonzero(np.abs(da - db).max(axis=-1) <= RADIUS)
    return out[np.bitwise_count(a[out] ^ b[out]) <= RADIUS]


def _crowd(prints: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Label of each fingerprint of one long run: the place of its group's first one.

    A group grows from a seed; those it has reached are compared with the rest
    only, so that a dense group takes few comparisons and makes no pairs. The
    first pivot's distances, sorted, bound the range to look at.
    """
    order = np.argsort(distances[:, 0], kind="stable")
    first = distances[order, 0]
    label, open_ = np.full(len(prints), -1), np.ones(len(prints), bool)  # open_ by place in ``order``
    for place, seed in enumerate(order):
        if not open_[place]:
            continue
        open_[place] = False
        label[seed] = seed
        queue = [seed]
        while queue:
            at = queue.pop()
            lo, hi = np.searchsorted(first, [distances[at, 0] - RADIUS, distances[at, 0] + RADIUS + 1])
            rest = lo + np.flatnonzero(open_[lo:hi])
            near = rest[_near(prints[at:at + 1].repeat(len(rest)), prints[order[rest]], distances[at], distances[order[rest]])]
            open_[near] = False
            label[order[near]] = seed
            queue.extend(order[near].tolist())
    return label


def _links(run: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a sorted stretch, ``run`` numbering its keys: each fingerprint with its group's first one in the run."""
    distances = np.bitwise_count(prints[:, None] ^ PIVOTS).astype(np.int8)
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    sizes = np.diff(np.append(starts, len(run)))
    label = np.arange(len(run))
    short = np.repeat(sizes <= SHORT, sizes)
    pairs = []
    for step in range(1, int(sizes[sizes <= SHORT].max(initial=0))):
        i = np.flatnonzero((run[:-step] == run[step:]) & short[:-step])
        i = i[_near(prints[i], prints[i + step], distances[i], distances[i + step])]
        pairs.append((i, i + step))
    if pairs:
        a, b = map(np.concatenate, zip(*pairs))
        while True:
            before = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if (label == before).all():
                break
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        label[s:s + n] = s + _crowd(prints[s:s + n], distances[s:s + n])
    linked = np.flatnonzero(label != np.arange(len(run)))
    return prints[label[linked]], prints[linked]


def links(prints: DataFrame) -> DataFrame:
    """(a, b) between different fingerprints; they join exactly what differs in RADIUS bits at most.

    Fingerprints within RADIUS bits of each other share one key at least, and
    meet in its run. Keys that more than CROWD share are replaced by longer
    ones, level by level, so that no task has to hold a crowd.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "value", "print")])
            held = rows if held is None else np.concatenate([held, rows], axis=1)
            change = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(axis=0))
            if len(change):
                yield linked(held[:, :change[-1] + 1])
                held = held[:, change[-1] + 1:]
        if held is not None:
            yield linked(held)

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        number = np.cumsum(np.append(0, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
        a, b = _links(number, rows[2].view(np.uint64))
        return batch_of(schema, {"a": a.view(np.int64), "b": b.view(np.int64)})

    out, keyed = None, _keyed(prints, 0)
    for level in range(4):
        crowded = keyed.groupBy("key", "value").count().where(F.col("count") > CROWD).select("key", "value")
        crowded = stored(crowded, "crowded-keys") if level < 3 else None
        split = crowded is not None and not crowded.isEmpty()
        own = keyed.join(crowded, ["key", "value"], "left_anti") if split else keyed
        found = own.repartition("key", "value").sortWithinPartitions("key", "value", "print").mapInArrow(run, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not split:
            break
        keyed = _keyed(keyed.join(crowded, ["key", "value"], "left_semi"), level + 1)
    return out


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest, print, component_id for every row.

    A component is what links of RADIUS bits reach; its id is the least
    doc_id in it, null only where all its ids are null. Texts without words
    have fingerprint 0 and link like any other. Repeated rows stay. Empty
    table: no rows.
    """
    rows = stored(fingerprints(docs), "prints")
    distinct = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(links(distinct.select("print")))
    tied = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    names = tied.join(least, "root").select("print", "component_id")
    return rows.join(names, "print")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the least doc_id, of equal ids that with the least digest."""
    kept = groups(docs).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("print")).alias("p")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("digest").alias("d"))).alias("k")).select("k.id", "k.d")
    keyed = docs.withColumn("_digest", F.xxhash64("text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(kept["id"]) & (keyed["_digest"] == kept["d"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_digest"]).select(*docs.columns)


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
