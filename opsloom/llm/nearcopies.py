"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the sets propose pairs through the pivot distance
tables of ``simhash``, least hashes those that differ in more bits; both are
verified by the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, sliced, small_batches, stored
from opsloom.llm.graphs import components
from opsloom.llm.simhash import links as near_prints
from opsloom.llm.simhash import majority

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction of whole numbers.
OVER, UNDER = 4, 5
#: Least hashes of a set: a pair meets where the HASHES / BANDS of one band agree. At similarity 0.8 a pair misses all
#: bands with a chance of (1 - 0.8 ** 6) ** 40 = 5e-6.
BANDS, HASHES = 40, 240
#: Sets of a block; two blocks of a key meet in one task.
BLOCK = 512
_RNG = np.random.default_rng(20240102)
_FLIP = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different runs of SHINGLE words; a shorter text is one run, no words are the hash 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(1, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(SHINGLE)))], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key per band of the least hashes of a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), 1024):
        np.minimum(least, ((own[a:a + 1024, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    data, step = least.tobytes(), HASHES // BANDS * 8
    return np.array([xxhash.xxh64_intdigest(data[i * step:(i + 1) * step], i) for i in range(BANDS)], np.uint64).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """id, digest of the text, node (hash of the set), n (its size), print (its SimHash fingerprint), keys for every row."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                sets = [shingles(t) for t in batch.column("text").to_pylist()]
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                yield batch_of(schema, {"id": batch.column("id"), "digest": batch.column("digest"), "node": nodes,
                                        "n": [len(s) for s in sets], "print": prints, "keys": [band_keys(s) for s in sets]})

    return docs.select("id", "digest", "text").mapInArrow(run, "id long, digest long, node long, n long, print long, keys array<long>")


def _print_keys(nodes: DataFrame) -> DataFrame:
    """node, n, key: nodes whose fingerprints differ in simhash.RADIUS bits at most share a key, the print of a group they meet in."""
    groups = near_prints(nodes.select("print").distinct()).select(F.col("a").alias("key"), F.col("b").alias("print")).distinct()
    return nodes.select("node", "n", F.col("print").alias("key")).unionByName(nodes.join(groups, "print").select("node", "n", "key"))


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node and its set as sorted 64-bit numbers in bytes, for the nodes of ``chosen`` (node, id, digest)."""
    schema = pa.schema([("node", pa.int64()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                yield batch_of(schema, {"node": batch.column("node"), "own": [shingles(t).tobytes() for t in batch.column("text").to_pylist()]})

    same = docs["id"].eqNullSafe(chosen["id"]) & (docs["digest"] == chosen["digest"])
    texts = docs.join(chosen, same).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(run, "node long, own binary")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, by their whole sets."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets(docs, nodes.join(named, "node", "left_semi").select("node", "who.id", "who.digest")), "shingle-sets")
    # b's set goes to a, so that a set many pairs name is not written again for each of them
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("theirs")), "b")
            .join(sets.select(F.col("node").alias("a"), "own"), "a"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("own").to_pylist(), batch.column("theirs").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
                keep.append(common >= _least_overlap(len(x), len(y)))
            yield batch_of(schema, {c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    return both.mapInArrow(run, "a long, b long")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _least_overlap(x: np.ndarray | int, y: np.ndarray | int) -> np.ndarray | int:
    """Common shingles that sets of x and y shingles must have: common / (x + y - common) >= OVER / UNDER."""
    return -(-OVER * (x + y) // (OVER + UNDER))


def spanning_links(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the groups among similar sets; those that join nothing new are left out.

    Only sets of different roots are compared, and of different sides where
    there are two. Of sorted sets that are similar enough one of the
    ``n - ceil(OVER n / UNDER) + 1`` least shingles is common, so a set is
    compared with those whose such prefix it meets, by whole sets.
    """
    parent: dict[int, int] = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    sizes = np.array([len(s) for s in sets], np.int64)
    prefix = sizes - -(-OVER * sizes // UNDER) + 1
    heads: dict[int, list[int]] = {}
    links, two = [], sides.any() and not sides.all()
    for v in np.argsort(sizes, kind="stable").tolist():
        own, met = sets[v], set()
        for token in own[:prefix[v]].tolist():
            met.update(heads.setdefault(token, []))
            heads[token].append(v)
        mine = find(int(roots[v]))
        near = np.array([u for u in met if (not two or sides[u] != sides[v]) and UNDER * sizes[u] >= OVER * sizes[v] and find(int(roots[u])) != mine], np.int64)
        for a in range(0, len(near), 256):
            some = near[a:a + 256]
            flat, starts = np.concatenate([sets[u] for u in some]), np.cumsum(sizes[some]) - sizes[some]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
            for u in some[common >= _least_overlap(sizes[some], sizes[v])].tolist():
                r, q = find(int(roots[u])), find(int(roots[v]))
                if r != q:
                    parent[max(r, q)] = min(r, q)
                    links.append((int(nodes[u]), int(nodes[v])))
    return links


def _linked_in_blocks(docs: DataFrame, nodes: DataFrame, left: DataFrame) -> DataFrame:
    """a, b: links between the groups that meet in the open keys (key, node, root), found inside tasks.

    The nodes of a key are cut into blocks of BLOCK by a hash, and every two
    blocks of a key are one group. A node travels with its set once for each
    block of its key; pairs are never rows.
    """
    sets = stored(_sets(docs, nodes.join(left.select("node").distinct(), "node", "left_semi").select("node", "who.id", "who.digest")), "shingle-sets")
    blocks = left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = left.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("key", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own").join(sets.withColumnRenamed("own", "set"), "node")
    found = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        column = group.column("set").combine_chunks()
        sets = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        side = group.column("own").to_numpy() != group.column("i").to_numpy()
        links = spanning_links(group.column("node").to_numpy(), group.column("root").to_numpy(), sets, side)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}, schema=found)

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def first_of_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, of equal ids that with the least digest.

    A group is what pairs of OVER / UNDER similarity reach. Pairs are proposed
    by near fingerprints and by band keys. First each text of a key meets the
    key's least one; then those that are still in different groups meet inside
    tasks, in blocks, so that a crowd of copies makes no pair rows. Null ids
    come last; rows equal in id and text are one document. Texts of less than
    SHINGLE words are copies if their words are equal, and those without words
    are.
    """
    told = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("digest"), "text")
    slim = told.select("id", "digest", "text")
    rows = stored(_keyed(small_batches(slim)), "band-keys")
    who = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    nodes = stored(rows.groupBy("node").agg(F.min(who).alias("who"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("keys").alias("keys")), "distinct-sets")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key")).unionByName(stored(_print_keys(nodes), "print-keys"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("h"), F.count("*").alias("c")).where("c > 1").select("key", "h")
    shared = stored(keyed.join(heads, "key"), "shared-keys")
    like = f"least(x, y) * {UNDER} >= greatest(x, y) * {OVER}"
    pairs = stored(shared.select(F.col("h.node").alias("a"), F.col("h.n").alias("x"), F.col("node").alias("b"), F.col("n").alias("y"))
                   .where(f"a <> b and {like}").select("a", "b").distinct(), "near-pairs")
    links = stored(_verified(slim, nodes, pairs), "near-links")
    roots = stored(_roots(nodes, links), "near-roots")
    placed = shared.join(roots, "node").select("key", "node", "root")
    mixed = placed.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("key")
    left = stored(placed.join(mixed, "key", "left_semi"), "open-keys")
    if not left.isEmpty():
        more = stored(_linked_in_blocks(slim, nodes, left), "near-links")
        roots = stored(_roots(nodes, links.unionByName(more)), "near-roots")
    kept = nodes.join(roots, "node").groupBy("root").agg(F.min("who").alias("k")).select("k.id", "k.digest")
    same = told["id"].eqNullSafe(kept["id"]) & (told["digest"] == kept["digest"])
    return told.join(kept, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
