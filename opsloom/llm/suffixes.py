"""Removal of repeated passages with suffix arrays built by linear grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import batch_of, sliced, small_batches, stored, table

#: Bytes of a passage that may not repeat.
LENGTH = 100
#: Bytes of an anchor; each passage has its anchor in one of LENGTH - GRAM + 1 places.
GRAM = 24
PLACES = LENGTH - GRAM + 1
#: Text that is folded at once in a task, and hashed at once.
FOLDED, HASHED = 24 << 20, 2 << 20
#: Bytes of one suffix array (sorting it takes some 120 times as many), and pieces that one key may bring to it.
ARRAY, CROWD = 1 << 18, 4096
#: Rows of an Arrow batch that a task hands back; the JVM holds a batch outside its heap.
HANDED = 1 << 14
#: Parts that the rows of one window of a crowded anchor are dealt to.
SALTS = 16
#: Documents with removals whose ids are sent to all executors, at most; beyond it both sides are shuffled.
BROADCAST = 200_000


# ------------------------------------------------------------------ suffix arrays
def _words(text: np.ndarray) -> np.ndarray:
    """Eight letters from each place on, big-endian, so that words compare like letters."""
    padded = np.append(text, np.zeros(8, text.dtype)).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k:k + len(text)]
    return out


def lyndon_prefixes(text: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon prefix of every suffix; 0 is the end mark and has length 1.

    All places scan on together. A place is done at the first letter that is
    smaller than the one it must equal: there the next smaller suffix begins.
    """
    out = np.ones(len(text), np.int64)
    at = np.flatnonzero(text)
    back, ahead = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
    padded = np.append(text, 0)
    while len(at):
        mine, theirs = padded[at + ahead], padded[at + back]
        done = mine < theirs
        out[at[done]] = ahead[done] - back[done]
        go = ~done
        back = np.where(mine > theirs, 0, back + 1)[go]
        at, ahead = at[go], ahead[go] + 1
    return out


def _starts(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (least significant first), and for each place of the order where its class of equals begins."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(np.append(True, new[1:])) if len(order) else np.zeros(0, np.int64)
    return order, np.repeat(first, np.diff(np.append(first, len(order))))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, .. for each pair, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def lyndon_groups(text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For every suffix where the group of its Lyndon prefix begins in the suffix array.

    Groups are sorted like their prefixes: by eight letters first, then only
    the classes that hold longer prefixes by the next eight, and so on.
    """
    words = _words(text)
    rank = np.zeros(len(text), np.int64)
    members, step = np.arange(len(text)), 0
    while len(members):
        rest = np.clip(length[members] - 8 * step, 0, 8).astype(np.uint64)
        word = words[np.minimum(members + 8 * step, len(text) - 1)]
        word = np.where(rest > 0, word >> (np.uint64(64) - np.uint64(8) * np.maximum(rest, np.uint64(1))) << (np.uint64(64) - np.uint64(8) * np.maximum(rest, np.uint64(1))), np.uint64(0))
        order, start = _starts([word, rank[members]])
        sorted_ = members[order]
        _, class_start = _starts([rank[members]]) if step else (None, np.zeros(len(members), np.int64))
        rank[sorted_] += start - class_start
        step += 1
        deep = length[sorted_] > 8 * step
        classes = np.flatnonzero(np.diff(start, prepend=-1))
        sizes = np.diff(np.append(classes, len(start)))
        keep = np.repeat(np.logical_or.reduceat(deep, classes) & (sizes > 1), sizes)
        members = np.sort(sorted_[keep])
    return rank


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of every suffix up to its end mark (letter 0); equal suffixes share a rank.

    A suffix is its Lyndon prefix and a smaller suffix behind it, where the
    next smaller one begins. So groups are emitted from the smallest on: a
    group whose members' remainders have ranks is ordered by them. Members
    whose remainder lies in their own group come behind those whose remainder
    lies in a smaller one, by the number of repeats. No letters are renamed.
    """
    length = lyndon_prefixes(text)
    behind = np.arange(len(text)) + length
    group = lyndon_groups(text, length)
    mark = text == 0
    group[mark] = -1
    behind[mark] = np.flatnonzero(mark)
    repeats = np.zeros(len(text), np.int64)
    same = np.flatnonzero((group[behind] == group) & ~mark)
    while len(same):
        more = repeats[behind[same]] + 1
        changed = more != repeats[same]
        repeats[same] = more
        if not changed.any():
            break
    live = np.flatnonzero(~mark)
    order, start = _starts([repeats[live], group[live]])
    members = live[order]
    begin = np.flatnonzero(np.diff(start, prepend=-1))
    sizes = np.diff(np.append(begin, len(members)))
    sub = np.full(len(text), -1, np.int64)  # number of the group, split by repeats
    sub[members] = np.repeat(np.arange(len(begin)), sizes)
    rank = np.full(len(text), -1, np.int64)
    waits = ~mark[behind[live]]
    before = live[waits][np.argsort(behind[live[waits]], kind="stable")]  # by the remainder they wait for
    waiting = np.bincount(behind[before], minlength=len(text))
    offset = np.cumsum(waiting) - waiting
    open_ = np.bincount(sub[before], minlength=len(begin))
    ready = np.flatnonzero((sizes == 1) | (open_ == 0))
    while len(ready):
        now = members[_ranges(begin[ready], sizes[ready])]
        order, first = _starts([rank[behind[now]], sub[now]]) if sizes[ready].max() > 1 else (np.arange(len(now)), np.arange(len(now)))
        now, base = now[order], np.repeat(np.cumsum(sizes[ready]) - sizes[ready], sizes[ready])
        rank[now] = np.repeat(begin[ready], sizes[ready]) + first - base
        freed = sub[before[_ranges(offset[now], waiting[now])]]
        freed = freed[sizes[freed] > 1]
        np.subtract.at(open_, freed, 1)
        ready = np.unique(freed[open_[freed] == 0])
    return rank


def repeated(pieces: list[bytes], counts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place) of every window of LENGTH bytes that an earlier owner holds too.

    A piece brings its first ``counts`` windows. ``owner`` has the columns
    document, tag and place of each piece; windows are earlier by them.
    """
    text = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum([len(p) + 1 for p in pieces])
    text[ends - 1] = 0
    begins = ends - np.array([len(p) + 1 for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[piece] + place
    order = np.argsort(suffix_ranks(text)[at], kind="stable")
    words = _words((text - 1).astype(np.uint64) & np.uint64(255))
    equal = np.arange(1, len(order))
    for step in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        a, b = at[order[equal - 1]] + step, at[order[equal]] + step
        equal = equal[words[a] == words[b]]
    new = np.ones(len(order), bool)
    new[equal] = False
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new)
    doc, tag, start = owner[piece, 0], owner[piece, 1], owner[piece, 2] + place
    order = np.lexsort([start, tag, doc, run])
    first = np.flatnonzero(np.diff(run[order], prepend=-1))
    head = order[np.repeat(first, np.diff(np.append(first, len(order))))]
    late = order[(doc[order] != doc[head]) | (tag[order] != tag[head]) | (start[order] != start[head])]
    return piece[late], place[late]


# ------------------------------------------------------------------ anchors
def anchors(text: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each piece: the stretch of windows with one anchor.

    A window's anchor is the GRAM bytes in it with the least hash, the
    leftmost among equals, so equal windows have equal anchors in equal
    places. ``inside`` says which windows lie within a document.
    """
    n = len(text) - LENGTH + 1
    if n <= 0 or not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mix = np.random.default_rng(77).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)

    def joined(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
        m = len(right) - by
        h = (left[:m] ^ left[:m] >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + right[by:]
        return h ^ h >> np.uint64(29)

    grams = {1: mix[text]}
    for size in (1, 2, 4, 8):
        grams[2 * size] = joined(grams[size], grams[size], size)
        if size > 1 and size != 8:
            del grams[size]
    least = joined(grams[16], grams[8], 16) * np.uint64(0xBF58476D1CE4E5B9)
    del grams
    place = np.arange(len(least), dtype=np.int32)

    def lesser(by: int) -> None:
        nonlocal least, place
        left, right = least[:-by], least[by:]
        other = right < left
        place = np.where(other, place[by:], place[:-by])
        least = np.where(other, right, left)

    size = 1
    while 2 * size <= PLACES:
        lesser(size)
        size *= 2
    lesser(PLACES - size)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (place[1:n] != place[:n - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    keep = inside[first]
    return least[first[keep]], first[keep], count[keep]


_ROWS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("body", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()),
                   ("at", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])
_DDL = "kind int, key long, body long, doc long, tag int, at long, n long, text binary"
#: Kinds of rows: the only piece with its anchor in a task, a mark that the anchor has several, a removed stretch of bytes,
#: a piece for the suffix arrays, a piece whose text is asked for.
ONE, MARK, CUT, PIECE, ASKED = range(5)


def _handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of HANDED at most."""
    for batch in batches:
        for a in range(0, batch.num_rows, HANDED):
            yield batch.slice(a, HANDED)


def _rows(kind, key, body, doc, tag, at, n, text=None) -> pa.RecordBatch:
    rows = len(key)
    return batch_of(_ROWS, {"kind": np.broadcast_to(np.int32(kind), rows), "key": np.asarray(key).astype(np.int64), "body": np.asarray(body).astype(np.int64), "doc": doc,
                            "tag": np.asarray(tag).astype(np.int32), "at": at, "n": n, "text": text if text is not None else pa.nulls(rows, pa.binary())})


def _cut_rows(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """CUT rows of the stretches, those that touch joined, dealt out by document."""
    order = np.lexsort([at, tag, doc])
    doc, tag, at = doc[order], tag[order], at[order]
    other = np.ones(len(order), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    far = np.cumsum(other) << 40  # documents one behind the other on one line
    end = np.maximum.accumulate(at + n[order] + far)
    first = np.ones(len(order), bool)
    first[1:] = other[1:] | (at[1:] + far[1:] > end[:-1])
    head = np.flatnonzero(first)
    last = np.append(head[1:], len(order)) - 1
    key = doc[head].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _rows(CUT, key.view(np.int64), 0 * head, doc[head], tag[head], at[head], end[last] - far[last] - at[head])


def _later(key: np.ndarray, body: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one (key, body): the earliest ones; and those after it."""
    order = np.lexsort([at, tag, doc, body, key])
    first = np.ones(len(order), bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (body[order][1:] != body[order][:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    late = (doc[order] != doc[head]) | (tag[order] != tag[head]) | (at[order] != at[head])
    return order[first], order[late]


def _folded(docs: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents (id, tag, bytes) that a task holds at once.

    Of equal pieces only the earliest goes on; the others repeat it and are
    cut here. Anchors with several different pieces here send all of them to
    the suffix arrays, and a mark. So an anchor leaves at most one row here.
    """
    parts: list[list[np.ndarray]] = []
    texts: list[bytes] = []
    group, size = [], 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        text = np.frombuffer(b"".join(g[3] for g in group), np.uint8)
        lengths = np.array([len(g[3]) for g in group])
        ends = np.cumsum(lengths)
        inside = np.zeros(max(0, len(text) - LENGTH + 1), bool)
        for e, length in zip(ends, lengths):
            inside[e - length:e - LENGTH + 1] = True
        key, first, count = anchors(text, inside)
        which = np.searchsorted(ends, first, "right")
        data = text.tobytes()
        digest = xxhash.xxh3_64_intdigest
        body = np.array([digest(data[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist())], np.uint64)
        shift = np.array([g[2] for g in group])[which] - (ends - lengths)[which]  # place in the document
        number = np.array([g[4] for g in group])[which]
        parts.append([key.view(np.int64), body.view(np.int64), np.array([g[0] for g in group], np.int64)[which],
                      np.array([g[1] for g in group], np.int64)[which], first + shift, count, number])
        group, size = [], 0

    for doc, tag, data in docs:
        texts.append(data)
        step = HASHED
        for a in range(0, max(1, len(data) - LENGTH + 1), step):  # blocks overlap, so that each window lies in one
            block = data[a:a + step + LENGTH - 1]
            if len(block) >= LENGTH:
                group.append((doc, tag, a, block, len(texts) - 1))
                size += len(block)
                if size >= HASHED:
                    flush()
    flush()
    if not parts:
        return
    key, body, doc, tag, at, n, number = map(np.concatenate, zip(*parts))
    parts.clear()
    head, late = _later(key, body, doc, tag, at)
    if len(late):
        yield _cut_rows(doc[late], tag[late], at[late], n[late] + LENGTH - 1)
    same = np.zeros(len(head), bool)
    same[1:] = key[head][1:] == key[head][:-1]
    same[:-1] |= same[1:]
    one, several = head[~same], head[same]
    yield _rows(ONE, key[one], body[one], doc[one], tag[one], at[one], n[one])
    marks = np.unique(key[several])
    yield _rows(MARK, marks, 0 * marks, 0 * marks, 0 * marks, 0 * marks, 0 * marks)
    for a in range(0, len(several), 20_000):
        s = several[a:a + 20_000]
        cut = [texts[i][p:p + k + LENGTH - 1] for i, p, k in zip(number[s].tolist(), at[s].tolist(), n[s].tolist())]
        yield _rows(PIECE, body[s], key[s], doc[s], tag[s], at[s], n[s], pa.array(cut, pa.binary()))


def _identified(docs: DataFrame) -> DataFrame:
    """With _doc (null ids first) and _tag, which tells texts of one id apart."""
    return (docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
            .withColumn("_tag", F.hash("text")))


def cuts(docs: DataFrame) -> DataFrame:
    """doc, tag and cuts, the stretches of bytes that LENGTH-byte strings cover which start earlier too.

    1. Every task folds its documents to pieces, windows with one anchor.
    2. Pieces meet by anchor. Equal ones are cut but for the earliest. Where
       an anchor has different pieces, those go on, with their texts.
    3. Pieces meet in suffix arrays by anchor; equal windows are neighbours
       there, and all but the earliest are cut. Anchors with more than CROWD
       pieces are dealt out by windows instead: the earliest of each window is
       found in the tasks and by a sum, and told to all later ones, row by row.
    """
    rows = _identified(docs.where(F.octet_length("text") >= LENGTH)).select("_doc", "_tag", "text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in sliced(whole, "text"):
                for doc, tag, data in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_tag")), batch.column("text").cast(pa.binary()).to_pylist()):
                    held.append((doc, tag, data))
                    size += len(data)
                if size >= FOLDED:
                    yield from _handed(_folded(held))
                    held, size = [], 0
        yield from _handed(_folded(held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "body", "doc", "tag", "at", "n"]
        held = np.zeros((len(names), 0), np.int64)
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            on = batch.filter(pa.array(kinds >= CUT))
            if on.num_rows:
                yield on
            own = batch.filter(pa.array(kinds < CUT))
            held = np.concatenate([held, np.stack([own.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])], axis=1)
            change = np.flatnonzero(np.diff(held[1]))
            if len(change):
                yield from _handed(met(held[:, :change[-1] + 1]))
                held = held[:, change[-1] + 1:]
        yield from _handed(met(held))

    def met(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, key, body, doc, tag, at, n = held
        if not len(key):
            return
        marked = np.unique(key[kind == MARK])
        own = np.flatnonzero(kind == ONE)
        head, late = _later(key[own], body[own], doc[own], tag[own], at[own])
        head, late = own[head], own[late]
        if len(late):
            yield _cut_rows(doc[late], tag[late], at[late], n[late] + LENGTH - 1)
        same = np.zeros(len(head), bool)
        same[1:] = key[head][1:] == key[head][:-1]
        same[:-1] |= same[1:]
        ask = head[same | np.isin(key[head], marked)]
        if len(ask):
            yield _rows(ASKED, body[ask], key[ask], doc[ask], tag[ask], at[ask], n[ask])

    found = stored(rows.mapInArrow(first, _DDL).repartition("key").sortWithinPartitions("key").mapInArrow(meet, _DDL), "passages")
    asked = found.where(F.col("kind") == ASKED).groupBy("doc", "tag").agg(F.collect_list(F.struct("body", "at", "n")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                out: list[list] = [[] for _ in range(6)]
                for doc, tag, wanted, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "asked")), batch.column("text").cast(pa.binary()).to_pylist()):
                    for w in wanted:
                        for o, v in zip(out, (w["body"], doc, tag, w["at"], w["n"], data[w["at"]:w["at"] + w["n"] + LENGTH - 1])):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, _PIECE.types)], schema=_PIECE)

    pieces_ddl = "key long, doc long, tag int, at long, n long, text binary"
    once = _joined(rows, asked, "inner").select("doc", "tag", "asked", "text").dropDuplicates(["doc", "tag"])
    pieces = (found.where(F.col("kind") == PIECE).select(F.col("body").alias("key"), "doc", "tag", "at", "n", "text")
              .unionByName(once.mapInArrow(fetch, pieces_ddl)))
    pieces = stored(pieces, "pieces")
    crowded = stored(pieces.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded")

    occurrence = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("at", pa.int64()), ("c", pa.int64())])
    occurrence_ddl = "h1 long, h2 long, doc long, tag int, at long, c long"

    def windows(least: bool):
        """A row per window of the pieces, by its 128-bit hash; with ``least`` the earliest of each batch only and how many it stands for."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 4096):
                    batch = whole.slice(a, 4096)
                    doc, tag, at, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "tag", "at", "n"))
                    digest = xxhash.xxh3_128_digest
                    both = b"".join(digest(data[k:k + LENGTH], 9) for data, m in zip(batch.column("text").to_pylist(), n.tolist()) for k in range(m))
                    h1, h2 = np.frombuffer(both, "<i8").reshape(-1, 2).T
                    row = np.repeat(np.arange(len(n)), n)
                    doc, tag, at = doc[row], tag[row], at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    c = np.ones(len(row), np.int64)
                    if least:
                        order = np.lexsort([at, tag, doc, h2, h1])
                        start = np.flatnonzero((np.diff(h1[order], prepend=0) != 0) | (np.diff(h2[order], prepend=0) != 0) | (np.arange(len(order)) == 0))
                        c = np.diff(np.append(start, len(order)))
                        h1, h2, doc, tag, at = (x[order[start]] for x in (h1, h2, doc, tag, at))
                    out = batch_of(occurrence, {"h1": h1, "h2": h2, "doc": doc, "tag": tag.astype(np.int32), "at": at, "c": c})
                    yield from _handed([out])
        return run

    by_windows = None
    if not crowded.isEmpty():
        crowd = pieces.join(crowded, "key", "left_semi").select("doc", "tag", "at", "n", "text")
        pieces = pieces.join(crowded, "key", "left_anti")
        owners = stored(crowd.mapInArrow(windows(True), occurrence_ddl).groupBy("h1", "h2")
                        .agg(F.min(F.struct("doc", "tag", "at")).alias("owner"), F.sum("c").alias("c")).where("c > 1").select("h1", "h2", "owner"), "owners")
        salted = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        by_windows = (crowd.mapInArrow(windows(False), occurrence_ddl)
                      .withColumn("salt", F.pmod(F.xxhash64("doc", "tag"), F.lit(SALTS)).cast("int"))
                      .join(salted, ["h1", "h2", "salt"]).where(F.struct("doc", "tag", "at") != F.col("owner"))
                      .select("doc", "tag", "at", F.lit(LENGTH).cast("long").alias("n")))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "tag", "at", "n", "text"))):
                if size >= ARRAY and row[0] != last:
                    yield ordered(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[5]), row[0]
        if held:
            yield ordered(held)

    def ordered(held: list[tuple]) -> pa.RecordBatch:
        _, doc, tag, at, n, text = zip(*held)
        owner = np.array([doc, tag, at], np.int64).T
        piece, place = repeated(list(text), np.array(n), owner)
        order = np.lexsort([place, piece])
        piece, place = piece[order], place[order]
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(piece)))
        own = owner[piece[first]]
        return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1].astype(np.int32)), pa.array(own[:, 2] + place[first]),
                                           pa.array(count + LENGTH - 1)], names=["doc", "tag", "at", "n"])

    late = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "doc long, tag int, at long, n long")
    every = found.where(F.col("kind") == CUT).select("doc", "tag", "at", "n").unionByName(late)
    if by_windows is not None:
        every = every.unionByName(by_windows)
    return stored(every.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n")).alias("cuts")), "cuts")


_PIECE = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])


def _joined(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Documents with the rows of ``side`` for their _doc and _tag.

    Only documents that ``side`` names are shuffled, as long as these are few
    enough to send their ids to all executors.
    """
    on = (F.col("_doc") == F.col("doc")) & (F.col("_tag") == F.col("tag"))
    ids = side.select("doc", "tag")
    if ids.count() > BROADCAST:
        return rows.join(side, on, how)
    named = rows.join(F.broadcast(ids), on, "left_semi").join(side, on)
    if how == "inner":
        return named
    return named.unionByName(rows.join(F.broadcast(ids), on, "left_anti"), allowMissingColumns=True)


def _spans(cut: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((c["at"], c["at"] + c["n"]) for c in cut):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)]))


def with_cuts(docs: DataFrame) -> DataFrame:
    """row, a struct of all columns of ``docs``, and cuts, null where nothing goes."""
    slim = small_batches(docs).select("doc_id", "text")
    rows = _identified(docs.select("doc_id", "text", F.struct("*").alias("row"))).select("row", "_doc", "_tag")
    return _joined(rows, cuts(slim), "left").select("row", "cuts")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    Null text is empty. Order is by doc_id, null first, then by a hash of the
    text; rows equal in both are one document and get the same result. Equal
    strings inside one document count as well. Empty table: no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                spans = [_spans(c) for c in batch.column("cuts").to_pylist()]
                data = batch.column("text").cast(pa.binary()).to_pylist()
                yield batch_of(schema, {"doc_id": batch.column("doc_id"), "n_bytes": [len(d) for d in data], "n_removed": [sum(b - a for a, b in s) for s in spans],
                                        "n_spans": [len(s) for s in spans], "kept_sha256": [hashlib.sha256(_kept(d, s)).hexdigest() for d, s in zip(data, spans)]})

    marked = with_cuts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).select("row.*", "cuts")
    whole = marked.where(F.col("cuts").isNull()).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return marked.where(F.col("cuts").isNotNull()).mapInArrow(run, ddl).unionByName(whole)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what remains of their texts; those of which nothing remains go.

    A character that a cut goes through goes with it. ``n_chars`` follows the
    text, where there is such a column. Documents that were empty stay.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                cut = batch.column(batch.num_columns - 1).to_pylist()
                text = [_kept(d, _spans(c)).decode("utf-8", "ignore") for d, c in zip(batch.column("text").cast(pa.binary()).to_pylist(), cut)]
                columns = batch.columns[:-1]
                columns[at] = pa.array(text, batch.schema.field("text").type)
                out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
                yield out.filter(pa.array([t != "" for t in text], pa.bool_()))

    marked = with_cuts(docs)
    last = "_cuts"
    while last in docs.columns:
        last += "_"
    changed = marked.where(F.col("cuts").isNotNull()).select("row.*", F.col("cuts").alias(last)).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)
    return changed.unionByName(marked.where(F.col("cuts").isNull()).select("row.*"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
