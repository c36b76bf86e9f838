import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from opsloom.llm import binary_output as B
from opsloom.llm import mixing, packing
from opsloom.llm.tokens import BYTE_BPE, WORD_BPE, encoder
from tests.llm.rows import AWKWARD, docs


def plain(name, added=False):
    """The library itself; ``added``: as it comes, with the added tokens' own ids."""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    if not added:
        t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_cached_encoding_equals_the_library(name):
    own, lib = encoder(public_tokenizers.path(name)), plain(name)
    texts = [t for _, t, _, _ in AWKWARD if t] + ["a  b\n\nfoo it's 'stuff 'tis\n bar\tbaz, x y  ", "  lead\n", "DON'T can't cáfe é ́x,y", "x\n\n\n y",
                                                  "12abc 3.5-x (foo) [bar] ~tilde~ ÄÖ ñandú.", "​zero ﻿mark", "A\rB\x0bC  \n D"]
    for text in texts:
        assert np.frombuffer(own(text), "<u2").tolist() == lib(text)[:-1], text[:50]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (5, 3), (1000, 10), (3000, 10**9), (257, 2**40)):
        v = np.sort(rng.integers(0, top + 1, n))
        data = B.EliasFano.of(v).to_bytes()
        back, end = B.EliasFano.from_bytes(memoryview(b"??" + data), 2)
        assert end == len(data) + 2 and back.values().tolist() == v.tolist()
        assert [back[i] for i in range(0, n, 7)] == v[::7].tolist()
        assert n < 1000 or len(data) < n * (2.2 + max(0, np.log2(top / n)) + 64 / B.SAMPLE) / 8 + 64


def test_op10_against_plain_encoding(spark, small):
    got = entry.queries()["op10_token_shards"](spark, small).toPandas().sort_values("doc_id")
    rows = spark.read.parquet(f"{small}/documents.parquet").toPandas().sort_values("doc_id")
    ids = [plain(WORD_BPE)(t) for t in rows["text"]]
    assert got["doc_id"].tolist() == rows["doc_id"].tolist()
    assert got["n_tokens"].tolist() == [len(x) for x in ids]
    assert got["start"].tolist() == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_shards_of_awkward_rows(spark):
    got = B.read_documents(B.write_shards(docs(spark, AWKWARD), shard_bytes=64)).orderBy("start").collect()
    want = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    ids = [plain(WORD_BPE)(r[1]) for r in want]
    assert [(r["start"], r["n_tokens"]) for r in got] == [(sum(map(len, ids[:i])), len(ids[i])) for i in range(len(ids))]
    assert B.read_documents(B.write_shards(docs(spark, []))).count() == 0


def check_packing(rows, pieces, window, encode=None):
    encode = encode or plain(BYTE_BPE)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    want = defaultdict(list)
    for d, t, _, _ in rows:
        want[d].append(encode(t))
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in want.values() for x in v)
    for d, texts in want.items():
        if len(texts) == 1:
            own, at = sorted(by_doc[d], key=lambda p: p["start"]), 0
            for p in own:
                assert p["start"] == at and p["doc_tokens"] == len(texts[0])
                assert p["ids_crc32"] == zlib.crc32(np.array(texts[0][at:at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(texts[0])
    padded = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    assert padded == 0
    return by_seq


def test_op5_packs_everything_at_the_targets(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    pieces = packing.pack(spark.read.parquet(f"{small}/documents.parquet")).collect()
    windows = check_packing(rows, pieces, 2048)
    share = defaultdict(int)
    for p in pieces:
        share[p["source"]] += p["length"]
    total = sum(share.values())
    for own in windows.values():
        if sum(p["length"] for p in own) == 2048:
            for s, n in share.items():  # near the target in every window
                assert abs(sum(p["length"] for p in own if p["source"] == s) - 2048 * n / total) <= 2 * packing.LEAST + 2048 / len(share)


def test_op5_query_equals_the_library(spark, small):
    """The registered query: ids, crc32, starts, lengths and gapless offsets against an unchanged tokenizer."""
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    out = entry.queries()["op5_mixture_packing"](spark, small)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_packing(rows, out.collect(), 2048, plain(BYTE_BPE, added=True))


def test_added_tokens_and_hot_ids(spark, monkeypatch):
    """Strings of added tokens, one id with most of the rows, null ids: every piece and every shard offset."""
    from opsloom.llm import tokens
    monkeypatch.setattr(tokens, "PER_PART", 4)
    rows = [(i, f"text <|endoftext|> {i} éa<|startoftext|>", "en", "a") for i in range(60)] + [(7, f"hot {i} word", "en", "b") for i in range(200)] + [
        (None, f"no id {i}", None, None) for i in range(40)]
    check_packing(rows, packing.pack(docs(spark, rows), window=64, added=True).collect(), 64, plain(BYTE_BPE, added=True))
    got = B.read_documents(B.write_shards(docs(spark, rows), shard_bytes=200, added=True)).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == len(rows)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    crc = lambda t: zlib.crc32(np.array(plain(WORD_BPE, added=True)(t), "<u4").tobytes())
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in got) == sorted((d or -1, crc(t)) for d, t, _, _ in rows)


def test_packing_of_awkward_rows(spark):
    frame = packing.pack(docs(spark, AWKWARD), window=64)
    check_packing(AWKWARD, frame.collect(), 64)
    whole = packing.sequences(frame).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert packing.pack(docs(spark, [])).count() == 0


def test_schedule_starts_anywhere():
    for totals in ([5, 100000, 3, 70000], [1] * 300 + [9], [2048 * 256], [0, 7]):
        plan = packing.Schedule(totals, 64, 4)
        seen = set()
        for s, n in enumerate(totals):
            cut = [list(plan.pieces(s, a, min(37, n - a))) for a in range(0, n, 37)]
            assert sum(p[1] for c in cut for p in c) == n
            for at, length, q, off in (p for c in cut for p in c):
                cells = {(q, off + i) for i in range(length)}
                assert not cells & seen
                seen |= cells


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_equal_repeated_resharing(spark):
    for sizes in ({"a": 100, "b": 1, "c": 5000, None: 20, "ä": 3}, {"x": 7}, {"a": 0, "b": 10}, {None: 0}):
        got = {r[0]: r[2] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_op6_keeps_the_balance(spark, small):
    d = entry.queries()["op6_cube_mix"](spark, small)
    got = d.toPandas()
    again = entry.queries()["op6_cube_mix"](spark, small).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    src = spark.read.parquet(f"{small}/documents.parquet").toPandas()[["doc_id", "source", "text"]].merge(got, on="doc_id")
    assert len(src) == len(got) and (src["size"] == [len(t.encode().split()) for t in src["text"]]).all()
    assert (src["taken"] <= 3 * src["size"]).all() and (src["taken"] % src["size"] == 0).all()
    for _, g in src.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
        # document totals are balanced too: times sum to the ratio times the count, up to the landing
        ratio = g["target"].iloc[0] / g["source_size"].iloc[0]
        assert abs((g["taken"] / g["size"]).sum() - ratio * len(g)) <= 2


def test_mixing_of_many_groups_and_awkward_rows(spark, monkeypatch):
    rows = [(i, "w " * (i % 50 + 1), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(4000)] + AWKWARD
    frame = docs(spark, rows)
    m = mixing.mix(frame).toPandas()
    assert m["rows"].sum() == len(rows)
    for _, g in m.groupby("source", dropna=False):
        assert abs((g["taken"] * g["rows"]).sum() - g["target"].iloc[0]) <= (g["size"] * g["rows"]).max() + 1
    kept = mixing.mixed(frame)
    assert kept.columns == frame.columns and kept.count() == int((m["times"] * m["rows"]).sum())
    assert mixing.mix(docs(spark, [])).count() == 0


def test_flight_keeps_both_totals():
    import random
    for seed in range(20):
        rng = random.Random(seed)
        sizes, chance = [rng.randint(1, 999) for _ in range(200)], [rng.random() for _ in range(200)]
        x = mixing._flight(sizes, chance, rng, False)
        assert sum(0 < v < 1 for v in x) <= 2
        assert abs(sum(x) - sum(chance)) < 1e-6 and abs(sum(a * b for a, b in zip(x, sizes)) - sum(a * b for a, b in zip(chance, sizes))) < 1e-3


SPECIAL = ["end <|endoftext|> next", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>", " x  <|endoftext|>\n y it's<|endoftext|>'s", "<|ENDOFTEXT|> <|end"]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_added_tokens_as_the_unmodified_library(name):
    path = public_tokenizers.path(name)
    own, lib = encoder(path, added=True), Tokenizer.from_file(path)
    for text in SPECIAL + [t for _, t, _, _ in AWKWARD if t]:
        assert np.frombuffer(own(text), "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids, text[:50]


def test_queries_read_added_tokens(spark, tmp_path):
    docs(spark, [(i, t, "en", "a") for i, t in enumerate(SPECIAL)]).write.parquet(str(tmp_path / "documents.parquet"))
    for query, name in (("op10_token_shards", WORD_BPE), ("op5_mixture_packing", BYTE_BPE)):
        lib = Tokenizer.from_file(public_tokenizers.path(name))
        got = entry.queries()[query](spark, str(tmp_path)).collect()
        size = {r["doc_id"]: r["n_tokens"] if query.startswith("op10") else r["doc_tokens"] for r in got}
        assert size == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(SPECIAL)}
