import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opsloom.llm import language, licenses, simhash, suffixes, toxicity
from tests.llm.rows import AWKWARD, docs


# ------------------------------------------------------------------ language
def brute_path(scores, switch):
    value, back = [list(scores[0])], []
    for s in scores[1:]:
        step = [max(((value[-1][a] - switch * (a != b), a == b, -a) for a in range(len(s)))) for b in range(len(s))]
        back.append([-x[2] for x in step])
        value.append([x[0] + v for x, v in zip(step, s)])
    at = int(np.argmax(value[-1]))
    total = max(value[-1])
    path = [at]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], total


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(0, 9, 5)
        scores = rng.normal(size=(20, 3)) * 3
        words = rng.integers(0, 20, lengths.sum())
        got = language.viterbi(scores, words, lengths, 2.0)
        at = 0
        for n in lengths:
            if n:
                own = scores[words[at:at + n]]
                path = got[at:at + n]
                value = sum(own[i, p] for i, p in enumerate(path)) - 2.0 * (np.diff(path) != 0).sum()
                assert abs(value - brute_path(own.tolist(), 2.0)[1]) < 1e-9
            at += n


def test_op3_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = entry.queries()["op3_language_id"](spark, d)
    rows = got.join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    held = rows[rows["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_language_spans_scripts_and_awkward_rows(spark):
    train = [(i, "der hund und die katze", "de", "a") for i in range(30)] + [(100 + i, "the dog and the cat", "en", "a") for i in range(30)]
    train += [(200 + i, "собака и кошка", "ru", "a") for i in range(30)]
    model = language.fit(docs(spark, train))
    mixed = "the dog and the cat and the dog der hund und die katze und der hund собака и кошка"
    rows = language.label(docs(spark, [(1, mixed, None, None), (2, "1234 ...", "en", "a"), (3, "日本", "en", "a")] + AWKWARD), model)
    assert rows.columns[:7] == docs(spark, []).columns
    got = {(r["doc_id"], r["text"]): r for r in rows.collect()}
    assert [s["lang"] for s in got[1, mixed]["_lang_spans"]] == ["en", "de", "ru"]
    assert [s["first_word"] for s in got[1, mixed]["_lang_spans"]] == [0, 8, 16]
    assert got[2, "1234 ..."]["_lang_pred"] == "und" and got[2, None]["_lang_pred"] == "und" and got[3, ""]["_lang_score"] == 0
    assert got[3, "日本"]["_lang_pred"] in model.langs
    assert language.fit(docs(spark, [(1, "x", None, None)])) is None
    assert {r["_lang_pred"] for r in language.label(docs(spark, AWKWARD), None).collect()} == {"und"}
    assert language.accepted(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ SimHash
def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_groups(rows, got):
    prints = [plain_print(t) for _, t, *_ in rows]
    roots = brute_components(prints)
    least = {}
    for r, (d, *_) in zip(roots, rows):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted(((d, f"{p:016x}", least[r]) for (d, *_), p, r in zip(rows, prints, roots)), key=repr)
    assert sorted(got, key=repr) == want


def test_op2_against_all_pairs(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op2_simhash_pivots"](spark, small).select("doc_id", "fingerprint", "component_id").collect()
    check_groups(rows, [tuple(r) for r in got])


def test_simhash_of_awkward_rows(spark):
    frame = docs(spark, AWKWARD)
    got = simhash.groups(frame).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")), "component_id").collect()
    check_groups(AWKWARD, [tuple(r) for r in got])
    kept = simhash.first_of_groups(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)[:3] == [-3, 1, 2]
    assert simhash.groups(docs(spark, [])).count() == 0 and simhash.first_of_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [4096, 6])
def test_links_of_dense_groups(spark, monkeypatch, crowd):
    """Chains and balls of fingerprints; with a small CROWD the keys get longer."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(4)
    prints = set()
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(60):
            prints.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
    from opsloom.llm.graphs import components
    root = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    got, want = {}, {}
    for p, w in zip(prints, brute_components(prints)):
        s = int(np.uint64(p).view(np.int64))
        got.setdefault(root.get(s, s), set()).add(p)
        want.setdefault(w, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ------------------------------------------------------------------ repeated passages
def brute_removals(rows):
    seen, out = set(), {}
    for d, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k:k + 100] in seen:
                gone[k:k + 100] = True
            seen.add(b[k:k + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def check_removals(rows, frame):
    got = {r[0]: tuple(r)[1:] for r in frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == brute_removals(rows)


def test_suffix_ranks_equal_sorting():
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice([1, 2, 3, 26])
        pieces = [[rng.randrange(1, 1 + letters) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 5))]
        text = [c for p in pieces for c in p + [0]]
        rank = suffixes.suffix_ranks(np.array(text, np.uint16))
        rest = {i: tuple(text[i:text.index(0, i)]) for i, c in enumerate(text) if c}
        order = sorted(rest, key=rest.get)
        for a, b in zip(order, order[1:]):
            assert rank[a] == rank[b] if rest[a] == rest[b] else rank[a] < rank[b]


def test_op7_against_all_windows(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check_removals(rows, entry.queries()["op7_suffix_dedup"](spark, small))


@pytest.mark.parametrize("folded, crowd", [(24 << 20, 4096), (2000, 4096), (2000, 3)])
def test_repeated_passages(spark, monkeypatch, folded, crowd):
    """Passages at many places, in one text, periodic texts, multi-byte letters, blocks of long texts, crowded anchors."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "FOLDED", folded)
    monkeypatch.setattr(suffixes, "HASHED", 700)
    rng = random.Random(folded + crowd)
    fresh = lambda n: "".join(rng.choice("abcdefgé \n") for _ in range(n))
    passage, other = fresh(230), fresh(130)
    texts = [fresh(rng.randint(0, 300)) + rng.choice([passage, other, passage[40:180], ""]) + fresh(rng.randint(0, 300)) for _ in range(60)]
    texts += [passage + fresh(50) + passage, "ab" * 400, "ab" * 300, "x" * 5000, "", fresh(99), passage[:100], texts[3], texts[3], fresh(3000) + other]
    rows = list(enumerate(texts))
    frame = docs(spark, [(d, t, None, None) for d, t in rows]).repartition(5)
    check_removals(rows, suffixes.removals(frame))
    left = suffixes.without_repeats(frame)
    assert left.columns == frame.columns
    assert all(r["n_chars"] == len(r["text"]) or r["text"] in texts for r in left.collect())


def test_a_common_footer_fills_no_array(spark, monkeypatch):
    """Equal windows between different texts are cut without meeting in one suffix array."""
    monkeypatch.setattr(suffixes, "CROWD", 20)
    monkeypatch.setattr(suffixes, "ARRAY", 1000)
    plain = suffixes.repeated

    def bounded(texts, n, owner):
        assert sum(map(len, texts)) < 20_000
        return plain(texts, n, owner)

    monkeypatch.setattr(suffixes, "repeated", bounded)
    rng = random.Random(8)
    line = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    footer = line(150)
    rows = [(i, line(90) + footer + line(90)) for i in range(300)]
    check_removals(rows, suffixes.removals(docs(spark, [(i, t, "en", "a") for i, t in rows])))


def test_removals_of_awkward_rows(spark):
    got = suffixes.removals(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and {r["n_removed"] for r in got if r["doc_id"] == 4} == {0}
    assert next(r for r in got if r["doc_id"] == 7)["n_spans"] == 1
    assert suffixes.removals(docs(spark, [])).count() == 0 and suffixes.without_repeats(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ toxicity
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matcher_equals_edit_distance():
    lexicon = {"idiot": 3.0, "worthless": 4.0, "scum": 2.0, "lowei*": 1.5, "idiocy": 2.5}
    m = toxicity.Matcher(lexicon, frozenset(["idiom"]))
    rng = random.Random(1)
    words = list(lexicon) + ["idiom", "", "i", "lowe", "loweixyz", "lweixyz", "idi0t", "worthles", "wrthles"]
    for w in list(words):
        for _ in range(60):
            c = list(w.rstrip("*"))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(c) + 1)
                c[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "o", "i"])
            words.append("".join(c))
    for w in words:
        best = (0.0, 0)
        for term, weight in lexicon.items():
            stem, k = term.rstrip("*"), toxicity.allowed(term)
            tried = [w[:n] for n in range(1, len(w) + 1)] if term.endswith("*") else [w] if w else []
            for e in (distance(t, stem) for t in tried):
                if e <= k:
                    best = max(best, (weight * 0.7 ** e, -e))
        want = (0.0, 0) if best[1] and w in m.clean else (best[0], -best[1])
        assert m.find(w) == pytest.approx(want), w


def test_quoted_matches():
    tokens = 'they said idiot once , then " you idiot " and later idiot came all alone out here'.split()
    hits = toxicity.matches(tokens, [(1.0, 0) if t == "idiot" else () for t in tokens])
    assert [q for *_, q in hits] == [True, True, False]


def test_op9_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    got = entry.queries()["op9_toxicity"](spark, d)
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((rows["toxic"] == 1) & (rows["predicted"] == 1)).sum()
    assert hit / (rows["toxic"] == 1).sum() > 0.9 and hit / (rows["predicted"] == 1).sum() > 0.9
    assert got.count() == 10000 and set(got.columns) == {"doc_id", "held_out", "score", "predicted"}


def test_toxicity_of_awkward_rows(spark):
    frame = docs(spark, AWKWARD + [(d, "you are a stupid moron " * 3, "en", "a") for d in range(100, 160)] + [(d, "a fine day it is", "en", "a") for d in range(200, 260)])
    labels = spark.createDataFrame([(d, 0, int(d < 200)) for d in list(range(100, 160)) + list(range(200, 260))] + [(1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r["_score"] for r in toxicity.scores(frame.select("doc_id", "text"), model).collect()}
    assert got[100] > 0.5 > got[200] and 0 <= got[2] < 0.5 and len(got) == len({r[0] for r in AWKWARD}) + 120
    none = toxicity.fit(frame.select("doc_id", "text"), labels.where("false"))
    assert {r["_score"] < 0.01 for r in toxicity.scores(frame.select("doc_id", "text"), none).collect()} == {True}
    assert toxicity.scores(docs(spark, []).select("doc_id", "text"), model).count() == 0


# ------------------------------------------------------------------ licences
def test_licences_inherit_from_the_nearest_directory(spark):
    page = "<html><head><title>{}</title></head><body><p>{}</p></body></html>"
    rows = [(1, "https://h.org/a/LICENSE", page.format("Licence", "Released under the MIT License.")), (2, "https://h.org/a/b/x.html?q=1", page.format("t", "some words")),
            (3, "https://h.org/a/b/c/", page.format("Licensed under the Apache License, Version 2.0.", "z")), (4, "https://h.org/a/b/c/d/e", page.format("t", "words")),
            (5, "https://other.org/x", page.format("t", "nothing")), (6, None, None), (7, "https://h.org/a/b/own", page.format("t", "Licensed under CC BY-NC 4.0.")),
            (8, "https://h.org/q", ""), (9, "http://h.org/a/z#f", page.format("T", "w " * 40000))]
    got = {r["file_id"]: (r["licence"], r["found"], r["place"]) for r in
           licenses.scan(spark.createDataFrame(rows, "file_id long, url string, html string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: got[2], 3: ("Apache-2.0", "own", None), 4: got[4],
                   5: (None, "none", None), 6: (None, "none", None), 7: ("CC-BY-NC-4.0", "own", None), 8: (None, "none", None), 9: ("MIT", "inherited", "h.org/a")}
    assert got[2] == ("Apache-2.0", "inherited", "h.org/a/b") and got[4] == ("Apache-2.0", "inherited", "h.org/a/b")
    assert licenses.scan(spark.createDataFrame([], "file_id long, url string, html string")).count() == 0


def test_licence_scan_runs_no_python(spark, small):
    plan = entry.queries()["op4_license_scan"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_passage_tasks_are_small():
    """Bytes that a task of the suffix arrays takes at once, and rows that it hands to the JVM at once."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 1000, np.uint8).tobytes() for _ in range(2000)]
    batches = list(suffixes._handed(suffixes._folded([(i, 0, t) for i, t in enumerate(texts)])))
    assert max(b.num_rows for b in batches) <= 20_000 < sum(b.num_rows for b in batches)
    pieces = [t[:170] for t in texts for _ in range(2)]
    pieces = [p for p, end in zip(pieces, np.cumsum([len(p) for p in pieces])) if end <= suffixes.ARRAY]
    tracemalloc.start()
    suffixes.repeated(pieces, np.full(len(pieces), 71), np.stack([np.arange(len(pieces)), *np.zeros((2, len(pieces)), np.int64)], axis=1))
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
