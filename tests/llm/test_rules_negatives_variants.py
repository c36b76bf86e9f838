import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from opsloom.llm import linequality, negatives, variants
from opsloom.llm.vectors import usable
from opsloom.operators import tiles
from tests.llm.rows import AWKWARD, docs
from tests.llm.test_vectors_pipeline import BAD, random_rows
from tools.check_queries import rows_of


@pytest.mark.parametrize("name, table", [("op11_bond_negatives", "embeddings"), ("op13_pivotal_variants", "documents")])
def test_query_equals_sql(spark, small, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    df = entry.queries()[name](spark, small)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert want and rows_of(df.columns, df.collect()) == want


# ------------------------------------------------------------------ hard negatives
def labelled(spark, rows):
    data = [(i, None if e is None else [None if x is None else float(x) for x in e], label, "x", 9) for i, e, label in rows]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, tile string, asks int").where("label is not null")
    return usable(df, zero=True, more=["label"])


def brute_negatives(rows, every):
    whole = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e], label) for i, e, label in rows]
    out = Counter()
    anchors = {}
    for i, e, label in whole:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (e, label)), (e, label))
    for a, (e, label) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(e, f)), i, other) for i, f, other in whole if i != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out.update((a, pid, rank, nid, -p, -n) for rank, (n, nid, _) in enumerate(fit, 1))
    return out


@pytest.mark.parametrize("scale", [1, 3000])
def test_negatives_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(tiles, "SMALLEST", 90)
    monkeypatch.setattr(tiles, "TILES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [scale * x for x in e], int(rng.integers(0, 3))) for i, e in random_rows(500, 12, 6)]
    rows += [(20, rows[3][1], 1), (20, rows[4][1], 0), (33, rows[5][1], 2), (33, rows[5][1], 2)]  # repeated ids
    unusable = [(i, e, 1) for i, e in BAD if i not in (1004, 1005, 1006)] + [(2000, [1.0] * 12, None)]
    some = rows + [(1004, [0.0] * 12, 1), (1005, [], 2), (1006, [3.0], 0)]
    got = Counter(tuple(r) for r in negatives.mined(labelled(spark, some + unusable), every=20).collect())
    assert got == brute_negatives(some, 20) and len(got) > 500


def test_no_vectors_no_negatives(spark):
    assert negatives.mined(labelled(spark, [])).count() == 0
    assert negatives.mined(labelled(spark, [(0, [1.0], 1), (1, [2.0], 1)])).count() == 0


def test_scan_drops_candidates_before_the_end():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(4000, 64)) * np.linspace(3, 0.01, 64)).astype(np.int64)
    tile = negatives.Columns(np.arange(4000), np.zeros(4000, np.int64), x)
    left = []
    tile.scan(x[0], np.arange(4000), lambda least, most: (left.append(len(least)), most >= np.partition(least, -5)[-5])[1])
    assert left[0] == 4000 and left[-1] < 100


# ------------------------------------------------------------------ quality rules
def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


REPEATS = [(20, "a b c d e f g\nx y a b c d e z q r s t u v w", "en", "a"), (21, "a a a a a a a a a a a", "en", "a"),
           (22, "one two\r\nthree\tfour\x0bfive\x0csix seven eight nine ten\n \none two\r\n*** <b> & | %", "en", "a"),
           (23, "a b c d\n\n\n\na b c d", "en", "a"), (24, "é è ê ë ē 日本 語 x y z é è ê ë ē 日本", "fr", "b")]


def test_base_counts_equal_plain_counts(spark):
    rows = AWKWARD + REPEATS
    out = linequality.judged(docs(spark, rows), None).collect()
    got = Counter((r["doc_id"], r["_n_words"], r["_word_chars"], r["_n_symbols"], r["_n_dup_lines"], r["_n_repeat_words"], r["_base_failed"]) for r in out)
    assert got == Counter((d, *plain_counts(t)) for d, t, _, _ in rows)
    assert all(r["size"] == 5 and r["n"] == "x" and r["_kept"] == (not r["_base_failed"]) for r in out)
    assert linequality.judged(docs(spark, []), None).count() == 0


def test_query_counts_equal_plain_counts(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = entry.queries()["op12_line_field"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert tuple(r[1:7]) == want and not (want[-1] and r["kept"])


def test_windows_with_one_hash_are_told_apart():
    """Words are compared themselves, in texts of every length."""
    rng = np.random.default_rng(0)
    texts = [rng.choice([b"a", b"b"], n).tolist() for n in rng.integers(0, 30, 200)]
    got = linequality.repeated_words([w for t in texts for w in t], np.array([len(t) for t in texts]))
    assert got.tolist() == [plain_counts(" ".join(w.decode() for w in t))[4] for t in texts]


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    field = linequality.Field(rng.normal(size=(linequality.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([0, 5, 1, 8, 0, 3])
    x = rng.normal(size=(lengths.sum(), linequality.FEATURES))
    got, score = field.viterbi(x, lengths), x @ field.emit
    for begin, n in zip(np.cumsum(lengths) - lengths, lengths):
        own = score[begin:begin + n]
        worth = lambda p: (field.start[p[0]] + sum(own[i, k] for i, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))) if p else 0
        assert tuple(got[begin:begin + n]) == max(itertools.product((0, 1), repeat=int(n)), key=worth)


def test_gradient_equals_differences():
    rng = np.random.default_rng(9)
    lengths, f = np.array([3, 1, 4]), linequality.FEATURES
    x, y = rng.normal(size=(3, 4, f)), rng.integers(0, 2, (3, 4))
    field = linequality.Field(rng.normal(size=(f, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))

    def likelihood():
        out = 0.0
        for t, n in enumerate(lengths):
            worth = lambda p: field.start[p[0]] + sum((x[t, i] @ field.emit)[k] for i, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            out += worth(y[t, :n]) - np.logaddexp.reduce([worth(p) for p in itertools.product((0, 1), repeat=int(n))])
        return out

    for part, gradient in zip((field.emit, field.move, field.start), linequality._likelihood(field, x, y, lengths)):
        for at in itertools.islice(np.ndindex(part.shape), 6):
            old = part[at]
            part[at] = old + 1e-5
            up = likelihood()
            part[at] = old - 1e-5
            down = likelihood()
            part[at] = old
            assert abs((up - down) / 2e-5 - gradient[at]) < 1e-5


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in entry.queries()["op12_line_field"](spark, d).collect()}
    held = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % linequality.FOLDS == linequality.FOLDS - 1]
    judged = [(r["quality"], got[r["doc_id"]]["kept"]) for r in held if not got[r["doc_id"]]["base_failed"]]
    assert len(judged) > 50 and np.mean([bool(q) == k for q, k in judged]) > 0.95


def test_no_labels_keep_what_passes_the_rules(spark):
    d = docs(spark, REPEATS)
    assert linequality.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert linequality.fit(d, spark.createDataFrame([(20, 1, 0), (None, 0, 0), (22, None, 0)], "doc_id long, quality int, toxic int")) is None


# ------------------------------------------------------------------ spelling variants
def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def brute_variants(counts):
    form, out = {}, {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        top = near[0] if near and -near[0][0] >= 2 * n else None
        form[w] = top and top[1]
        out[w] = (n, len(near), form[w], top and -top[0])
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def plain_words(rows, noise):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if noise and doc_id is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    base = ["".join(rng.choice(list("abcé"), rng.integers(5, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Éaaaa", "éaaaa"]
    words = []
    for i, w in enumerate(base):
        for _ in range(rng.integers(0, 6)):
            at, c = rng.integers(0, len(w) + 1), str(rng.choice(list("abcdé")))
            words += [str(rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]]))] * int(rng.integers(1, 9))
        words += [w] * int(2 ** rng.integers(0, 8))
    rng.shuffle(words)
    texts = [(i, " ".join(words[i * 40:(i + 1) * 40])) for i in range(len(words) // 40 + 1)]
    d = docs(spark, [(i, t, "en", "a") for i, t in texts])
    for noise in (False, True):
        counts = plain_words(texts, noise)
        got = variants.variants(variants.word_counts(d, noise)).collect()
        assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == brute_variants(counts)
        assert len(got) == len(counts) > 200 and any(r["root"] not in (r["form"], r["word"]) for r in got)


def test_words_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    rows = AWKWARD * 3 + [(9, "x" * 3000 + " " + "y" * 2999 + "X", "en", "a")] * 3 + [(10, "x" * 3001, "en", "a")] * 9
    d = docs(spark, rows)
    want = plain_words([(i, t) for i, t, _, _ in rows], True)
    assert {r["word"]: r["n"] for r in variants.word_counts(d, True).collect()} == want
    got = {r["word"]: r["root"] for r in variants.variants(variants.word_counts(d)).collect()}
    assert got["x" * 3000] == "x" * 3001
    assert variants.variants(variants.word_counts(docs(spark, []))).count() == 0


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = np.random.default_rng(7)
    order = {a + b: (i, float(c)) for i, (a, b, c) in enumerate(zip("aabbccabc" * 2, "abcabcabc" * 2, rng.integers(1, 50, 18)))}
    order = {g: (i, c) for i, (g, (_, c)) in enumerate(sorted(order.items(), key=lambda x: x[1][1]))}
    for _ in range(200):
        word = next(w for w in ("".join(rng.choice(list("abc"), rng.integers(5, 12))) for _ in iter(int, 1)) if all(w[i:i + 2] in order for i in range(len(w) - 1)))
        places, last = variants.prefix_of(word, order)
        got = variants.pivots_of(word, places, order)
        cost = lambda p: sum(order[word[i:i + 2]][1] for i in p)
        pairs = [p for p in itertools.combinations(places, 2) if p[1] - p[0] >= 2]
        assert len(places) >= 3 and got[1] - got[0] >= 2 and cost(got) == min(map(cost, pairs))
        assert last == max(order[word[i:i + 2]][0] for i in places)
