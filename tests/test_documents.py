import random

from pyspark.sql import functions as F

from opsloom.functions import documents as D
from opsloom.functions import privacy as P
from opsloom.functions import requests as Q


def plain_pack(text, size, end):
    if len(text) <= size:
        return [text]
    out, cur = [], ""
    for s in text.split(end):
        if len(cur + s) > size:
            if cur:
                out.append(cur.strip())
            cur = s + end
        else:
            cur += s + end
    return out + [cur.strip()]


def test_chunks_equal_plain_packing(spark):
    rnd = random.Random(1)
    texts = ["。".join("字" * rnd.randint(0, 90) for _ in range(rnd.randint(1, 40))) for _ in range(40)] + ["", "长" * 700, "a。" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for (got,), t in zip(df.select(D.pack_sentences(F.col("t"))).collect(), texts):
        assert got == plain_pack(t, 512, "。")


def test_overlap_chunks(spark):
    df = spark.createDataFrame([("abcdefgh. ijklmnop. qrstuvwx.",)], "t string")
    tail = df.select(D.pack_with_overlap(F.col("t"), 12, 3)).first()[0]
    assert tail == ["abcdefgh.", "gh. ijklmnop.", "op. qrstuvwx."]
    own = df.select(D.pack_with_overlap(F.col("t"), 12, 3, style="sentence")).first()[0]
    assert own == ["abcdefgh.", "op. ijklmnop.", "wx. qrstuvwx."]


def test_no_character_of_a_long_sentence_is_lost(spark):
    text = "Short one. " + "".join(chr(0x4E00 + i) for i in range(20000)) + ". Then " + "".join(chr(0xAC00 + i) for i in range(1300)) + "! End"
    for style in ("tail", "sentence"):
        chunks = spark.createDataFrame([(text,)], "t string").select(D.pack_with_overlap(F.col("t"), 512, 50, style=style)).first()[0]
        assert set(text) == set("".join(chunks)) and max(map(len, chunks)) <= 562 and chunks[-1].endswith(" End")


def test_refused_texts_stay_with_a_reason(spark):
    df = spark.createDataFrame([(1, "short"), (2, "long enough text"), (3, "x" * 30), (4, None)], "id int, content string")
    got = {r.id: (r.kept, r.reason) for r in P.clean_documents(df, least=10, most=20).collect()}
    assert got == {1: (False, "too short"), 2: (True, None), 3: (False, "too long"), 4: (False, "too short")}
    assert {r.kept for r in P.clean_documents(df).collect()} == {True}


def test_change_and_ticket_fields(spark):
    row = spark.range(1).select(
        D.change_keywords(F.array(F.lit("bug")), F.array(F.lit("a/b.py"), F.lit("docker/config.yml")), F.lit("Fix it"), F.lit(None))
        .alias("k"),
        D.change_entities(F.array(F.lit("API")), F.array(F.lit("x/auth-service/y.py"))).alias("e"),
        D.ticket_entities(F.array(F.lit("web-server"), F.lit("cache")), F.lit("mysql"), F.lit("")).alias("t")).first()
    assert row.k == ["bug", "configuration", "docker", "fix", "language:py"]
    assert row.e == ["component:API", "service:auth-service"]
    assert row.t == ["component:cache", "service:web-server", "technology:mysql"]


def test_request_classes(spark):
    df = spark.createDataFrame([(1, "最近 service-b error on d1-app-01 紧急"), (2, "hello"), (3, "CPU")], "id int, query string")
    rows = {r.id: r for r in Q.classify_requests(df, F.lit("2024-01-02").cast("timestamp")).collect()}
    assert (rows[1].filter_service, rows[1].filter_level, rows[1].filter_host) == ("service-b", "ERROR", "d1-app-01")
    assert (rows[1].priority, rows[1].is_incident, str(rows[1].filter_from)) == ("high", True, "2024-01-01 00:00:00")
    assert (rows[2].is_incident, rows[2].problem_type, rows[2].filter_from) == (False, "general", None)
    assert not rows[3].is_incident


def test_privacy(spark):
    text = 'mail bob.x@corp.com card 1234-5678-9012-3456 password: hunter2 ip 10.0.0.1'
    row = spark.range(1).select(P.sensitive_matches(F.lit(text)).alias("m"), P.mask_sensitive(F.lit(text)).alias("k"),
                                P.mask_field(F.lit("abcdef")).alias("f"), P.mask_field(F.lit("abc")).alias("g")).first()
    assert row.m["email"] == ["bob.x@corp.com"] and row.m["password"] == ["hunter2"] and "credit_card" in row.m
    assert "hunter2" not in row.k and "bob.x" not in row.k and "****3456" in row.k and "[MASKED_IP_ADDRESS]" in row.k
    assert (row.f, row.g) == ("ab**ef", "***")
