"""Rules, span algebra and round trips."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.functions.spans import SPANS, pin
from veilspark.operators import span_algebra as A
from veilspark.operators.engine import DeidEngine, gazetteer, mapping_of, mapping_rows, restore, span_rows, unknown_sessions, with_session
from veilspark.operators.evaluate import metrics
from veilspark.operators.rules import Soft

SEED = "abandon ability able about above absent absorb abstract absurd abuse access accident"
KEY = "-----BEGIN RSA " + "PRIVATE KEY-----\nabc\n-----END RSA " + "PRIVATE KEY-----"
MATCH = [
    ("TW_NATIONAL_ID", "身分證A123456789在這", 3, 13), ("TW_NATIONAL_ID", "𠮷A123456789", 1, 11), ("TW_PASSPORT", "護照號碼A12345678入境", 4, 13), ("TW_ARC", "A812345678", 0, 10), ("TW_ARC", "AA12345678", 0, 10),
    ("TW_MOBILE", "0912345678", 0, 10), ("TW_MOBILE", "0912-345-678", 0, 12), ("TW_MOBILE", "+886 912 345 678", 0, 16), ("TW_MOBILE", "手機09１２３４５６７８", 2, 12), ("TW_LANDLINE", "(02)1234-5678", 0, 13),
    ("TW_LANDLINE", "02-12345678", 0, 11), ("TW_BUSINESS_ID", "統編04595257", 2, 10), ("EMAIL_ADDRESS", "電子郵件john@example.com以便聯絡", 4, 20), ("CREDIT_CARD", "信用卡號 4111111111111111 請保密", 5, 21),
    ("TW_LICENSE_PLATE", "車牌ABC-1234", 2, 10), ("TW_LICENSE_PLATE", "車籍123-AB", 2, 8), ("TW_BIRTH_DATE", "民國 90 年 1 月 1 日", 0, 15), ("TW_BIRTH_DATE", "生日" + "啊" * 40 + "1990-01-01", 42, 52),
    ("TW_BANK_ACCOUNT", "帳號123456789012", 2, 14), ("TW_ADDRESS", "台北市信義區信義路五段7號101大樓A棟5樓502室", 0, 26), ("TW_ADDRESS", "地址：信義路五段7號", 3, 10), ("TW_ADDRESS", "忠孝東路10巷5弄3號", 0, 11),
    ("TW_VERIFICATION_CODE", "驗證碼：9F4T2A", 4, 10), ("TW_VERIFICATION_CODE", "otp 123456", 4, 10), ("TW_PASSWORD", "密碼為：S3cure!Passw0rd（測試", 4, 19), ("TW_PASSWORD", "他的passport是B98765432", 6, 10),
    ("TW_CRYPTO_SEED", "以下是助記詞：\n" + SEED, 8, 8 + len(SEED)), ("TW_PRIVATE_KEY", KEY, 0, len(KEY)),
]
NONE = [
    ("TW_NATIONAL_ID", "A323456789"), ("TW_NATIONAL_ID", "a123456789"), ("TW_NATIONAL_ID", "A1234567890"), ("TW_NATIONAL_ID", "AB23456789"), ("TW_PASSPORT", "A123456789"), ("TW_ARC", "A123456789"), ("TW_MOBILE", "09123456789"),
    ("TW_MOBILE", "手機０９１２３４５６７８"), ("TW_MOBILE", "+885912345678"), ("TW_LANDLINE", "0912345678"), ("TW_LANDLINE", "02-1234-5678"), ("TW_BUSINESS_ID", "帳號是04595257"), ("TW_BUSINESS_ID", "公司" + "X" * 60 + "04595257"),
    ("TW_BUSINESS_ID", "公司12345678"), ("EMAIL_ADDRESS", "not@valid"), ("CREDIT_CARD", "4111111111111112"), ("TW_LICENSE_PLATE", "ABC-1234"), ("TW_LICENSE_PLATE", "車牌ABC-12345"), ("TW_BIRTH_DATE", "1990-01-01"),
    ("TW_BANK_ACCOUNT", "123456789012"), ("TW_BANK_ACCOUNT", "帳號4111111111111111"), ("TW_ADDRESS", "我住在台北市，之後再說詳細地址"), ("TW_ADDRESS", "台北市這裡天氣不錯，另外提一下大安區最近很熱鬧"), ("TW_VERIFICATION_CODE", "驗證碼AB12請"), ("TW_CRYPTO_SEED", SEED),
]


@pytest.fixture(scope="module")
def detected(spark):
    rows = [(i, t) for i, t in enumerate([*(m[1] for m in MATCH), *(t for _, t in NONE)])]
    return {r["doc_id"]: r for r in DeidEngine().anonymize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_matches(detected):
    for i, (kind, text, start, end) in enumerate(MATCH):
        assert (kind, start, end) in [(s["entity_type"], s["start"], s["end"]) for s in detected[i]["spans"]], (kind, text)


def test_no_matches(detected):
    for i, (kind, text) in enumerate(NONE, len(MATCH)):
        assert kind not in [s["entity_type"] for s in detected[i]["spans"]], (kind, text)


def test_all_come_back_and_resolved_spans_are_disjoint(detected):
    for r in detected.values():
        assert r["roundtrip_ok"]
        ends = [(s["start"], s["end"]) for s in r["resolved"]]
        assert all(a < b for a, b in ends) and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))
        assert all(r["text"][a:b] not in r["anonymized"] for a, b in ends)


def test_numbering_and_repeats(spark):
    df = spark.createDataFrame([(1, "甲A123456789，乙B234567890，再A123456789")], "doc_id long, text string")
    back = DeidEngine().anonymize(df).first()
    assert back["anonymized"] == "甲<TW_NATIONAL_ID_1>，乙<TW_NATIONAL_ID_2>，再<TW_NATIONAL_ID_1>"
    forward = DeidEngine(numbering="forward").anonymize(spark.createDataFrame([(1, "甲A123456789，乙B234567890")], "doc_id long, text string")).first()
    assert [e["original"] for e in forward["entries"]] == ["A123456789", "B234567890"]
    with pytest.raises(ValueError):
        DeidEngine(numbering="sideways")


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<TW_MOBILE_1> 0912345678"), (3, "<TW_MOBILE_1> 0912345678")], "doc_id long, text string")
    rows = DeidEngine().anonymize(df).orderBy("doc_id").collect()
    assert rows[0]["anonymized"] is None and rows[0]["entity_count"] == 0 and rows[1]["anonymized"] == ""
    assert not rows[2]["roundtrip_ok"] and len(rows) == 4  # a text that holds a placeholder is flagged
    assert DeidEngine().anonymize(df.limit(0)).count() == 0


def test_restore_does_not_cascade(spark):
    df = spark.createDataFrame([("<A_1> <A_10> <A_2>", {"<A_1>": "<A_10>", "<A_10>": "x"})], "t string, m map<string,string>")
    assert df.select(F.expr(A.restore_once("t", "map_entries(m)"))).first()[0] == "<A_10> x <A_2>"


def test_sessions(spark):
    assert with_session(spark.range(3)).select("session_id").distinct().count() == 3
    base = spark.createDataFrame([("s1", "手機0912345678"), ("s2", "無")], "session_id string, text string")
    out = DeidEngine().anonymize(base)
    maps = mapping_rows(out, "session_id")
    back = {r["session_id"]: r for r in restore(out.select("session_id", "anonymized"), maps, "session_id").collect()}
    assert back["s1"]["restored"] == "手機0912345678" and back["s1"]["known"] and not back["s2"]["known"]
    asked = spark.createDataFrame([("s1",), ("gone",)], "session_id string")
    assert [r[0] for r in unknown_sessions(asked, maps).collect()] == ["gone"]


def test_names_and_dates(spark):
    engine = DeidEngine(ner=gazetteer({"民國": "PERSON", "張大明": "PERSON"}))
    rows = span_rows(engine.detect(spark.createDataFrame([(1, "張大明生於民國85年12月3日")], "doc_id long, text string")), "doc_id").collect()
    assert {(r["entity_type"], r["value"]) for r in rows} == {("PERSON", "張大明"), ("TW_BIRTH_DATE", "民國85年12月3日")}


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, entity_type string, start int, end int")
    (total,) = metrics(none, none).collect()
    assert (total["entity_type"], total["precision"], total["recall"], total["tp"]) == ("__total__", 1.0, 1.0, 0)


def test_mapping_map(spark):
    row = DeidEngine().anonymize(spark.createDataFrame([("手機0912345678",)], "text string")).select(mapping_of(F.col("entries")).alias("m")).first()
    assert row["m"] == {"<TW_MOBILE_1>": "0912345678"}


def test_pins_hold_in_the_plan(spark):
    """A pinned column is computed once, whatever a filter or a lambda above does with it."""
    df = pin(spark.createDataFrame([("a b",)], "text string"), "words", F.split("text", " "))
    df = df.filter(F.size("words") > 1).select(F.transform("words", lambda w: F.array_position("words", w)).alias("at"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert df.collect()[0]["at"] == [1, 2]


def test_filters_reach_the_scan(spark, tmp_path):
    """Filters on input columns pass below the engine; those on its own columns do not copy its work."""
    spark.range(20).selectExpr("id AS doc_id", "concat('手機09', lpad(id, 8, '0')) AS text").write.parquet(f"{tmp_path}/t")
    done = DeidEngine().anonymize(spark.read.parquet(f"{tmp_path}/t"))
    rows = done.filter("doc_id = 5 AND size(spans) > 0 AND roundtrip_ok")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 4 and plan.count("+886") == done._jdf.queryExecution().executedPlan().toString().count("+886")
    assert [r["anonymized"] for r in rows.collect()] == ["手機<TW_MOBILE_1>"]


def test_building_is_quick(spark):
    """Rules are SQL text that is parsed once, not thousands of calls to the JVM."""
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    DeidEngine().anonymize(df)
    took = []
    for threshold in (0.51, 0.52, 0.53):
        start = time.perf_counter()
        DeidEngine(threshold=threshold).anonymize(df)
        took.append(time.perf_counter() - start)
    assert min(took) < 2


def test_containment_and_numbers_against_pairs(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        starts = [rng.randrange(12) for _ in range(rng.randrange(7))]
        rows.append((i, [(rng.choice("ABC"), a, a + rng.randrange(1, 7), rng.choice([0.5, 0.9])) for a in starts], [(rng.choice("vwxyz"), rng.choice("ABC")) for _ in range(rng.randrange(9))]))
    df = spark.createDataFrame(rows, f"id int, s {SPANS}, v array<struct<value:string,entity_type:string>>")
    got = df.select("id", F.expr(A.drop_contained("s")).alias("kept"), F.expr(A.entries_of(A.numbered("v"))).alias("entries")).orderBy("id").collect()

    def beats(o, x):
        if o[1:3] == x[1:3]:
            return (o[3], o[0]) > (x[3], x[0])
        return o[1] <= x[1] and x[2] <= o[2]

    for g, (_, spans, values) in zip(got, rows):
        assert [tuple(s) for s in g["kept"]] == sorted(x for x in spans if not any(beats(o, x) for o in spans))
        want, counts = {}, Counter()
        for value, kind in values:
            if value not in want:
                counts[kind] += 1
                want[value] = (value, kind, counts[kind], f"<{kind}_{counts[kind]}>")
        assert [tuple(e) for e in g["entries"]] == list(want.values())


def test_many_values_in_one_text(spark):
    """20,000 values, of which each stands twice, in one text: sorts and scans, so the time grows with the text."""
    for n in (1000, 20000):
        names = [f"user{i}@example.com" for i in range(n // 2)] * 2
        df = DeidEngine(entities=("EMAIL_ADDRESS",)).anonymize(spark.createDataFrame([(1, ", ".join(names))], "doc_id long, text string"))
        start = time.perf_counter()
        row = df.collect()[0]
        took = time.perf_counter() - start
        assert row["entity_count"] == n // 2 and row["roundtrip_ok"] and row["anonymized"] == ", ".join([f"<EMAIL_ADDRESS_{n // 2 - i}>" for i in range(n // 2)] * 2)
    assert took < 20


def test_soft_words_raise_scores(spark):
    """Words up to five ahead of a match raise its score; that decides at higher thresholds."""
    texts = ["護照B12345678", "passport no. B12345678", "護照" + "字" * 8 + "B12345678", "護照" + "字" * 9 + "B12345678", "B12345678 護照", "passport a b c d e B12345678", "編號B12345678"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = lambda e: {r["doc_id"]: r["score"] for r in span_rows(e.detect(df), "doc_id").collect()}
    one = DeidEngine(entities=["TW_PASSPORT"])
    assert scores(one) == {0: 0.95, 1: 0.95, 2: 0.95, 3: 0.6, 4: 0.6, 5: 0.6, 6: 0.6}
    assert set(scores(DeidEngine(entities=["TW_PASSPORT"], threshold=0.7))) == {0, 1, 2}
    assert scores(DeidEngine(entities=["TW_PASSPORT"], threshold=0.7, soft=None)) == {}
    assert set(scores(DeidEngine(entities=["TW_PASSPORT"], threshold=0.7, soft=Soft(before=0, after=1)))) == {4}
    # a better score keeps its whole place where two spans overlap
    card = spark.createDataFrame([(1, "電話0212345678-1234")], "doc_id long, text string")
    assert [s["score"] for s in DeidEngine(entities=["TW_LANDLINE"]).detect(card).first()["spans"]] == [1.0]
