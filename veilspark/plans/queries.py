"""Queries over the driver tables and their DuckDB SQL.

The tables hold no Taiwanese data, so most detection queries build their text from keys of ``customer``, with one SQL
expression that both engines understand. Their SQL tells from the keys alone which spans there must be; where rules
apply to ``documents``, SQL finds maximal runs instead, as its patterns have no look-around.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import spread
from ..operators import span_algebra as A
from ..operators.engine import DeidEngine, allowed, decision, gazetteer, mapping_rows, mask_terms, report, restore, span_rows
from ..operators.evaluate import align, gate, metrics
from ..operators.names import ModelNames, Names, english_names, pattern_model
from ..operators.store import MappingStore, audit, unmask
from ..sources.files import anonymize_cells

Query = Callable[[SparkSession, str], DataFrame]
K = "c_custkey"
_P8 = f"lpad(cast({K} as string), 8, '0')"
_SUM = " + ".join(f"((cast(substr(p, {i}, 1) as int) * {w}) // 10 + (cast(substr(p, {i}, 1) as int) * {w}) % 10)" for i, w in enumerate((1, 2, 1, 2, 1, 2, 4, 1), 1))

#: name: (entity, text before, value, text after, SQL condition for a match); columns: K, p (key of 8 digits)
CASES: dict[str, tuple[str, str, str, str, str]] = {
    "detect_national_id": ("TW_NATIONAL_ID", "'身分證'", f"concat('A', cast(1 + {K} % 3 as string), p)", "'在這'", f"{K} % 3 < 2"),
    "detect_arc": ("TW_ARC", "'居留證'", f"concat('A', substr('ABCDEF', cast(1 + {K} % 6 as int), 1), p)", "'號'", f"{K} % 6 < 4"),
    "detect_passport": ("TW_PASSPORT", "'護照號碼'", "concat('B', p)", f"CASE WHEN {K} % 4 = 0 THEN '7' ELSE '入境' END", f"{K} % 4 <> 0"),
    "detect_mobile": ("TW_MOBILE", "'手機'", f"CASE WHEN {K} % 3 = 0 THEN concat('09', p) WHEN {K} % 3 = 1 THEN concat('09', substr(p, 1, 2), '-', substr(p, 3, 3), '-', substr(p, 6, 3)) ELSE concat('+886-9', substr(p, 1, 2), '-', substr(p, 3, 3), '-', substr(p, 6, 3)) END", "'。'", "true"),
    "detect_landline": ("TW_LANDLINE", "'電話'", f"CASE WHEN {K} % 3 = 0 THEN concat('02', p) WHEN {K} % 3 = 1 THEN concat('(04)', substr(p, 1, 4), '-', substr(p, 5, 4)) ELSE concat('07-', p) END", "'。'", "true"),
    "detect_business_id_checksum": ("TW_BUSINESS_ID", "'統一編號'", "p", "'。'", f"(({_SUM}) % 10 = 0 OR (substr(p, 7, 1) = '7' AND ({_SUM} - 1) % 10 = 0))"),
    "context_gate": ("TW_BUSINESS_ID", f"concat(CASE WHEN {K} % 2 = 0 THEN '發票' ELSE '單據' END, repeat('X', cast({K} % 60 as int)))", "'04595257'", "'。'", f"{K} % 2 = 0 AND {K} % 60 <= 49"),
    "detect_license_plate": ("TW_LICENSE_PLATE", "'車牌'", f"CASE WHEN {K} % 2 = 0 THEN concat('ABC-', substr(p, 5, 4)) ELSE concat(substr(p, 5, 4), '-XY') END", "'。'", "true"),
    "detect_birth_date": ("TW_BIRTH_DATE", f"CASE WHEN {K} % 3 = 1 THEN '日期' ELSE '生日' END", f"CASE WHEN {K} % 3 = 0 THEN concat('民國', cast(50 + {K} % 49 as string), '年', cast(1 + {K} % 12 as string), '月', cast(1 + {K} % 28 as string), '日') ELSE concat(cast(1950 + {K} % 50 as string), '-', cast(1 + {K} % 12 as string), '-', cast(1 + {K} % 28 as string)) END", "'。'", f"{K} % 3 <> 1"),
    "detect_bank_account": ("TW_BANK_ACCOUNT", f"CASE WHEN {K} % 2 = 0 THEN '帳號' ELSE '編碼' END", "concat('0012', p)", "'。'", f"{K} % 2 = 0"),
    "detect_address": ("TW_ADDRESS", "'地址：'", f"CASE WHEN {K} % 4 = 3 THEN '台北市' ELSE concat('台北市信義區信義路', cast(1 + {K} % 9 as string), '號', cast(1 + {K} % 20 as string), '樓') END", "'。'", f"{K} % 4 <> 3"),
    "detect_verification_code": ("TW_VERIFICATION_CODE", "'驗證碼：'", "concat('X', substr(p, 4, 5))", f"CASE WHEN {K} % 3 = 0 THEN '請' ELSE '。' END", f"{K} % 3 <> 0"),
    "detect_password": ("TW_PASSWORD", "'密碼為：'", "concat('S3cure!', p)", "'（測試）'", "true"),
    "detect_crypto_seed": ("TW_CRYPTO_SEED", f"CASE WHEN {K} % 2 = 0 THEN '助記詞：' ELSE '單字：' END", f"concat(repeat('apple ', cast(10 + {K} % 3 as int)), 'pear')", "'。'", f"{K} % 2 = 0 AND {K} % 3 > 0"),
    "detect_private_key": ("TW_PRIVATE_KEY", "'x '", "concat('-----BEGIN RSA ', 'PRIVATE', ' KEY-----', p, '-----END RSA ', 'PRIVATE', ' KEY-----')", "' y'", "true"),
}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where a local session leaves it unset."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return (got or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows that are read more than once, as Parquet in the shared folder: so they are computed once."""
    at = f"{scratch(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Customers' keys, over all cores: millions of them fit one split of the scan, and each becomes a text to search."""
    return spread(spark.read.parquet(f"{d}/customer.parquet").select(K))


def _made(spark: SparkSession, d: str, text: str) -> DataFrame:
    """(doc_id, text) from customers' keys."""
    return _keys(spark, d).select(K, F.expr(f"{_P8} AS p")).select(F.col(K).alias("doc_id"), F.expr(f"{text} AS text"))


def _case(name: str) -> tuple[Query, str]:
    entity, before, value, after, holds = CASES[name]
    text = f"concat({before}, {value}, {after})"

    def query(spark: SparkSession, d: str) -> DataFrame:
        return span_rows(DeidEngine(entities=[entity]).detect(_made(spark, d, text)), "doc_id").select("doc_id", "entity_type", "start", "end", "value")

    return query, f"""
WITH k AS (SELECT {K}, {_P8} AS p FROM customer)
SELECT {K} AS doc_id, '{entity}' AS entity_type, length({before})::INTEGER AS start, (length({before}) + length({value}))::INTEGER AS "end", {value} AS value
FROM k WHERE {holds}"""


# one text with four kinds of values, of which two repeat
_MIX = f"concat('身分證A1', p, '，手機09', p, '，再次A1', p, '，信箱u', cast({K} as string), '@example.com，手機0911222333')"


def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.length("text").cast("long").alias("chars"))


def detect_email(spark: SparkSession, d: str) -> DataFrame:
    rows = span_rows(DeidEngine(entities=["EMAIL_ADDRESS"]).detect(_documents(spark, d)), "doc_id")
    return rows.groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.min("start").alias("first"))


def detect_credit_card_luhn(spark: SparkSession, d: str) -> DataFrame:
    rows = span_rows(DeidEngine(entities=["CREDIT_CARD"]).detect(_documents(spark, d)), "doc_id")
    return rows.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def anonymize_mix(spark: SparkSession, d: str) -> DataFrame:
    return DeidEngine().anonymize(_made(spark, d, _MIX)).select("doc_id", "anonymized", F.col("entity_count").cast("long").alias("entity_count"), "roundtrip_ok")


def number_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = DeidEngine(numbering="forward").anonymize(_made(spark, d, _MIX))
    return mapping_rows(rows, "doc_id").select("doc_id", "placeholder", "entity_type", F.col("ordinal").cast("long").alias("ordinal"), "original")


def mapping_table(spark: SparkSession, d: str) -> DataFrame:
    rows = DeidEngine().anonymize(_made(spark, d, _MIX))
    return mapping_rows(rows, "doc_id").select("doc_id", "placeholder", "original")


def anonymize_documents(spark: SparkSession, d: str) -> DataFrame:
    """All rules over all documents; every text must come back."""
    return DeidEngine().anonymize(_documents(spark, d)).groupBy().agg(F.count("*").alias("documents"), F.sum(F.col("roundtrip_ok").cast("long")).alias("restored"))


def restore_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Restoration by a join with stored mapping rows."""
    done = DeidEngine(entities=["EMAIL_ADDRESS", "CREDIT_CARD"]).anonymize(_documents(spark, d))
    back = restore(done.select("doc_id", "anonymized"), mapping_rows(done, "doc_id"), "doc_id")
    return back.select("doc_id", "restored")


def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Touching spans of one type join; others stay."""
    span = lambda kind, a, b: f"named_struct('entity_type', '{kind}', 'start', cast({a} as int), 'end', cast({b} as int), 'score', 0.5D)"
    rows = _keys(spark, d).select(F.col(K).alias("doc_id"), F.expr(f"array({span('B', 0, 5)}, {span('B', f'5 + {K} % 3', 9)}, {span('A', 2, 4)}) AS s"))
    return rows.select("doc_id", F.explode(F.expr(A.merge_touching("s"))).alias("s")).select("doc_id", "s.entity_type", "s.start", "s.end")


def person_over_date_antijoin(spark: SparkSession, d: str) -> DataFrame:
    engine = DeidEngine(entities=["PERSON", "TW_BIRTH_DATE"], ner=gazetteer({"民國": "PERSON", "王小明": "PERSON"}))
    rows = engine.detect(_made(spark, d, f"concat(CASE WHEN {K} % 2 = 0 THEN '王小明，' ELSE '' END, '民國90年1月1日')"))
    return span_rows(rows, "doc_id").select("doc_id", "entity_type", "start", "end")


def resolve_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of different types: contained spans go, partial ones are cut at the lower score."""
    span = lambda kind, a, b, s: f"named_struct('entity_type', '{kind}', 'start', cast({a} as int), 'end', cast({b} as int), 'score', {s}D)"
    rows = _keys(spark, d).select(F.col(K).alias("doc_id"), F.lit("x" * 30).alias("text"), F.expr(f"array({span('A', 0, 10, 0.9)}, {span('B', f'4 + {K} % 10', 14, 0.5)}, {span('C', 2, 5, 0.95)}) AS spans"))
    out = DeidEngine().resolve(rows)
    return out.select("doc_id", F.explode("resolved").alias("s")).select("doc_id", "s.entity_type", "s.start", "s.end")


def cell_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, "concat('手機\\n09', p, '\\n姓名')").withColumn("cells", F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.format_string("Sheet1!A%d", i + 1).alias("key"), x.alias("text"))))
    out = anonymize_cells(DeidEngine().anonymize(rows))
    return out.select("doc_id", F.explode("new_cells").alias("c"), F.size("leaks").cast("long").alias("leaks")).select("doc_id", "c.key", "c.text", "leaks")


def counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return report(DeidEngine().detect(_made(spark, d, _MIX))).select("entity_type", "name", "found")


def counts_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = span_rows(DeidEngine().detect(_made(spark, d, _MIX)), "doc_id")
    return rows.rollup("entity_type").agg(F.count("*").alias("found")).select(F.coalesce("entity_type", F.lit("__total__")).alias("entity_type"), "found")


def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    rows = span_rows(DeidEngine().detect(_made(spark, d, _MIX)), "doc_id")
    return rows.groupBy("entity_type").agg(F.countDistinct("value").alias("n_values"))


def metrics_prf(spark: SparkSession, d: str) -> DataFrame:
    """Found national ids against a gold table that has other rows, too."""
    found = detection["detect_national_id"](spark, d)
    gold = spark.read.parquet(f"{d}/customer.parquet").filter(f"{K} % 2 = 0").select(F.col(K).alias("doc_id"), F.lit("TW_NATIONAL_ID").alias("entity_type"), F.lit(3).alias("start"), F.lit(13).alias("end"))
    return metrics(found, gold)


def known_value_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A value that one place reveals is replaced in all places."""
    rows = DeidEngine(entities=["TW_BUSINESS_ID"], sweep=True).anonymize(_made(spark, d, f"concat('統編04595257', repeat('Z', 60), '04595257', cast({K} as string))"))
    return rows.select("doc_id", "anonymized")


def mask_manual_terms(spark: SparkSession, d: str) -> DataFrame:
    return mask_terms(_made(spark, d, "concat('王小明與王小明明', p)"), ["王小明", "小明明"]).select("doc_id", "masked")


def pre_read_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = DeidEngine().detect(_made(spark, d, f"CASE WHEN {K} % 2 = 0 THEN concat('手機09', p) ELSE '無' END").withColumn("path", F.concat(F.lit("f"), F.col("doc_id").cast("string"))))
    return decision(rows).filter("response is not null").select("doc_id", "response")


# a passport number after one of its soft words, or another word, and up to 19 other characters
_SOFT = f"concat(CASE {K} % 3 WHEN 0 THEN '護照' WHEN 1 THEN '出入境' ELSE '單號' END, repeat('字', cast({K} % 20 as int)), 'B', p)"


def soft_context_threshold(spark: SparkSession, d: str) -> DataFrame:
    """At 0.7, passport numbers are found only where one of their words stands among the five words before."""
    rows = DeidEngine(entities=["TW_PASSPORT"], threshold=0.7).detect(_made(spark, d, _SOFT))
    return span_rows(rows, "doc_id").select("doc_id", "start", "end", "score", "value")


def soft_context_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of all, at the usual threshold."""
    rows = DeidEngine(entities=["TW_PASSPORT"]).detect(_made(spark, d, _SOFT))
    return span_rows(rows, "doc_id").select("doc_id", "start", "score")


# a name after up to 699 characters, so in any of several windows, and English ones, one of them before an @
_NAMED = f"concat(repeat('字', cast({K} % 700 as int)), '王小明', repeat('文', cast({K} % 37 as int)), '，Mary Smith', CASE WHEN {K} % 2 = 0 THEN '@' ELSE '在' END, 'Acme')"
_NAMES = Names(ModelNames(pattern_model({"PER": "王小明", "DATE": "字{3}"}), window=200, overlap=40), english_names(pattern_model({"PERSON": "Mary Smith", "ORG": "Acme", "MONEY": "S"})))


def model_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of two models, through windows and islands of English; a name before @ and labels without a type go."""
    rows = DeidEngine(entities=["PERSON", "ORG", "LOCATION"], ner=_NAMES).detect(_made(spark, d, _NAMED))
    return span_rows(rows, "doc_id").select("doc_id", "entity_type", "start", "end", "score", "value")


def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    """Spans of at least 0.86 without regard to words around: of the usual four kinds, ids and mobiles stay, e-mail does not."""
    rows = DeidEngine(threshold=0.86, soft=None).detect(_made(spark, d, _MIX))
    return span_rows(rows, "doc_id").select("doc_id", "entity_type", "start", "score")


# many values in one text, of which half are equal, with digits of full width and a card that is also an account number
_MANY = f"concat('帳號4111111111111111，', array_join(transform(sequence(1, cast(20 + {K} % 30 as int)), i -> concat('u', cast(i % 10 as string), '@x.org 手機09１２３４５６７', cast(i % 3 as string))), '；'))"


def many_values(spark: SparkSession, d: str) -> DataFrame:
    """Texts with 40 to 100 matches of overlapping rules."""
    rows = DeidEngine().anonymize(_made(spark, d, _MANY))
    return rows.select("doc_id", "anonymized", F.size("resolved").cast("long").alias("n_spans"), "roundtrip_ok")


def allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Values that a table allows stay: here the mobile numbers of every third customer."""
    texts = _made(spark, d, _MIX)
    values = spark.read.parquet(f"{d}/customer.parquet").filter(f"{K} % 3 = 0").select(F.expr(f"concat('09', {_P8}) AS value"))
    engine = DeidEngine(allow=["0911222333"])
    rows = allowed(_kept(spark, engine.detect(texts)), values, "doc_id")
    return span_rows(rows, "doc_id").select("doc_id", "entity_type", "start", "value")


def _redacted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    done = _kept(spark, DeidEngine().anonymize(_made(spark, d, _MIX)).select("doc_id", "anonymized", "entries"))
    return done.select("doc_id", "anonymized"), mapping_rows(done, "doc_id")


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    """Markers to unmask: of every second customer one mobile, of every fifth one that is not there."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col(K).alias("doc_id"))
    return rows.filter("doc_id % 2 = 0").withColumn("placeholder", F.lit("<TW_MOBILE_1>")).union(rows.filter("doc_id % 5 = 0").withColumn("placeholder", F.lit("<PERSON_7>")))


def partial_unmask(spark: SparkSession, d: str) -> DataFrame:
    """Only the chosen markers come back; the others keep their numbers."""
    texts, mapping = _redacted(spark, d)
    return unmask(texts, mapping, _chosen(spark, d), "doc_id").select("doc_id", "unmasked")


def unmask_audit(spark: SparkSession, d: str) -> DataFrame:
    """What was asked for, and what came of it."""
    texts, mapping = _redacted(spark, d)
    return audit(texts, mapping, _chosen(spark, d), "doc_id")


def session_store(spark: SparkSession, d: str) -> DataFrame:
    """Mappings of all customers in two appends, every fifth session purged, then counted as of each version."""
    store = MappingStore(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    texts = _made(spark, d, "concat('手機09', p, '，手機0911222333')").withColumn("session_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    rows = mapping_rows(DeidEngine(entities=["TW_MOBILE"]).anonymize(texts), "session_id", "doc_id")
    for part in (0, 1):
        store.append(rows.filter(f"doc_id % 2 = {part}"))
    store.purge(texts.filter("doc_id % 5 = 0").select("session_id"))
    count = lambda v: store.snapshot(v).agg(F.lit(v).alias("version"), F.countDistinct("session_id").alias("sessions"), F.count("*").alias("markers"))
    return count(1).union(count(2)).union(count(3))


def gold_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Gold values by their number in the text, against what is found there."""
    texts = _made(spark, d, _MIX)
    gold = texts.select("doc_id", F.lit("TW_NATIONAL_ID").alias("entity_type"), F.regexp_extract("text", "A1[0-9]{8}", 0).alias("value"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("nth"))
    return align(gold, texts).select("doc_id", "entity_type", "value", "nth", "start", "end")


def gate_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Which types reach their least precision and recall, against gold without the ids of every fourth customer."""
    texts = _made(spark, d, _MIX)
    found = span_rows(DeidEngine(entities=["TW_NATIONAL_ID", "EMAIL_ADDRESS"]).detect(texts), "doc_id")
    gold = texts.filter("doc_id % 4 > 0").select("doc_id", F.lit("TW_NATIONAL_ID").alias("entity_type"), F.regexp_extract("text", "A1[0-9]{8}", 0).alias("value"), F.explode(F.array(F.lit(1), F.lit(2))).alias("nth"))
    gold = align(gold.union(texts.select("doc_id", F.lit("EMAIL_ADDRESS"), F.regexp_extract("text", "u[0-9]+@example.com", 0), F.lit(1))), texts)
    return gate(metrics(found, gold), by_type={"EMAIL_ADDRESS": (1.0, 1.0), "PERSON": (0.5, 0.5)}, strict=False).select("entity_type", "tp", "fp", "fn", "passed")


def conversation_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    found = DeidEngine(entities=["EMAIL_ADDRESS"]).detect(rows)
    return found.groupBy().agg(F.count("*").alias("turns"), F.sum(F.size("spans").cast("long")).alias("found"))


def page_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("html").alias("text"))
    found = DeidEngine(entities=["EMAIL_ADDRESS"]).detect(rows)
    return found.groupBy().agg(F.count("*").alias("pages"), F.sum(F.size("spans").cast("long")).alias("found"))


_K = f"WITH k AS (SELECT {K}, {_P8} AS p FROM customer)"
_MAIL = "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}"
_FOUND = f"""{_K}, f AS (SELECT {K} AS doc_id, unnest(['TW_NATIONAL_ID', 'TW_NATIONAL_ID', 'TW_MOBILE', 'TW_MOBILE', 'EMAIL_ADDRESS']) AS entity_type,
  unnest(['A1' || p, 'A1' || p, '09' || p, '0911222333', 'u' || {K} || '@example.com']) AS value FROM k)"""
detection: dict[str, Query] = {name: _case(name)[0] for name in CASES}
QUERIES: dict[str, Query] = detection | {
    f.__name__: f
    for f in (
        scan_documents, detect_email, detect_credit_card_luhn, anonymize_mix, number_forward, mapping_table, anonymize_documents, restore_roundtrip, merge_adjacent, person_over_date_antijoin,
        resolve_conflicts, cell_replace, counts_by_type, counts_rollup, distinct_values, metrics_prf, known_value_sweep, mask_manual_terms, pre_read_decision, soft_context_threshold, soft_context_scores, model_names, threshold_scan, many_values, allow_list, partial_unmask, unmask_audit, session_store, gold_alignment, gate_by_type,
        conversation_scan, page_scan,
    )
}
ORACLES: dict[str, str] = {name: _case(name)[1] for name in CASES} | {
    "scan_documents": "SELECT doc_id, length(text)::BIGINT AS chars FROM documents",
    "detect_email": f"""WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_MAIL}')) AS value FROM documents)
SELECT doc_id, value, count(*)::BIGINT AS n, (min(strpos(text, value)) - 1)::INTEGER AS first FROM m GROUP BY doc_id, value""",
    "detect_credit_card_luhn": f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM documents),
c AS (SELECT doc_id, v FROM m WHERE regexp_full_match(v, '(4[0-9]{{3}}|5[0-5][0-9]{{2}}|6[0-9]{{3}}|1[0-9]{{3}}|3[0-9]{{3}})[0-9]{{3,4}}[0-9]{{3,4}}[0-9]{{3,5}}') AND NOT regexp_full_match(v, '1[0-9]{{12}}')),
s AS (SELECT doc_id, v, list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (CASE WHEN 2 * substr(v, length(v) + 1 - i, 1)::INT > 9 THEN 2 * substr(v, length(v) + 1 - i, 1)::INT - 9 ELSE 2 * substr(v, length(v) + 1 - i, 1)::INT END) ELSE substr(v, length(v) + 1 - i, 1)::INT END)) AS luhn FROM c)
SELECT doc_id, v AS value, count(*)::BIGINT AS n FROM s WHERE luhn % 10 = 0 GROUP BY doc_id, v""",
    "anonymize_mix": f"""{_K} SELECT {K} AS doc_id, CASE WHEN p = '11222333' THEN '身分證<TW_NATIONAL_ID_1>，手機<TW_MOBILE_1>，再次<TW_NATIONAL_ID_1>，信箱<EMAIL_ADDRESS_1>，手機<TW_MOBILE_1>'
  ELSE '身分證<TW_NATIONAL_ID_1>，手機<TW_MOBILE_2>，再次<TW_NATIONAL_ID_1>，信箱<EMAIL_ADDRESS_1>，手機<TW_MOBILE_1>' END AS anonymized, CASE WHEN p = '11222333' THEN 3 ELSE 4 END::BIGINT AS entity_count, true AS roundtrip_ok FROM k""",
    "number_forward": f"""{_K}, m AS (SELECT {K} AS doc_id, unnest(['TW_NATIONAL_ID', 'TW_MOBILE', 'EMAIL_ADDRESS', 'TW_MOBILE']) AS entity_type, unnest([1, 1, 1, 2]) AS ordinal, unnest(['A1' || p, '09' || p, 'u' || {K} || '@example.com', '0911222333']) AS original FROM k)
SELECT doc_id, '<' || entity_type || '_' || ordinal || '>' AS placeholder, entity_type, ordinal::BIGINT AS ordinal, original FROM m""",
    "mapping_table": f"""{_K} SELECT {K} AS doc_id, unnest(['<TW_NATIONAL_ID_1>', '<TW_MOBILE_2>', '<EMAIL_ADDRESS_1>', '<TW_MOBILE_1>']) AS placeholder, unnest(['A1' || p, '09' || p, 'u' || {K} || '@example.com', '0911222333']) AS original FROM k""",
    "anonymize_documents": "SELECT count(*)::BIGINT AS documents, count(text)::BIGINT AS restored FROM documents",
    "restore_roundtrip": "SELECT doc_id, text AS restored FROM documents",
    "merge_adjacent": f"""SELECT {K} AS doc_id, 'A' AS entity_type, 2 AS start, 4 AS "end" FROM customer UNION ALL SELECT {K}, 'B', 0, CASE WHEN {K} % 3 = 0 THEN 9 ELSE 5 END FROM customer
UNION ALL SELECT {K}, 'B', (5 + {K} % 3)::INTEGER, 9 FROM customer WHERE {K} % 3 > 0""",
    "person_over_date_antijoin": f"""SELECT {K} AS doc_id, 'TW_BIRTH_DATE' AS entity_type,  CASE WHEN {K} % 2 = 0 THEN 4 ELSE 0 END AS start, CASE WHEN {K} % 2 = 0 THEN 13 ELSE 9 END AS "end" FROM customer
UNION ALL SELECT {K}, 'PERSON', 0, 3 FROM customer WHERE {K} % 2 = 0""",
    "resolve_conflicts": f"""SELECT {K} AS doc_id, 'A' AS entity_type, 0 AS start, 10 AS "end" FROM customer UNION ALL SELECT {K}, 'B', greatest(10, 4 + {K} % 10)::INTEGER, 14 FROM customer""",
    "cell_replace": f"""SELECT {K} AS doc_id, 'Sheet1!A1' AS key, '手機' AS text, 0::BIGINT AS leaks FROM customer UNION ALL SELECT {K}, 'Sheet1!A2', '<TW_MOBILE_1>', 0 FROM customer UNION ALL SELECT {K}, 'Sheet1!A3', '姓名', 0 FROM customer""",
    "counts_by_type": f"""{_FOUND} SELECT entity_type, CASE entity_type WHEN 'TW_NATIONAL_ID' THEN '身分證字號' WHEN 'TW_MOBILE' THEN '手機號碼' ELSE 'Email' END AS name, count(*)::BIGINT AS found FROM f GROUP BY entity_type""",
    "counts_rollup": f"{_FOUND} SELECT coalesce(entity_type, '__total__') AS entity_type, count(*)::BIGINT AS found FROM f GROUP BY ROLLUP (entity_type)",
    "distinct_values": f"{_FOUND} SELECT entity_type, count(DISTINCT value)::BIGINT AS n_values FROM f GROUP BY entity_type",
    "metrics_prf": f"""WITH c AS (SELECT sum(CASE WHEN {K} % 3 < 2 AND {K} % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN {K} % 3 < 2 AND {K} % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN {K} % 3 = 2 AND {K} % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS fn FROM customer),
m AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall FROM c)
SELECT unnest(['TW_NATIONAL_ID', '__total__']) AS entity_type, tp, fp, fn, precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM m""",
    "known_value_sweep": f"SELECT {K} AS doc_id, '統編<TW_BUSINESS_ID_1>' || repeat('Z', 60) || '<TW_BUSINESS_ID_1>' || {K} AS anonymized FROM customer",
    "mask_manual_terms": f"{_K} SELECT {K} AS doc_id, '<MANUAL_1>與<MANUAL_1>明' || p AS masked FROM k",
    "pre_read_decision": f"""SELECT {K} AS doc_id, '{{"hookSpecificOutput":{{"hookEventName":"PreToolUse","permissionDecision":"ask","permissionDecisionReason":"f' || {K} || ' holds 1 items of personal data (手機號碼: 1)"}}}}' AS response FROM customer WHERE {K} % 2 = 0""",
    "soft_context_threshold": f"""{_K} SELECT {K} AS doc_id, (CASE {K} % 3 WHEN 1 THEN 3 ELSE 2 END + {K} % 20)::INTEGER AS start, (CASE {K} % 3 WHEN 1 THEN 3 ELSE 2 END + {K} % 20 + 9)::INTEGER AS "end", 0.95::DOUBLE AS score, 'B' || p AS value
FROM k WHERE {K} % 3 < 2 AND CASE {K} % 3 WHEN 1 THEN 3 ELSE 2 END + {K} % 20 <= 10""",
    "soft_context_scores": f"""SELECT {K} AS doc_id, (CASE {K} % 3 WHEN 1 THEN 3 ELSE 2 END + {K} % 20)::INTEGER AS start,
  CASE WHEN {K} % 3 < 2 AND CASE {K} % 3 WHEN 1 THEN 3 ELSE 2 END + {K} % 20 <= 10 THEN 0.95 ELSE 0.6 END::DOUBLE AS score FROM customer""",
    "model_names": f"""WITH n AS (SELECT {K}, {K} % 700 + 3 + {K} % 37 + 1 AS e FROM customer)
SELECT {K} AS doc_id, 'PERSON' AS entity_type, ({K} % 700)::INTEGER AS start, ({K} % 700 + 3)::INTEGER AS "end", 0.85::DOUBLE AS score, '王小明' AS value FROM n
UNION ALL SELECT {K}, 'PERSON', e::INTEGER, (e + 10)::INTEGER, 0.8, 'Mary Smith' FROM n WHERE {K} % 2 = 1 UNION ALL SELECT {K}, 'ORG', (e + 11)::INTEGER, (e + 15)::INTEGER, 0.8, 'Acme' FROM n""",
    "threshold_scan": f"""{_K} SELECT {K} AS doc_id, 'TW_NATIONAL_ID' AS entity_type, unnest([3, 29])::INTEGER AS start, 0.9::DOUBLE AS score FROM k
UNION ALL SELECT {K}, 'TW_MOBILE', unnest([16, 57 + length({K}::VARCHAR) + 1])::INTEGER, 0.9 FROM k""",
    "many_values": f"""{_K}, n AS (SELECT {K} AS doc_id, 20 + {K} % 30 AS n FROM k), i AS (SELECT doc_id, n, unnest(generate_series(1, n)) AS i FROM n),
e AS (SELECT doc_id, i % 10 AS v, max(i) AS last FROM i GROUP BY doc_id, i % 10), en AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY last DESC) AS num FROM e),
m AS (SELECT doc_id, i % 3 AS v, max(i) AS last FROM i GROUP BY doc_id, i % 3), mn AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY last DESC) AS num FROM m)
SELECT i.doc_id, '帳號<CREDIT_CARD_1>，' || string_agg('<EMAIL_ADDRESS_' || en.num || '> 手機<TW_MOBILE_' || mn.num || '>', '；' ORDER BY i) AS anonymized, (1 + 2 * max(n))::BIGINT AS n_spans, true AS roundtrip_ok
FROM i JOIN en ON i.doc_id = en.doc_id AND i.i % 10 = en.v JOIN mn ON i.doc_id = mn.doc_id AND i.i % 3 = mn.v GROUP BY i.doc_id""",
    "allow_list": f"""{_K} SELECT {K} AS doc_id, 'TW_NATIONAL_ID' AS entity_type, unnest([3, 29])::INTEGER AS start, 'A1' || p AS value FROM k UNION ALL SELECT {K}, 'EMAIL_ADDRESS', 42, 'u' || {K} || '@example.com' FROM k
UNION ALL SELECT {K}, 'TW_MOBILE', 16, '09' || p FROM k WHERE {K} % 3 > 0""",
    "partial_unmask": f"""{_K} SELECT {K} AS doc_id, '身分證<TW_NATIONAL_ID_1>，手機<TW_MOBILE_2>，再次<TW_NATIONAL_ID_1>，信箱<EMAIL_ADDRESS_1>，手機' || CASE WHEN {K} % 2 = 0 THEN '0911222333' ELSE '<TW_MOBILE_1>' END AS unmasked FROM k""",
    "unmask_audit": f"""SELECT {K} AS doc_id, '<TW_MOBILE_1>' AS placeholder, 'TW_MOBILE' AS entity_type, 1::BIGINT AS occurrences, 'unmasked' AS outcome FROM customer WHERE {K} % 2 = 0
UNION ALL SELECT {K}, '<PERSON_7>', NULL, 0, 'unknown' FROM customer WHERE {K} % 5 = 0""",
    "session_store": f"""SELECT v::INTEGER AS version, count(*)::BIGINT AS sessions, (2 * count(*))::BIGINT AS markers FROM customer, (VALUES (1), (2), (3)) t(v)
WHERE (v > 1 OR {K} % 2 = 0) AND (v < 3 OR {K} % 5 > 0) GROUP BY v""",
    "gold_alignment": f"""{_K} SELECT {K} AS doc_id, 'TW_NATIONAL_ID' AS entity_type, 'A1' || p AS value, unnest([1, 2, 3])::INTEGER AS nth, unnest([3, 29, NULL])::INTEGER AS start, unnest([13, 39, NULL])::INTEGER AS "end" FROM k""",
    "gate_by_type": f"""WITH c AS (SELECT count(*)::BIGINT AS n, sum(CASE WHEN {K} % 4 > 0 THEN 2 ELSE 0 END)::BIGINT AS ids FROM customer)
SELECT 'TW_NATIONAL_ID' AS entity_type, ids AS tp, 2 * n - ids AS fp, 0::BIGINT AS fn, ids >= 0.9 * 2 * n AS passed FROM c UNION ALL SELECT 'EMAIL_ADDRESS', n, 0, 0, true FROM c
UNION ALL SELECT '__total__', n + ids, 2 * n - ids, 0, n + ids >= 0.9 * 3 * n FROM c UNION ALL SELECT 'PERSON', NULL, NULL, NULL, false""",
    "conversation_scan": f"SELECT count(*)::BIGINT AS turns, sum(len(regexp_extract_all(text, '{_MAIL}')))::BIGINT AS found FROM conversations",
    "page_scan": f"SELECT count(*)::BIGINT AS pages, sum(len(regexp_extract_all(html, '{_MAIL}')))::BIGINT AS found FROM pages",
}
