"""Windows, islands, labels and places around a model of names."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.operators.engine import DeidEngine, gazetteer, span_rows
from veilspark.operators.names import FOUND, ModelNames, Names, english_names, pattern_model

PEOPLE = pattern_model({"PER": "王小明|中華民國|歐?陽{2,}", "DATE": "今天", "LOC": "台北|北"})


def found(spark, recognizer, texts, kinds=("PERSON", "ORG", "LOCATION")):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = span_rows(DeidEngine(entities=kinds, ner=recognizer).detect(df), "doc_id").collect()
    return sorted((r["doc_id"], r["entity_type"], r["start"], r["end"], r["score"]) for r in rows)


def test_windows_cover_and_own(spark):
    """Whatever the place, a name is found once and whole; names longer than the overlap join from their parts."""
    rng = random.Random(1)
    texts = [None, "", "王小明", "今天", "北"] + ["字" * n + "王小明" + "字" * rng.randrange(90) for n in range(0, 120, 3)] + ["字" * n + "歐" + "陽" * 33 + "字" for n in range(0, 60, 7)]
    got = found(spark, ModelNames(PEOPLE, window=40, overlap=12), texts)
    want = [(i, "PERSON", t.index("王"), t.index("王") + 3, 0.85) for i, t in enumerate(texts) if t and "王" in t]
    want += [(i, "PERSON", t.index("歐"), t.index("歐") + 34, 0.85) for i, t in enumerate(texts) if t and "歐" in t]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        ModelNames(PEOPLE, window=10, overlap=10)


def test_padding_and_single_characters(spark):
    texts = ["在：中　華　民　國的𠮷台北", "王小明　王小明", "中　華　民　國", "　北　", "王小明　王　小　明"]
    got = [g[:4] for g in found(spark, ModelNames(PEOPLE), texts)]
    assert got == [(0, "LOCATION", 11, 13), (0, "PERSON", 2, 9), (1, "PERSON", 0, 3), (1, "PERSON", 4, 7), (2, "PERSON", 0, 7), (4, "PERSON", 0, 3), (4, "PERSON", 4, 9)]


def test_english_islands(spark):
    model = pattern_model({"PERSON": r"Mary Smith|mary|J\.", "GPE": "Taipei", "DATE": "May", "ORG": "Acme Corp."})
    texts = ["聯絡人Mary Smith在Taipei，May", "寫信給mary@example.com", "𠮷Acme Corp.。mary", "A1", "王J.x"]
    assert found(spark, english_names(model), texts) == [(0, "LOCATION", 14, 20, 0.8), (0, "PERSON", 3, 13, 0.8), (2, "ORG", 1, 11, 0.8), (2, "PERSON", 12, 16, 0.8), (4, "PERSON", 1, 3, 0.8)]
    both = Names(ModelNames(PEOPLE), english_names(model))
    assert [g[1:4] for g in found(spark, both, ["王小明與Mary Smith"])] == [("PERSON", 0, 3), ("PERSON", 4, 14)]


def test_model_as_pandas_udf(spark):
    """A Python model gets the windows of many texts at once."""

    @F.pandas_udf(FOUND)
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ws: [[{"label": "PER", "start": w.index("張三"), "end": w.index("張三") + 2, "score": 0.7}] if "張三" in w else [] for w in ws])

    recognizer = ModelNames(lambda texts: model(F.expr(texts)), score=None, window=30, overlap=10)
    df = spark.createDataFrame([(1, "字" * 100 + "張三，手機0912345678"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in DeidEngine(ner=recognizer).anonymize(df).collect()}
    assert rows[1]["anonymized"] == "字" * 100 + "<PERSON_1>，手機<TW_MOBILE_1>" and rows[1]["roundtrip_ok"] and rows[2]["anonymized"] is None
    assert gazetteer({}).sql("text").startswith("transform")
