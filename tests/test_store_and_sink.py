"""Session store, partial restoration, distributed file sink, admission of files, corpora and gates."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.test_files import _S, document, workbook
from veilspark.operators.engine import DeidEngine, mapping_rows
from veilspark.operators.evaluate import align, gate, load_corpus, metrics
from veilspark.operators.store import MappingStore, audit, unmask
from veilspark.sources import files, sink


@pytest.fixture(scope="module")
def done(spark):
    rows = [("s1", "手機0912345678，身分證A123456789，手機0911222333"), ("s2", "手機0912345678"), ("s3", "無"), (None, "手機0912345678")]
    return DeidEngine().anonymize(spark.createDataFrame(rows, "session_id string, text string"))


def values(df):
    return sorted((r["session_id"], r["placeholder"], r["original"]) for r in df.filter("session_id IS NOT NULL").collect())


def test_versions_purge_and_vacuum(spark, done, tmp_path):
    store = MappingStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.snapshot().count() == 0
    rows = mapping_rows(done, "session_id")
    assert [store.append(rows.filter("session_id = 's1'")), store.append(rows.filter("session_id = 's2'")), store.purge(["s1", "nobody"])] == [1, 2, 3]
    assert {r[0] for r in values(store.snapshot())} == {"s2"} and {r[0] for r in values(store.snapshot(2))} == {"s1", "s2"} and {r[0] for r in values(store.snapshot(1))} == {"s1"}
    assert store.append(rows.filter("session_id = 's1' AND ordinal = 1")) == 4  # a purged session can come again
    assert len([r for r in values(store.snapshot()) if r[0] == "s1"]) == 2
    before = values(store.snapshot())
    n = store.vacuum()
    assert values(store.snapshot()) == before and len(list((tmp_path / "store/log").glob("*.json"))) == 1 and len(list((tmp_path / "store/data").iterdir())) == 1
    with pytest.raises(ValueError):
        store.snapshot(2)
    assert store.append(rows.filter("session_id = 's2'").limit(0)) == n + 1 and store.purge(["s2"]) == n + 2
    assert {r[0] for r in values(store.snapshot())} == {"s1"}


def test_two_writers_get_two_versions(spark, done, tmp_path, monkeypatch):
    one, other = (MappingStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    monkeypatch.setattr(one, "version", lambda: 0)  # it has not seen the other's write
    rows = mapping_rows(done, "session_id")
    assert other.append(rows) == 1 and one.append(rows.limit(0)) == 2 and other.version() == 2


def test_restore_by_session(spark, done, tmp_path):
    store = MappingStore(spark, f"file://{tmp_path}/store")
    store.append(mapping_rows(done, "session_id"))
    texts = done.select("session_id", "anonymized", "entity_count", "text")
    back = store.restore(texts.filter("session_id IS NOT NULL")).collect()
    assert len(back) == 3 and all(r["restored"] == r["text"] for r in back)
    gone = spark.createDataFrame([("gone", "<TW_MOBILE_1>")], "session_id string, anonymized string")
    with pytest.raises(Exception, match="session gone not found"):
        store.restore(gone).collect()
    assert [r["known"] for r in store.restore(gone, strict=False).collect()] == [False]
    store.purge(["s2"])
    with pytest.raises(Exception, match="session s2 not found"):
        store.restore(texts.filter("session_id = 's2'")).collect()
    assert store.restore(texts.filter("session_id = 's2'"), version=1).first()["restored"] == "手機0912345678"
    assert store.review(spark.createDataFrame([("s1",), ("s1",)], "session_id string")).count() == 3


def test_redact_job(spark, tmp_path):
    store = MappingStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(1, "手機0912345678"), (2, None), (3, "無")], "doc_id long, text string")
    assert store.redact(df, DeidEngine(), f"file://{tmp_path}/out") == 1
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert "text" not in out.columns and "entries" not in out.columns and not any("0912345678" in str(r) for r in out.collect())
    assert {r["doc_id"]: r["restored"] for r in store.restore(out).collect()} == {1: "手機0912345678", 2: None, 3: "無"}
    assert not list((tmp_path / "store/data").glob("*/*0912*")) and len(list((tmp_path / "store/data").iterdir())) == 1


def test_unmask_and_audit(spark, done):
    mapping, texts = mapping_rows(done, "session_id"), done.select("session_id", "anonymized")
    markers = spark.createDataFrame([("s1", "<TW_MOBILE_2>"), ("s1", "<TW_MOBILE_2>"), ("s2", "<PERSON_1>"), ("s3", "<TW_MOBILE_1>")], "session_id string, placeholder string")
    got = {r["session_id"]: r["unmasked"] for r in unmask(texts, mapping, markers).collect()}
    assert got["s1"] == "手機0912345678，身分證<TW_NATIONAL_ID_1>，手機<TW_MOBILE_1>" and got["s2"] == "手機<TW_MOBILE_1>" and got[None] == "手機<TW_MOBILE_1>"
    extra = mapping.union(spark.createDataFrame([("s3", "<TW_MOBILE_1>", "TW_MOBILE", 1, "x")], mapping.schema))
    assert {tuple(r) for r in audit(texts, extra, markers).collect()} == {("s1", "<TW_MOBILE_2>", "TW_MOBILE", 1, "unmasked"), ("s2", "<PERSON_1>", None, 0, "unknown"), ("s3", "<TW_MOBILE_1>", "TW_MOBILE", 0, "absent")}


def test_sink_writes_files_and_mappings(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    (source / "a.txt").write_text("手機0912345678", "utf-8")
    (source / "sub/a.txt").write_text("無", "utf-8")
    (source / "b.xlsx").write_bytes(workbook([("張三", "A123456789")]))
    (source / "c.docx").write_bytes(document())
    df = files.read_files(spark, [str(source), str(source / "sub")], content=True).repartition(3)
    rows = sink.output_files(files.anonymize_cells(DeidEngine().anonymize(df)), root=f"file:{source}")
    out = str(tmp_path / "out")
    job = sink.write_files(rows, out)
    assert not list((tmp_path / "out").glob("*.txt"))  # staged, not there yet
    # a driver dies after some moves: the next one goes on
    staged = [json.loads(x) for m in (tmp_path / "out/_staging" / job).glob("*/manifest.json") for x in m.read_text("utf-8").splitlines()]
    moved = next(x for x in staged if "sub" not in x["path"])
    (tmp_path / "out/_staging" / job / moved["staged"]).rename(tmp_path / "out" / moved["path"])
    assert sink.publish(spark, out, job) == 8 and sink.publish(spark, out, job) == 8
    made = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc") and "_published" not in str(p)}
    assert made == {f"{n}{m}" for n in ("a.anon.txt", "sub/a.anon.txt", "b.anon.xlsx", "c.anon.docx") for m in ("", ".mapping.json")}
    assert (tmp_path / "out/a.anon.txt").read_text("utf-8") == "手機<TW_MOBILE_1>" and json.loads((tmp_path / "out/a.anon.txt.mapping.json").read_text("utf-8")) == {"<TW_MOBILE_1>": "0912345678"}
    assert dict(files.read_xlsx((tmp_path / "out/b.anon.xlsx").read_bytes())) == {"Sheet1!A1": "張三", "Sheet1!B1": "<TW_NATIONAL_ID_1>"}
    assert b"0912345678" not in zipfile.ZipFile(tmp_path / "out/c.anon.docx").read("word/document.xml")


def test_sink_counts_one_attempt_of_a_task(spark, tmp_path):
    writer = sink._Writer(str(tmp_path / "out"), "job")
    row = lambda p, d: {"path": p, "data": d}
    lost, kept, other = writer.write(iter([row("x", b"old")])), writer.write(iter([row("x", b"new"), row("y/z", b"")])), writer.write(iter([]))
    with pytest.raises(ValueError):
        sink.publish(spark, str(tmp_path / "out"), "job")
    writer.commit([kept, other, None])
    assert sink.publish(spark, str(tmp_path / "out"), "job") == 2 and (tmp_path / "out/x").read_bytes() == b"new" and lost.files == 1
    twice = sink._Writer(str(tmp_path / "out"), "twice")
    twice.commit([twice.write(iter([row("a", b"1"), row("./a", b"2")]))])
    with pytest.raises(ValueError, match="one path: a"):
        sink.publish(spark, str(tmp_path / "out"), "twice")
    with pytest.raises(ValueError):
        writer.write(iter([row("../out", b"")]))
    writer.abort([])


def test_admission(spark, tmp_path):
    names = {"a.txt": 10, "big.txt": 70000, "code.py": 5, "c.csv": 5, "d.bin": 5, "e.txt": 5}
    for n, size in names.items():
        (tmp_path / n).write_bytes(b"x" * size)
    passed = spark.createDataFrame([(f"file:{tmp_path}/e.txt",)], "path string")
    good, bad = files.admitted(spark, str(tmp_path), under=(str(tmp_path),), passed=passed)
    assert {r["source_path"].rpartition("/")[2] for r in good.collect()} == {"a.txt", "c.csv"}
    assert {r["path"].rpartition("/")[2]: r["reason"] for r in bad.collect()} == {"big.txt": "too large", "code.py": "skipped suffix", "d.bin": "unsupported suffix", "e.txt": "let through"}
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    other = {r["path"].rpartition("/")[2]: r["reason"] for r in files.admission(listed, under=("/elsewhere",), suffixes=(".csv",)).collect()}
    assert other["a.txt"] == "outside the paths" and other["code.py"] == "skipped suffix"
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,65536)" in plan


def typed_workbook(from_1904=False):
    """A heading and typed cells: dates in built-in and own formats, a time, a span, numbers."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(from_1904)}"/><sheets><sheet name="S" sheetId="1" r:id="r"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Target="worksheets/s.xml"/></Relationships>')
        formats = ['yyyy"年"m"月"d"日"', '"day" 0.00', "[h]:mm", "[Red]0"]
        z.writestr("xl/styles.xml", f"<styleSheet {_S}><numFmts>" + "".join(f"<numFmt numFmtId=\"{164 + i}\" formatCode='{f}'/>" for i, f in enumerate(formats)) + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{i}"/>' for i in (0, 14, 164, 165, 166, 167, 21)) + "</cellXfs></styleSheet>")
        cells = [(0, "生日", "inlineStr"), (1, "32874", None), (2, "32874.5", None), (3, "12.5", None), (4, "1.5", None), (5, "7", None), (6, "0.25", None), (0, "1E3", None), (1, "59", None), (0, "1", "b")]
        body = "".join(f'<c r="{"ABCDEFGHIJ"[i]}1" s="{s}"' + (f' t="{t}"' if t else "") + (f"><is><t>{v}</t></is></c>" if t == "inlineStr" else f"><v>{v}</v></c>") for i, (s, v, t) in enumerate(cells))
        z.writestr("xl/worksheets/s.xml", f"<worksheet {_S}><sheetData><row>{body}</row></sheetData></worksheet>")
    return out.getvalue()


def test_typed_cells(spark, tmp_path):
    got = [t for _, t in files.read_xlsx(typed_workbook())]
    assert got == ["生日", "1990-01-01 00:00:00", "1990-01-01 12:00:00", "12.5", "1 day, 12:00:00", "7", "06:00:00", "1000", "1900-02-28 00:00:00", "True"]
    assert files.read_xlsx(typed_workbook(True))[1][1] == str(datetime.datetime(1904, 1, 1) + datetime.timedelta(days=32874))
    (tmp_path / "a.xlsx").write_bytes(typed_workbook())
    found = DeidEngine(entities=["TW_BIRTH_DATE"]).detect(files.read_files(spark, str(tmp_path / "a.xlsx"))).first()
    assert [found["text"][s["start"] : s["end"]] for s in found["spans"]][0] == "1990-01-01"


def test_corpus_and_gates(spark, tmp_path):
    text = "身分證A123456789，再次A123456789"
    good = [{"id": "1", "text": text, "annotations": [{"entity_type": "TW_NATIONAL_ID", "start": s, "end": s + 10, "text": "A123456789"} for s in (3, 16)]}, {"id": "2", "text": "無", "annotations": []}]
    (tmp_path / "c.json").write_text(json.dumps(good, ensure_ascii=False), "utf-8")
    texts, gold = load_corpus(spark, str(tmp_path / "c.json"))
    rows = metrics(DeidEngine().detect(texts).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.entity_type", "s.start", "s.end"), gold)
    assert texts.count() == 2 and {r["entity_type"]: r["passed"] for r in gate(rows, by_type={"TW_NATIONAL_ID": (1.0, 1.0)}).collect()} == {"TW_NATIONAL_ID": True, "__total__": True}
    with pytest.raises(Exception, match="below the gate: TW_ARC: precision none"):
        gate(rows, by_type={"TW_ARC": (0.5, 0.5)}).collect()
    good[0]["annotations"][0]["start"] = 2
    (tmp_path / "d.json").write_text(json.dumps(good, ensure_ascii=False), "utf-8")
    with pytest.raises(Exception, match="sample 1: expected A123456789"):
        load_corpus(spark, str(tmp_path / "d.json"))[1].collect()
    asked = spark.createDataFrame([("1", "T", "A123456789", n) for n in (0, 1, 2, 3)] + [("1", "T", "", 1), ("9", "T", "A", 1), ("1", "T", "aa", 2)], "doc_id string, entity_type string, value string, nth int")
    got = {(r["doc_id"], r["value"], r["nth"]): (r["start"], r["end"]) for r in align(asked, texts).collect()}
    assert got == {("1", "A123456789", 0): (None, None), ("1", "A123456789", 1): (3, 13), ("1", "A123456789", 2): (16, 26), ("1", "A123456789", 3): (None, None), ("1", "", 1): (None, None), ("9", "A", 1): (None, None), ("1", "aa", 2): (None, None)}


def test_allow_list(spark):
    df = spark.createDataFrame([(1, "手機0912345678與0911222333"), (2, None)], "doc_id long, text string")
    assert DeidEngine(allow=["0911222333"]).anonymize(df).filter("doc_id = 1").first()["anonymized"] == "手機<TW_MOBILE_1>與0911222333"
