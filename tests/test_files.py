"""File formats, command line and streams."""

import io
import json
import zipfile

import pytest

from veilspark.cli import main
from veilspark.operators.engine import DeidEngine
from veilspark.sources import files
from veilspark.streaming.streams import anonymize_stream, write_stream

_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def workbook(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        shared = [v for row in rows for v in row]
        z.writestr("xl/sharedStrings.xml", f"<sst {_S}>" + "".join(f"<si><t>{v}</t></si>" for v in shared) + "</sst>")
        body = "".join("<row>" + "".join(f'<c r="{"AB"[j]}{i + 1}" t="s"><v>{i * 2 + j}</v></c>' for j in range(2)) + "</row>" for i in range(len(rows)))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_S}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def document():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("姓名：張三") + p("") + p("身分證A123456789") + f"<w:tbl><w:tr><w:tc>{p('手機')}{p('0912345678')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_workbook_round_trip(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([("張三", "A123456789"), ("李四", "B234567890")]))
    df = files.read_files(spark, str(tmp_path / "a.xlsx"))
    row = files.anonymize_cells(DeidEngine().anonymize(df)).first()
    assert [c["key"] for c in row["cells"]] == ["Sheet1!A1", "Sheet1!B1", "Sheet1!A2", "Sheet1!B2"] and row["leaks"] == []
    again = files.write_binary((tmp_path / "a.xlsx").read_bytes(), "excel", {c["key"]: c["text"] for c in row["new_cells"]})
    assert dict(files.read_xlsx(again))["Sheet1!B1"].startswith("<TW_NATIONAL_ID_")
    back = files.restore_cells(files.anonymize_cells(DeidEngine().anonymize(df)).drop("cells")).first()
    assert back["cells"] == row["cells"]


def test_document_round_trip(spark, tmp_path):
    raw = document()
    assert files.read_docx(raw) == [("para:0", "姓名：張三"), ("para:2", "身分證A123456789"), ("table:0:r0:c0", "手機\n0912345678")]
    again = files.write_docx(raw, {"para:2": "x", "table:0:r0:c0": "手機\n<TW_MOBILE_1>"})
    assert b"0912345678" not in zipfile.ZipFile(io.BytesIO(again)).read("word/document.xml")
    assert dict(files.read_docx(again))["para:2"] == "x"


def test_names_and_refusals(spark, tmp_path):
    assert files.output_name("/a/b.c.TXT") == "/a/b.c.anon.TXT" and files.output_name("x.pdf", "restored") == "x.restored.txt"
    assert files.is_supported("A.DOCX") and files.is_supported("a.dat") and not files.is_supported("a.exe") and not files.is_supported("a.xlsm")
    with pytest.raises(ValueError):
        files.read_files(spark, "/nowhere/a.exe")


def test_command_line(spark, tmp_path, capsys):
    text = "身分證A123456789\r\n手機0912345678\n"
    (tmp_path / "a.txt").write_bytes(text.encode())
    assert main([str(tmp_path / "a.txt"), "-m", str(tmp_path / "m.json")]) == 0
    hidden = (tmp_path / "a.anon.txt").read_bytes().decode()
    assert "A123456789" not in hidden and len(json.loads((tmp_path / "m.json").read_text("utf-8"))) == 2
    assert main(["restore", str(tmp_path / "a.anon.txt"), "-m", str(tmp_path / "m.json"), "-o", str(tmp_path / "b.txt")]) == 0
    assert (tmp_path / "b.txt").read_bytes().decode() == text
    capsys.readouterr()
    assert main(["scan", str(tmp_path / "a.txt")]) == 0
    assert json.loads(capsys.readouterr().out)["hookSpecificOutput"]["permissionDecision"] == "ask"
    assert main(["anonymize", str(tmp_path / "a.bin")]) == 1
    assert main(["batch", str(tmp_path), "-o", str(tmp_path / "out")]) == 0
    assert len(list((tmp_path / "out").rglob("a.anon.txt"))) == 1


def test_mappings(spark, tmp_path):
    files.save_mapping({"<A_1>": "值"}, str(tmp_path / "m.json"))
    assert files.load_mapping(str(tmp_path / "m.json")) == {"<A_1>": "值"}
    assert [(r["placeholder"], r["original"]) for r in files.read_mappings(spark, str(tmp_path / "m.json")).collect()] == [("<A_1>", "值")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "手機0912345678"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = write_stream(anonymize_stream(stream, DeidEngine()).select("doc_id", "anonymized"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r["doc_id"]: r["anonymized"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "手機<TW_MOBILE_1>", 2: None}
