"""Files in and out. A file is a row: source_path, file_type, text and its cells (key, text).

Plain files, workbooks (xlsx) and word-processor documents (docx) are read and written with the standard library; PDF
text needs pdfplumber and is refused on the driver, before any job, where that is missing. Files are read by Spark's
``binaryFile`` source, so paths can be in any file system that Spark reads.
"""

from __future__ import annotations

import importlib.util
import io
import json
import re
import zipfile
from collections.abc import Iterable
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import each, let
from ..operators.span_algebra import replace_values

# The file types that are handled.
PLAIN = (".txt", ".csv", ".tsv", ".log", ".md", ".dat", ".json", ".xml", ".html", ".htm", ".yaml", ".yml")
EXCEL, WORD, PDF = (".xlsx",), (".docx",), (".pdf",)
SUPPORTED = (*PLAIN, *EXCEL, *WORD, *PDF)
CONTENT = "source_path string, file_type string, text string, cells array<struct<key:string,text:string>>"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: str) -> str:
    """Lower-cased suffix with its dot."""
    return (re.search(r"\.[^./]+$", path) or [""])[0].lower()


def is_supported(path: str) -> bool:
    """Whether a file of this name can be read."""
    return suffix(path) in SUPPORTED


def output_name(path: str, mark: str = "anon") -> str:
    """``stem.anon.ext``; PDF becomes text."""
    end = path[len(path) - len(suffix(path)) :]
    return f"{path[: len(path) - len(end)]}.{mark}{'.txt' if end.lower() == '.pdf' else end}"


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet of a workbook."""
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
        target = rels[s.get(f"{_R}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


#: Number formats that every workbook has for dates and times, and for spans of time.
_DATES, _SPANS = {*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)}, {46}


def _formats(z: zipfile.ZipFile) -> list[str]:
    """What the numbers of each cell style are: ``date``, ``span`` of time, or nothing special."""
    if "xl/styles.xml" not in z.namelist():
        return []
    tree = ET.fromstring(z.read("xl/styles.xml"))
    own = {}
    for f in tree.iter(f"{_X}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|_.|\*.', "", f.get("formatCode") or "").split(";")[0].lower()
        kind = "span" if re.search(r"\[(h+|m+|s+)\]", code) else "date" if re.search("[dmyhs]", re.sub(r"\[[^\]]*\]|general", "", code)) else ""
        own[int(f.get("numFmtId"))] = kind
    ids = [int(x.get("numFmtId") or 0) for xfs in tree.findall(f"{_X}cellXfs") for x in xfs]
    return [own[i] if i in own else "date" if i in _DATES else "span" if i in _SPANS else "" for i in ids]


def _number(text: str, kind: str, from_1904: bool) -> str:
    """A number as a cell shows it: a date and time, a span, an integer or a decimal."""
    x = float(text)
    if kind == "span":
        return str(timedelta(days=x))
    if kind == "date" and 0 <= x < 2958466:  # the year 10000
        if x < 1 and not from_1904:
            return str((datetime.min + timedelta(seconds=round(x * 86400, 3))).time())
        # the 1900 system counts a 29 February 1900 that never was
        start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if x >= 60 else datetime(1899, 12, 31)
        return str(start + timedelta(days=int(x), seconds=round((x - int(x)) * 86400, 3)))
    return text if re.fullmatch(r"-?\d+", text) else str(int(x)) if x.is_integer() and "e" in text.lower() and abs(x) < 1e15 else str(x)


def _cell_text(c: ET.Element, shared: list[str], formats: list[str], from_1904: bool) -> str | None:
    kind, v = c.get("t"), c.find(f"{_X}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_X}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text == "1")
    style = int(c.get("s") or 0)
    if kind in (None, "n"):
        return _number(v.text, formats[style] if style < len(formats) else "", from_1904)
    return v.text


def _elements(z: zipfile.ZipFile, part: str, tag: str) -> Iterable[ET.Element]:
    """All elements of a tag, as the part streams by."""
    with z.open(part) as f:
        held: list[ET.Element] = []
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                held.append(e)
                continue
            held.pop()
            if e.tag == f"{_X}{tag}":
                yield e
                e.clear()
            elif e.tag == f"{_X}row":
                e.clear()
                if held:
                    held[-1].remove(e)


def read_xlsx(raw: bytes) -> list[tuple[str, str]]:
    """(``Sheet!A1``, text) of all filled cells, sheet by sheet and row by row; numbers in date formats are dates."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in _elements(z, "xl/sharedStrings.xml", "si")]
        formats = _formats(z)
        book = ET.fromstring(z.read("xl/workbook.xml")).find(f"{_X}workbookPr")
        from_1904 = book is not None and book.get("date1904") in ("1", "true")
        return [(f"{name}!{c.get('r')}", text) for name, part in _sheets(z) for c in _elements(z, part, "c") if (text := _cell_text(c, shared, formats, from_1904)) is not None]


def write_xlsx(raw: bytes, cells: dict[str, str]) -> bytes:
    """The workbook with the given cells as text."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        parts = {part: name for name, part in _sheets(z)}
        ET.register_namespace("", _X[1:-1])
        for item in z.namelist():
            data = z.read(item)
            if item in parts:
                tree = ET.fromstring(data)
                for c in tree.iter(f"{_X}c"):
                    text = cells.get(f"{parts[item]}!{c.get('r')}")
                    if text is not None:
                        for x in list(c):
                            c.remove(x)
                        c.set("t", "inlineStr")
                        ET.SubElement(ET.SubElement(c, f"{_X}is"), f"{_X}t").text = text
                data = ET.tostring(tree, encoding="utf-8", xml_declaration=True)
            to.writestr(item, data)
    return out.getvalue()


def _paragraph(p: ET.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "" for x in p.iter())


def _places(body: ET.Element) -> Iterable[tuple[str, list[ET.Element]]]:
    """(key, paragraphs): body paragraphs first, then table cells."""
    for i, p in enumerate(body.findall(f"{_W}p")):
        yield f"para:{i}", [p]
    for t, tbl in enumerate(body.findall(f"{_W}tbl")):
        for r, row in enumerate(tbl.findall(f"{_W}tr")):
            for c, cell in enumerate(row.findall(f"{_W}tc")):
                yield f"table:{t}:r{r}:c{c}", cell.findall(f"{_W}p")


def read_docx(raw: bytes) -> list[tuple[str, str]]:
    """(key, text) of paragraphs and table cells that are not blank."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return [(key, text) for key, ps in _places(body) if (text := "\n".join(map(_paragraph, ps))).strip()]


def write_docx(raw: bytes, cells: dict[str, str]) -> bytes:
    """The document with new texts: all in a place's first run; other runs and paragraphs of it become empty."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.namelist():
            data = z.read(item)
            if item == "word/document.xml":
                tree = ET.fromstring(data)
                for key, ps in _places(tree.find(f"{_W}body")):
                    if key in cells and ps:
                        texts = [t for p in ps for t in p.iter(f"{_W}t")]
                        if not texts:
                            texts = [ET.SubElement(ET.SubElement(ps[0], f"{_W}r"), f"{_W}t")]
                        for t in texts:
                            t.text = ""
                        for p in ps:
                            for r in p.iter(f"{_W}r"):
                                for x in [x for x in r if x.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr")]:
                                    r.remove(x)
                        texts[0].text = cells[key]
                        texts[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                data = ET.tostring(tree, encoding="utf-8", xml_declaration=True)
            to.writestr(item, data)
    return out.getvalue()


def _read_pdf(raw: bytes) -> str:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        return "\n".join(t for page in pdf.pages if (t := page.extract_text()))


def read_files(spark: SparkSession, paths: str | list[str], content: bool = False) -> DataFrame:
    """One row for each file (CONTENT). Unknown types raise ValueError, missing files what Spark raises.

    ``content`` adds the raw bytes of workbooks and documents, which writing them back needs.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if suffix(p) and not any(x in p for x in "*?[{") and not is_supported(p):
            raise ValueError(f"unsupported file type {suffix(p)!r}; supported: {', '.join(sorted(SUPPORTED))}")
        if suffix(p) in PDF and importlib.util.find_spec("pdfplumber") is None:
            raise ImportError("reading PDF needs pdfplumber")
    return read_content(spark.read.format("binaryFile").load(paths), content)


def read_content(files: DataFrame, content: bool = False) -> DataFrame:
    """The same for rows (path, content), as Spark's ``binaryFile`` gives them."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                end, kept = suffix(path), None
                if end in EXCEL or end in WORD:
                    cells, kept = (read_xlsx if end in EXCEL else read_docx)(raw), raw if content else None
                    rows.append((path, "excel" if end in EXCEL else "docx", "\n".join(t for _, t in cells), [{"key": k, "text": t} for k, t in cells], kept))
                elif end in PDF:
                    rows.append((path, "pdf", _read_pdf(raw), [], None))
                elif end in PLAIN:
                    rows.append((path, "plain", raw.decode("utf-8"), [], None))
            yield pd.DataFrame(rows, columns=["source_path", "file_type", "text", "cells", "content"])[names]

    names = ["source_path", "file_type", "text", "cells", *(["content"] if content else [])]
    return files.select("path", "content").mapInPandas(run, CONTENT + (", content binary" if content else ""))


#: Suffixes of code, settings and binary files that are never looked at.
SKIPPED = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".toml", ".md", ".sh", ".css", ".html", ".xml", ".sql", ".go", ".rs", ".java", ".rb", ".swift", ".kt", ".c", ".h", ".cpp", ".hpp",
    ".lock", ".gitignore", ".env", ".ini", ".cfg", ".conf", ".ipynb", ".whl", ".tar", ".gz", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".mp3", ".mp4", ".wav", ".avi",
)
SIZE_CAP = 64 * 1024


def admission(files: DataFrame, under: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), skipped: tuple[str, ...] = SKIPPED, size_cap: int | None = SIZE_CAP, passed: DataFrame | None = None) -> DataFrame:
    """Add ``reason``: why a file (path, length) is not looked at, or null if it is.

    ``skipped`` suffixes come first, then files not ``under`` one of the paths (if any), other ``suffixes`` (if any), files
    over ``size_cap`` bytes, and those in ``passed`` (path), a table of files let through unseen, by a join on the path.
    Of Spark's ``binaryFile`` only path and length are asked for, so no file is opened. All conditions but the last are
    native, so ``admission(...).filter("reason IS NULL")`` prunes before any content is read.
    """
    # a path's scheme does not count
    plain = F.regexp_replace("path", "^[a-z][a-z0-9+]*:(?://[^/]*)?(?=/)", "")
    end = F.lower(F.regexp_extract(plain, r"\.[^./]+$", 0))
    below = F.lit(False)
    for p in under:
        below = below | plain.startswith(p)
    reason = F.when(end.isin(*skipped), "skipped suffix") if skipped else F.when(F.lit(False), "")
    if under:
        reason = reason.when(~below, "outside the paths")
    reason = reason.when(~end.isin(*suffixes), "other suffix") if suffixes else reason.when(~end.isin(*SUPPORTED), "unsupported suffix")
    if size_cap is not None:
        reason = reason.when(F.col("length") > size_cap, "too large")
    if passed is None:
        return files.withColumn("reason", reason)
    known = passed.select("path").distinct().withColumn("_passed", F.lit(True))
    return files.join(known, "path", "left").withColumn("reason", reason.when(F.col("_passed"), "let through")).drop("_passed")


def admitted(spark: SparkSession, paths: str | list[str], content: bool = False, **rules) -> tuple[DataFrame, DataFrame]:
    """(contents of the files that ``admission`` admits, the others as (path, length, reason)).

    The rejected are listed without being opened. The size condition is a filter on ``length``, which ``binaryFile``
    takes into its scan, so files over the cap are not opened either.
    """
    found = spark.read.format("binaryFile").load(paths)
    cap = rules.get("size_cap", SIZE_CAP)
    open_ = found if cap is None else found.filter(F.col("length") <= cap)
    rejected = admission(found.select("path", "length"), **rules).filter("reason IS NOT NULL")
    return read_content(admission(open_, **rules).filter("reason IS NULL"), content), rejected.select("path", "length", "reason")


def _cells(column: str, old: str, new: str) -> Column:
    """Cells with one side of the dictionary replaced by the other."""
    pairs = each("entries", lambda e: f"named_struct('from', {e}.{old}, 'to', {e}.{new})")
    return F.expr(let(pairs, lambda p: each(column, lambda c: f"named_struct('key', {c}.key, 'text', {replace_values(f'{c}.text', p)})")))


def anonymize_cells(df: DataFrame) -> DataFrame:
    """Add ``new_cells`` (each value of ``entries`` replaced wherever it stands) and ``leaks``: values still in a cell."""
    df = df.withColumn("new_cells", _cells("cells", "original", "placeholder"))
    left = F.filter("entries", lambda d: ~F.exists("cells", lambda c: F.contains(c["text"], d["original"])))
    return df.withColumn("leaks", F.when(F.size("cells") > 0, F.transform(left, lambda d: d["original"])).otherwise(F.array().cast("array<string>")))


def restore_cells(df: DataFrame) -> DataFrame:
    """The inverse, on ``new_cells``."""
    return df.withColumn("cells", _cells("new_cells", "placeholder", "original"))


def write_binary(original: bytes, file_type: str, cells: dict[str, str]) -> bytes:
    """A workbook or document with new cell texts."""
    if file_type not in ("excel", "docx"):
        raise ValueError(f"cannot write cells of {file_type}")
    return (write_xlsx if file_type == "excel" else write_docx)(original, cells)


def mapping_json(df: DataFrame) -> DataFrame:
    """Add ``mapping``: the dictionary as a JSON object."""
    pairs = F.transform("entries", lambda d: F.struct(d["placeholder"].alias("k"), d["original"].alias("v")))
    return df.withColumn("mapping", F.to_json(F.map_from_entries(pairs)))


def save_mapping(mapping: dict[str, str], path: str) -> None:
    """One mapping as a JSON file, readable text."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(mapping, f, ensure_ascii=False, indent=2)


def load_mapping(path: str) -> dict[str, str]:
    """A mapping file's object."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, placeholder, original) of mapping files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.from_json("value", "map<string,string>").alias("m"))
    return raw.select("source_path", F.explode("m").alias("placeholder", "original"))
