"""Command line: ``anonymize FILE``, ``restore FILE -m MAPPING``, ``scan FILE...`` and ``batch FOLDER -o OUT``; FILE alone means anonymize."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.engine import DeidEngine, decision, mapping_of
from .operators.rules import WS
from .operators.span_algebra import restore_once
from .sources import files, sink

COMMANDS = ("anonymize", "anon", "restore", "scan", "batch")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("anonymize", aliases=["anon"])
    a.add_argument("input")
    a.add_argument("-o", "--output")
    a.add_argument("-m", "--mapping", default="mapping.json")
    a.add_argument("--threshold", type=float, default=0.5)
    r = sub.add_parser("restore")
    r.add_argument("input")
    r.add_argument("-m", "--mapping", required=True)
    r.add_argument("-o", "--output")
    s = sub.add_parser("scan")
    s.add_argument("inputs", nargs="+")
    b = sub.add_parser("batch")
    b.add_argument("inputs", nargs="+")
    b.add_argument("-o", "--output", required=True)
    b.add_argument("--threshold", type=float, default=0.5)
    return p


def _out(text: str, path: str | None) -> None:
    if path is None:
        sys.stdout.write(text)
    else:
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)


def anonymize(spark: SparkSession, a: argparse.Namespace) -> int:
    """One file, or standard input for ``-``."""
    engine = DeidEngine(threshold=a.threshold)
    if a.input == "-":
        df = spark.createDataFrame([("-", "plain", sys.stdin.read(), [])], files.CONTENT)
    elif not files.is_supported(a.input):
        print(f"unsupported file type: {a.input}", file=sys.stderr)
        return 1
    else:
        df = files.read_files(spark, a.input)
    row = files.anonymize_cells(engine.anonymize(df)).withColumn("map", mapping_of(F.col("entries"))).first()
    if a.input == "-":
        _out(row["anonymized"], a.output)
    else:
        to = a.output or files.output_name(a.input)
        if row["file_type"] in ("excel", "docx"):
            with open(a.input, "rb") as f, open(to, "wb") as g:
                g.write(files.write_binary(f.read(), row["file_type"], {c["key"]: c["text"] for c in row["new_cells"]}))
        else:
            _out(row["anonymized"], to)
    files.save_mapping(row["map"], a.mapping)
    print(f"{row['entity_count']} values replaced; mapping in {a.mapping}", file=sys.stderr)
    return 0


def restore(spark: SparkSession, a: argparse.Namespace) -> int:
    """Put the values of a mapping back."""
    mapping = files.load_mapping(a.mapping)
    if files.suffix(a.input) in (*files.EXCEL, *files.WORD):
        df = files.read_files(spark, a.input).withColumnRenamed("cells", "new_cells")
        entries = F.array(*[F.struct(F.lit(k).alias("placeholder"), F.lit(v).alias("original")) for k, v in mapping.items()])
        row = files.restore_cells(df.withColumn("entries", entries)).first() if mapping else None
        with open(a.input, "rb") as f:
            raw = f.read()
        cells = {c["key"]: c["text"] for c in row["cells"]} if row else {}
        with open(a.output or files.output_name(a.input, "restored"), "wb") as g:
            g.write(files.write_binary(raw, "excel" if files.suffix(a.input) in files.EXCEL else "docx", cells))
        return 0
    if a.input == "-":
        text = sys.stdin.read()
    else:
        with open(a.input, encoding="utf-8", newline="") as f:
            text = f.read()
    row = spark.createDataFrame([(text, list(mapping.items()))], "text string, pairs array<struct<key:string,value:string>>")
    _out(row.select(F.expr(restore_once("text", "pairs")).alias("t")).first()["t"], a.output)
    return 0


def scan(spark: SparkSession, a: argparse.Namespace) -> int:
    """One JSON line for each file with personal data; nothing for clean ones. Files are not changed."""
    df = decision(DeidEngine().detect(files.read_files(spark, a.inputs)).filter(~F.col("text").rlike(f"^{WS}*$")), "source_path")
    for r in df.filter("response is not null").select("response").toLocalIterator():
        print(r["response"])
    return 0


def batch(spark: SparkSession, a: argparse.Namespace) -> int:
    """All admitted files of folders, each with its mapping beside it, written by the executors; the others with their reasons."""
    good, bad = files.admitted(spark, a.inputs, content=True, skipped=(), size_cap=None)
    rows = sink.output_files(files.anonymize_cells(DeidEngine(threshold=a.threshold).anonymize(good)))
    n = sink.publish(spark, a.output, sink.write_files(rows, a.output))
    print(f"{n // 2} files written to {a.output}", file=sys.stderr)
    for r in bad.toLocalIterator():
        print(f"{r['path']}: {r['reason']}", file=sys.stderr)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not (argv[0].startswith("-") and argv[0] != "-"):
        argv = ["anonymize", *argv]
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("veilspark").getOrCreate()
    return {"anonymize": anonymize, "anon": anonymize, "restore": restore, "scan": scan, "batch": batch}[a.command](spark, a)
