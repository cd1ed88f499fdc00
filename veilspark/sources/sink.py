"""A sink of files, written by the executors: each row (path, data) becomes a file of that name below a folder.

    rows = output_files(anonymized)            # the new files and their mappings
    publish(spark, out, write_files(rows, out))

Writing has two steps, so that a retried or speculated task never shows and a job that dies can go on where it was:

1. Every attempt of a task writes into a folder of its own under ``_staging/<job>`` with a manifest. Once all tasks are
   done, the commit lists the one attempt of each task that counts. Until then nothing stands at its final name.
2. ``publish`` moves the listed files to their names as a Spark job. A move that was made before is left alone, so it can
   be run again after any failure, by any driver that knows the job's name.

Two rows with one path are an error before anything is moved. Paths can be in any file system that pyarrow opens; the
package must be on the executors (``--py-files``). The driver handles one name for each task, never files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import EXCEL, WORD, output_name, suffix, write_binary

FORMAT = "veilspark_files"
MANIFEST = "path string, staged string, size long, sha256 string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _relative(path: str) -> str:
    """The path below the folder; names that would leave it, or clash with the staging folder, are refused."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or parts[0].startswith("_staging"):
        raise ValueError(f"not a path below the folder: {path!r}")
    return "/".join(parts)


@dataclass
class _Attempt(WriterCommitMessage):
    name: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator[Row]) -> _Attempt:
        fs, root = _open(self.root)
        attempt, n = uuid.uuid4().hex, 0
        base = f"{root}/_staging/{self.job}/{attempt}"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/manifest.json") as manifest:
            for n, row in enumerate(iterator, 1):
                data = bytes(row["data"] or b"")
                with fs.open_output_stream(f"{base}/{n}") as f:
                    f.write(data)
                line = {"path": _relative(row["path"]), "staged": f"{attempt}/{n}", "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}
                manifest.write((json.dumps(line, ensure_ascii=False) + "\n").encode())
        return _Attempt(attempt, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.root)
        base = f"{root}/_staging/{self.job}"
        fs.create_dir(base, recursive=True)
        listed = [{"attempt": m.name, "files": m.files} for m in messages if m is not None]
        with fs.open_output_stream(f"{base}/committing") as f:
            f.write(json.dumps(listed).encode())
        fs.move(f"{base}/committing", f"{base}/committed.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.root)
        if fs.get_file_info(f"{root}/_staging/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_staging/{self.job}")


class FileSink(DataSource):
    """The data source ``veilspark_files``: option ``path``, the folder, and ``job``, a name of the write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].rstrip("/"), self.options["job"])


def write_files(rows: DataFrame, out: str, job: str | None = None) -> str:
    """Stage the files of (path, data) and commit them; gives the job's name for ``publish``."""
    job = job or uuid.uuid4().hex
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("path", "data").write.format(FORMAT).option("path", out).option("job", job).mode("append").save()
    return job


def publish(spark: SparkSession, out: str, job: str) -> int:
    """Move a committed job's files to their names; gives their number. Can be run again after a failure."""
    out = out.rstrip("/")
    fs, root = _open(out)
    base = f"{root}/_staging/{job}"
    if fs.get_file_info(f"{root}/_published/{job}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{root}/_published/{job}") as f:
            return int(f.read())
    if fs.get_file_info(f"{base}/committed.json").type != pafs.FileType.File:
        raise ValueError(f"job {job!r} has not been committed")
    with fs.open_input_stream(f"{base}/committed.json") as f:
        attempts = [a["attempt"] for a in json.loads(f.read()) if a["files"]]
    n = 0
    if attempts:
        listed = spark.read.schema(MANIFEST).json([f"{out}/_staging/{job}/{a}/manifest.json" for a in attempts])
        twice = listed.groupBy("path").count().filter("count > 1").select("path").limit(5).collect()
        if twice:
            raise ValueError(f"several files with one path: {', '.join(r['path'] for r in twice)}")

        def move(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            on, top = _open(out)
            for b in batches:
                for path, staged, size in zip(b["path"], b["staged"], b["size"]):
                    source, target = f"{top}/_staging/{job}/{staged}", f"{top}/{path}"
                    if on.get_file_info(source).type == pafs.FileType.File:
                        on.create_dir(target.rpartition("/")[0], recursive=True)
                        on.move(source, target)
                    elif on.get_file_info(target).size != size:
                        raise FileNotFoundError(f"neither {source} nor {target} is there")
                yield pd.DataFrame({"n": [len(b)]})

        n = listed.mapInPandas(move, "n long").agg(F.sum("n")).first()[0] or 0
    fs.create_dir(f"{root}/_published", recursive=True)
    with fs.open_output_stream(f"{root}/_published/{job}") as f:
        f.write(str(n).encode())
    fs.delete_dir(base)
    return n


def output_files(df: DataFrame, root: str = "", mark: str = "anon") -> DataFrame:
    """(path, data): the new file of each row, and its mapping as JSON beside it.

    ``df``: from ``read_files(..., content=True)`` through ``anonymize`` and ``anonymize_cells``. Paths are those of the
    sources below ``root``, with ``mark`` before the suffix. Only cells whose text changed are written, so others keep
    their type. PDF becomes text.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                name = output_name(r["source_path"].removeprefix(root).lstrip("/").removeprefix("file:").lstrip("/"), mark)
                if suffix(r["source_path"]) in (*EXCEL, *WORD):
                    old = {c["key"]: c["text"] for c in r["cells"]}
                    data = write_binary(r["content"], r["file_type"], {c["key"]: c["text"] for c in r["new_cells"] if old.get(c["key"]) != c["text"]})
                else:
                    data = (r["anonymized"] or "").encode()
                rows += [(name, data), (f"{name}.mapping.json", json.dumps({e["placeholder"]: e["original"] for e in r["entries"]}, ensure_ascii=False, indent=2).encode())]
            yield pd.DataFrame(rows, columns=["path", "data"])

    return df.select("source_path", "file_type", "content", "anonymized", "cells", "new_cells", "entries").mapInPandas(run, "path string, data binary")
