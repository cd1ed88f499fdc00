"""A versioned store of mappings by session: append, snapshot by version, purge, restore, partial unmasking, audit.

A store is a folder. ``data`` and ``purged`` hold Parquet, one folder a write; ``log`` holds one small JSON file for each
version, which is created only if it is not there yet, so of two writers one gets the next number and the other the one
after it. A snapshot reads what the log lists up to a version. Purging adds a version with the sessions to forget: later
snapshots do not show them, earlier ones do until ``vacuum``, which writes what is left as one base and deletes all
older files. All rows stay on the executors; the driver sees the log alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import span_algebra as A
from .engine import DeidEngine, mapping_rows, with_session

COLUMNS = "session_id string, placeholder string, entity_type string, ordinal int, original string"


class UnknownSession(ValueError):
    """A session that the store does not have."""


class MappingStore:
    """The store in the folder ``root``, which any Hadoop file system can hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # the log

    def _log(self) -> dict[int, dict]:
        folder = self._path(f"{self.root}/log")
        if not self._fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        paths = [f"{self.root}/log/{n}" for n in names if n.endswith(".json")]
        rows = self.spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name"), "value").collect() if paths else []
        return {int(r[0].removesuffix(".json")): json.loads(r[1]) for r in rows}

    def _add(self, entry: dict) -> int:
        n = self.version() + 1
        while True:
            at = self._path(f"{self.root}/log/{n:012d}.json")
            if not self._fs.exists(at):
                try:
                    out = self._fs.create(at, False)
                except Exception as e:  # another writer took the number
                    if "FileAlreadyExists" not in str(e):
                        raise
                else:
                    out.write(bytearray(json.dumps(entry).encode()))
                    out.close()
                    return n
            n += 1

    def version(self) -> int:
        """The newest version; 0 for an empty store."""
        return max(self._log(), default=0)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    # writing

    def append(self, mapping: DataFrame) -> int:
        """Add mapping rows (COLUMNS); gives the new version."""
        return self._add({"op": "append", "path": self._write(mapping.select(*[c.split()[0] for c in COLUMNS.split(", ")]), "data")})

    def purge(self, sessions: DataFrame | Iterable[str]) -> int:
        """Forget sessions from the new version on; their files go with ``vacuum``."""
        if not isinstance(sessions, DataFrame):
            sessions = self.spark.createDataFrame([(s,) for s in sessions], "session_id string")
        return self._add({"op": "purge", "path": self._write(sessions.select("session_id").distinct(), "purged")})

    def vacuum(self) -> int:
        """Write the newest snapshot as one base and delete everything older: purged values are gone from the disk."""
        old = self._log()
        n = self._add({"op": "base", "path": self._write(self.snapshot(), "data"), "upto": max(old, default=0)})
        for v, entry in old.items():
            self._fs.delete(self._path(f"{self.root}/{entry['path']}"), True)
            self._fs.delete(self._path(f"{self.root}/log/{v:012d}.json"), False)
        return n

    # reading

    def snapshot(self, version: int | None = None) -> DataFrame:
        """Mapping rows as of a version, the newest by default."""
        log = {v: e for v, e in sorted(self._log().items()) if version is None or v <= version}
        if version is not None and version > 0 and version not in log:
            raise ValueError(f"version {version} is not in the store")
        # a base stands for the versions up to the one that it was taken at; later ones may have a smaller number than it
        base = max((v for v, e in log.items() if e["op"] == "base"), default=0)
        upto = log[base]["upto"] if base else 0
        live = {(upto if v == base else v): e for v, e in log.items() if v == base or v > upto and e["op"] != "base"}
        added, gone = ({v: e["path"] for v, e in live.items() if (e["op"] == "purge") == p} for p in (False, True))
        rows = self._read(added, COLUMNS)
        if gone:
            last = self._read(gone, "session_id string").groupBy("session_id").agg(F.max("_v").alias("_gone"))
            rows = rows.join(last, "session_id", "left").filter("_gone IS NULL OR _gone < _v")
        return rows.select(*[c.split()[0] for c in COLUMNS.split(", ")])

    def _read(self, paths: dict[int, str], schema: str) -> DataFrame:
        """All rows of some writes, with their version."""
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, _v int")
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths.values()])
        names = F.create_map(*[F.lit(x) for v, p in paths.items() for x in (p.rpartition("/")[2], v)])
        return df.withColumn("_v", names[F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)])

    def restore(self, df: DataFrame, text: str = "anonymized", version: int | None = None, strict: bool = True) -> DataFrame:
        """Add ``restored`` by each row's session_id, as of a version. An unknown session fails the query, or with
        ``strict=False`` leaves the text and has ``known`` false. A session without any values is known if its row says
        ``entity_count`` 0."""
        maps = self.snapshot(version).groupBy("session_id").agg(F.collect_set(F.struct(F.col("placeholder").alias("key"), F.col("original").alias("value"))).alias("_map"))
        empty = F.coalesce(F.col("entity_count") == 0, F.lit(False)) if "entity_count" in df.columns else F.lit(False)
        joined = df.join(maps, "session_id", "left").withColumn("known", F.col("_map").isNotNull() | empty)
        back = f"CASE WHEN _map IS NOT NULL THEN {A.restore_once(f'`{text}`', '_map')} ELSE `{text}` END"
        if strict:
            back = f"CASE WHEN known THEN {back} ELSE raise_error(concat('session ', coalesce(session_id, 'null'), ' not found')) END"
        return joined.withColumn("restored", F.expr(back)).drop("_map")

    def review(self, sessions: DataFrame, version: int | None = None) -> DataFrame:
        """The markers and values of sessions (session_id), in no order: for eyes that may see them."""
        return self.snapshot(version).join(sessions.select("session_id").distinct(), "session_id")

    def redact(self, df: DataFrame, engine: DeidEngine, out: str, text: str = "text") -> int:
        """One job: give rows sessions, write them anonymized without their original text to ``out``, keep the mapping here.

        What is written is read back for the mapping, so a retried task cannot give a row another session than its mapping's.
        """
        done = engine.anonymize(with_session(df), text)
        kept = f"{self.root}/data/{uuid.uuid4().hex}"
        done.write.parquet(kept)
        rows = self.spark.read.schema(done.schema).parquet(kept)
        rows.drop(text, "spans", "resolved", "entries").write.parquet(out)
        version = self.append(mapping_rows(rows, "session_id"))
        self._fs.delete(self._path(kept), True)
        return version


def unmask(df: DataFrame, mapping: DataFrame, markers: DataFrame, key: str = "session_id", text: str = "anonymized") -> DataFrame:
    """Add ``unmasked``: only the chosen ``markers`` (key, placeholder) are restored; all others keep their numbers.

    One shuffle on the key for each side.
    """
    chosen = mapping.join(markers.select(key, "placeholder").distinct(), [key, "placeholder"], "left_semi")
    maps = chosen.groupBy(key).agg(F.collect_set(F.struct(F.col("placeholder").alias("key"), F.col("original").alias("value"))).alias("_map"))
    joined = df.join(maps, key, "left")
    return joined.withColumn("unmasked", F.expr(f"CASE WHEN _map IS NOT NULL THEN {A.restore_once(f'`{text}`', '_map')} ELSE `{text}` END")).drop("_map")


def audit(df: DataFrame, mapping: DataFrame, markers: DataFrame, key: str = "session_id", text: str = "anonymized") -> DataFrame:
    """A row for each asked marker: key, placeholder, entity_type, how often it stands in the text, and the outcome.

    outcome: ``unmasked``, ``absent`` (known, but not in the text) or ``unknown`` (no such value of this key).
    """
    asked = markers.select(key, "placeholder").distinct()
    marks = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(A.TOKEN), F.lit(0))).alias("placeholder")).groupBy(key, "placeholder").agg(F.count("*").alias("n"))
    rows = asked.join(marks, [key, "placeholder"], "left").join(mapping.select(key, "placeholder", "entity_type"), [key, "placeholder"], "left")
    outcome = F.when(F.col("entity_type").isNull(), "unknown").when(F.col("n").isNull(), "absent").otherwise("unmasked")
    return rows.select(key, "placeholder", "entity_type", F.coalesce("n", F.lit(0)).alias("occurrences"), outcome.alias("outcome"))
