"""Operator 2, token ids in patched frame-of-reference (PFOR) blocks.

A segment holds the ids of some consecutive documents. Its ids are cut into blocks of ``BLOCK``. A block subtracts its
minimum, packs the rest at the width of its 90th percentile, and lists the values that need more bits as exceptions
(position, whole remainder). The segment's index has each block's start, so one block can be read alone.
Layout, little-endian: magic ``PFR1``, ids (u64), blocks (u32), then per block minimum (u32), width (u8), exceptions
(u16), start (u64); then the blocks: packed 64-bit lanes, exception positions (u8), exception values (u32).

Segments are rows of a Parquet table, so any Hadoop file system can hold them and Spark's committer handles retries.

Edge cases: null text counts as empty (the document still gets its end id); an empty table gives no segments;
repeated doc_ids stay separate documents, ordered by text; a null doc_id sorts first; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, partitions, shared_dir, table, text_slices
from .tokens import encoder

BLOCK, PERCENTILE, MAGIC = 256, 90, b"PFR1"
SEGMENT_IDS = 1 << 18
REMEMBERED = 1_500_000  # chunks of text in a Python worker, 300 MB
SEGMENTS = "part long, first long, doc_ids array<long>, lengths array<long>, ids long, payload binary"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of BLOCK values to rows of packed bytes, lane by lane."""
    lanes = values.reshape(-1, 64).T.astype(np.uint64)
    out = np.zeros((w, lanes.shape[1]), np.uint64)
    for j in range(64):
        at, off = divmod(j * w, 64)
        out[at] |= lanes[j] << np.uint64(off)
        if off + w > 64:
            out[at + 1] |= lanes[j] >> np.uint64(64 - off)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(len(values), -1)


def _unpack(raw: np.ndarray, w: int) -> np.ndarray:
    """The inverse of _pack."""
    words = np.ascontiguousarray(raw).view("<u8").reshape(-1, w).T.astype(np.uint64)
    out = np.empty((64, words.shape[1]), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for j in range(64):
        at, off = divmod(j * w, 64)
        v = words[at] >> np.uint64(off)
        if off + w > 64:
            v = v | (words[at + 1] << np.uint64(64 - off))
        out[j] = v & mask
    return out.T.reshape(len(raw), BLOCK)


def encode_segment(ids: np.ndarray) -> bytes:
    """One segment of 32-bit ids."""
    n = len(ids)
    nb = -(-n // BLOCK)
    full = np.zeros(nb * BLOCK, np.uint32)
    full[:n] = ids
    if n and n < nb * BLOCK:
        full[n:] = full[n - 1]
    blocks = full.reshape(nb, BLOCK)
    low = blocks.min(axis=1) if nb else np.zeros(0, np.uint32)
    rest = blocks - low[:, None]
    k = BLOCK * PERCENTILE // 100 - 1
    width = _bits(np.partition(rest, k, axis=1)[:, k]) if nb else np.zeros(0, np.int64)
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    count = over.sum(axis=1).astype(np.int64)
    size = width * (BLOCK // 8) + count * 5
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    body = np.zeros(start[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        mask = np.uint32((1 << int(w)) - 1)
        body[start[rows][:, None] + np.arange(int(w) * (BLOCK // 8))] = _pack(rest[rows] & mask, int(w))
    b, p = np.nonzero(over)
    if len(b):
        rank = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
        at = start[b] + width[b] * (BLOCK // 8)
        body[at + rank] = p
        body[(at + count[b] + 4 * rank)[:, None] + np.arange(4)] = np.ascontiguousarray(rest[b, p].astype("<u4")).view(np.uint8).reshape(-1, 4)
    head = [MAGIC, np.array([n], "<u8"), np.array([nb], "<u4"), low.astype("<u4"), width.astype(np.uint8), count.astype("<u2"), start[:-1].astype("<u8")]
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in head) + body.tobytes()


def _index(payload: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, nb = int(np.frombuffer(payload, "<u8", 1, 4)[0]), int(np.frombuffer(payload, "<u4", 1, 12)[0])
    at, out = 16, []
    for kind in ("<u4", np.uint8, "<u2", "<u8"):
        out.append(np.frombuffer(payload, kind, nb, at))
        at += nb * np.dtype(kind).itemsize
    return n, nb, *out, at


def decode_segment(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks ``first`` to ``last`` (exclusive; all by default)."""
    n, nb, low, width, count, start, at = _index(payload)
    last = nb if last is None else min(last, nb)
    pick = np.arange(first, last)
    body = np.frombuffer(payload, np.uint8, -1, at)
    rest = np.zeros((len(pick), BLOCK), np.uint32)
    w_all, begin, many = width[pick].astype(np.int64), start[pick].astype(np.int64), count[pick].astype(np.int64)
    for w in np.unique(w_all[w_all > 0]):
        rows = np.flatnonzero(w_all == w)
        rest[rows] = _unpack(body[begin[rows][:, None] + np.arange(int(w) * (BLOCK // 8))], int(w))
    if many.sum():
        b = np.repeat(np.arange(len(pick)), many)
        rank = np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many)
        place = begin[b] + w_all[b] * (BLOCK // 8)
        values = np.ascontiguousarray(body[(place + many[b] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        rest[b, body[place + rank]] = values
    ids = (rest + low[pick][:, None]).ravel()
    return ids[: max(0, min(n, last * BLOCK) - first * BLOCK)]


def _writer(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc, part, done = encoder(path, REMEMBERED), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], "<u4").tobytes()
        docs, sizes, held = [], [], []

        def row():
            nonlocal done
            ids = np.frombuffer(b"".join(held), "<u4")
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([done], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([encode_segment(ids)], pa.binary())], ["part", "first", "doc_ids", "lengths", "ids", "payload"])
            done += len(ids)
            docs.clear(), sizes.clear(), held.clear()
            return out

        filled = 0
        for batch in text_slices(batches, 24_000_000):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text"))):
                docs.append(doc)
                held += (ids, tail)
                sizes.append(len(ids) // 4 + 1)
                filled += sizes[-1]
                if filled >= SEGMENT_IDS or len(sizes) >= 4096:
                    yield row()
                    filled = 0
        if docs:
            yield row()

    return run


def write_token_file(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> str:
    """Encode (doc_id, text) and write segments in ascending doc_id order under ``path``.

    One range shuffle of the texts; each task then streams its documents, holding one segment. Range bounds come from
    a sample of doc_ids, so a hot source or a group of copies does not make a hot task.
    """
    n = partitions(docs.sparkSession)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ranged, _writer(tokenizer, end_id), SEGMENTS).write.option("compression", "uncompressed").parquet(path)
    return path


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part. One number for each write task: bounded by the partition count, never by documents."""
    out, total = {}, 0
    for r in spark.read.schema(SEGMENTS).parquet(path).groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect():
        out[r["part"]] = total
        total += r["n"]
    return out


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files. ``ids``: little-endian u32 bytes."""
    starts = part_starts(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part, first, docs, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "doc_ids", "lengths", "payload"))):
                ids = decode_segment(payload).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + (starts[part] + first), pa.int64()), pa.array(sizes, pa.int64()), pa.array([ids[4 * b : 4 * e] for b, e in zip(begins, ends)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return map_arrow(spark.read.schema(SEGMENTS).parquet(path), run, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: token file of all documents, read back."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, path)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
