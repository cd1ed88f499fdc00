"""Operator 4, sequence packing: shortest-pack-first over the length histogram.

1. Each task encodes its texts, cuts them into pieces of at most ``limit`` ids and numbers the pieces of each length
   as it meets them; pieces are written to the shared folder.
2. Counts by (task, length) give each task's base rank for each length, by a running sum, and the length histogram,
   which has at most ``limit`` rows at any input size. Only the histogram reaches the driver.
3. The driver packs the histogram: lengths longest first, each length into the open packs with the smallest total
   that still fit, moving whole counts of equal packs at once. The result is a list of patterns with counts.
4. Each (pattern, place) claims a run of ranks of its length; a piece finds its run by binary search, which yields its
   sequence and offset. No sequence or group is ever collected.

Padding: a sequence is padded to ``limit`` unless its total is a power of two.

Edge cases: null text counts as empty (its document is the end id alone); an empty table gives no pieces; repeated
doc_ids are packed as separate documents; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, staged, table, text_slices
from .tokens import encoder

PIECES = "task long, rank long, doc_id long, start long, length long, doc_tokens long, ids binary"


def spfhp(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with counts that pack the whole histogram."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    totals: list[int] = []

    def put(total: int, pattern: tuple[int, ...], n: int) -> None:
        if total not in open_packs:
            open_packs[total] = []
            bisect.insort(totals, total)
        open_packs[total].append((pattern, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            if not totals or totals[0] + length > limit:
                put(length, (length,), left)
                break
            total = totals[0]
            pattern, n = open_packs[total].pop()
            if not open_packs[total]:
                del open_packs[total]
                totals.pop(0)
            take = min(n, left)
            if n > take:
                put(total, pattern, n - take)
            put(total + length, (*pattern, length), take)
            left -= take
    return [(p, n) for total in sorted(open_packs) for p, n in open_packs[total]]


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of each run, and the sequence and offset that the run begins with."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used, base = Counter(), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def cut(n: int, limit: int) -> list[int]:
    """Piece lengths of a document: whole sequences, then the rest in halves of the limit at most."""
    out = [limit] * (n // limit)
    rest, half = n % limit, limit // 2
    return out + [x for x in (half if rest > half else 0, rest - half if rest > half else rest) if x]


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 2048) -> DataFrame:
    """(task, rank, doc_id, start, length, doc_tokens, ids): the pieces of all documents, ranked by task and length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        tail = np.array([end_id], "<u4").tobytes()
        for batch in text_slices(batches, 24_000_000):
            cols = [[] for _ in range(7)]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text"))):
                ids, at = ids + tail, 0
                for n in cut(len(ids) // 4, limit):
                    for c, v in zip(cols, (task, seen[n], doc, at, n, len(ids) // 4, ids[4 * at : 4 * (at + n)])):
                        c.append(v)
                    seen[n] += 1
                    at += n
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], ["task", "rank", "doc_id", "start", "length", "doc_tokens", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(map_arrow(slim, run, PIECES), "pieces")


def pack(pieces: DataFrame, limit: int = 2048, carry: tuple = ("ids",)) -> DataFrame:
    """Give each piece its sequence_id and offset. ``carry``: columns to keep besides the piece's own.

    What is carried moves through one shuffle by (task, length) when the counts are too large to broadcast, so a
    caller that needs only a digest of ``ids`` should pass that.
    """
    counts = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = layout(spfhp(histogram, limit))
    keep = ["doc_id", "start", "length", "doc_tokens"]
    ranked = pieces.select("task", *keep, "rank", *carry).join(bases, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("task", "base")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for rows in np.split(order, cuts[1:]) if len(order) else []:
                first, base, offset = runs[int(lengths[rows[0]])]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                seq[rows] = base[k] + ranks[rows] - first[k]
                off[rows] = offset[k]
            b = b.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield b

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields]
    return map_arrow(ranked, place, ", ".join([*kinds, "sequence_id long", "offset long"])).drop("rank")


def pack_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table of documents."""
    import public_tokenizers

    pieces = encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    out = pack(pieces, carry=(F.crc32("ids").alias("ids_crc32"),))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: pack all documents into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
