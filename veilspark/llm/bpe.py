"""Operator 5, byte-level BPE encoding and decoding by a rank file.

Two tiers. A minimal perfect hash (hash and displace) maps every vocabulary entry to its own slot, so a batch of
distinct pre-tokens is looked up with a few numpy operations; equality of the bytes confirms a hit. A pre-token outside
the vocabulary is merged by a heap over a linked list of its bytes, O(n log n) for any length.
The tables are as large as the vocabulary, not as the input, and are built once on the driver.

Edge cases: null text counts as empty and gives no ids; an empty table gives no rows; repeated rows stay; other columns
are dropped. Ids outside the vocabulary raise ValueError on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, text_slices

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of non-empty byte strings."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    if not len(sizes):
        return np.zeros(0, _U)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(keys), np.uint8).astype(_U) + _U(1)
    powers = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(int(sizes.max()) - 1, _BASE, _U)]))
    return _mix(np.add.reduceat(data * powers[np.arange(len(data)) - np.repeat(starts, sizes)], starts) + sizes.astype(_U))


class PerfectHash:
    """Minimal perfect hash of n keys: n slots, one displacement for about four keys."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        h = hash_keys(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("keys repeat")
        self.shift = np.zeros(self.buckets, np.int64)
        start, step = self._parts(h)
        free = np.ones(self.n, bool)
        groups = (h % _U(self.buckets)).astype(np.int64)
        order = np.argsort(groups, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(groups, minlength=self.buckets))[:-1])
        slot_of = np.zeros(self.n, np.int64)
        single = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            rows = members[b]
            if len(rows) <= 1:
                single += [(b, rows[0])] if len(rows) else []
                continue
            d = 1
            while True:  # 64 displacements at a time
                tries = np.sort((start[rows, None] + np.arange(d, d + 64, dtype=_U) * step[rows, None]) % _U(self.n), axis=0)
                good = np.flatnonzero(free[tries.astype(np.int64)].all(axis=0) & (np.diff(tries, axis=0) > 0).all(axis=0))
                if len(good):
                    d += int(good[0])
                    break
                d += 64
            at = ((start[rows] + _U(d) * step[rows]) % _U(self.n)).astype(np.int64)
            self.shift[b] = d
            free[at] = False
            slot_of[rows] = at
        for (b, row), at in zip(single, np.flatnonzero(free)):
            self.shift[b], slot_of[row] = -1 - at, at
        self.key_at = np.argsort(slot_of)

    @staticmethod
    def _parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _mix(h + _BASE), _mix(h ^ _BASE) | _U(1)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; any slot for keys that the table lacks."""
        h = hash_keys(keys)
        d = self.shift[(h % _U(self.buckets)).astype(np.int64)]
        start, step = self._parts(h)
        return np.where(d < 0, -1 - d, ((start + np.maximum(d, 0).astype(_U) * step) % _U(self.n)).astype(np.int64))


class RankTable:
    """Vocabulary of a rank file: ids, bytes and the perfect hash."""

    def __init__(self, path: str, pattern: str, capacity: int = 400_000):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.bytes_of = {int(i): base64.b64decode(t) for t, i in pairs}
        self.ranks = {v: k for k, v in self.bytes_of.items()}
        self.keys, self.ids = list(self.ranks), list(self.ranks.values())
        self.hash = PerfectHash(self.keys)
        self.pattern, self.capacity = pattern, capacity
        self.memo: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "find": None}

    def merge(self, word: bytes) -> list[int]:
        """Heap merge of one pre-token, lowest rank first and leftmost among equals."""
        n, ranks = len(word), self.ranks
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # piece i is word[i:end[i]]; the next piece starts at end[i]
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(word[i : i + 2])) is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def resolve(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens as u32 bytes: perfect hash first, heap for what it lacks."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = []
        for key, at in zip(raw, self.hash.key_at[self.hash.slots(raw)].tolist()):
            ids = [self.ids[at]] if self.keys[at] == key else self.merge(key)
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, little-endian u32."""
        if self.__dict__.get("find") is None:
            import regex

            self.find = regex.compile(self.pattern).findall
        found = [self.find(t) for t in texts]
        seen = set().union(*found)
        if new := [w for w in seen if w not in self.memo]:
            if len(self.memo) + len(new) > self.capacity:
                self.memo.clear()
                new = list(seen)
            self.memo.update(zip(new, self.resolve(new)))
        out = [b"".join(map(self.memo.__getitem__, f)) for f in found]
        if len(self.memo) > self.capacity:
            self.memo.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"id {e} is not in the vocabulary") from None


def bpe_encode(docs: DataFrame, ranks: RankTable) -> DataFrame:
    """(doc_id, n_tokens, ids) for (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        t = shared.value
        for b in text_slices(batches):
            ids = t.encode([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, run, "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, ranks: RankTable) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded) for (doc_id, n_tokens, ids): bytes, and the digest of the decimal ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        t = shared.value
        decimal = {i: b"%d" % i for i in t.bytes_of}
        for b in batches:
            sha, raw = [], []
            for x in b.column("ids"):
                ids = np.frombuffer(x.as_py(), "<u4").tolist()
                raw.append(t.decode(ids))
                sha.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(sha, pa.string()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded"])

    return map_arrow(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode every whole document, decode the ids."""
    import public_tokenizers

    ranks = RankTable(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    back = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
