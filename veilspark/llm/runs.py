"""Operator 11, periodic run detection in word sequences over a harmonic grid.

A run is a stretch of words in which words q apart are equal, q being its smallest period, that no neighbouring word
extends. Every run of period p with at least 2 p words holds two neighbouring points jp and (j + 1) p of the grid of p.
So for each p and j the longest common extension (LCE) of these two places, forwards and backwards, gives the run
around them; there are n ln n such pairs. An LCE is the least entry of the LCP array between two ranks: a suffix array
(prefix doubling) of the words with a sparse table for range minima, and the same of the reversed words.

Texts are worked on many at a time, as one array. A word counts as another one in each text, so no suffix of a text
shares anything with those of other texts and the ranks of a text lie together. Pairs whose words differ both at and
before the two places have no extension and are passed over. Stretches found with several periods keep the smallest.

One narrow stage: no shuffle. A task holds about SLICE bytes of text, or one longer text, and some 300 bytes a word.
Edge cases: null and empty texts and such of spaces alone have no words and no runs; a null doc_id stays; repeated rows
are worked on row by row; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, text_slices
from .words import join_words, split_words

LEAST = 12  # words of a run
SLICE = 1_000_000  # bytes of text worked on together
PAIRS = 1 << 20  # points of the grid looked at together
RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def _ramp(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners 0 0 1 1 1 and places 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Extensions:
    """LCE queries over the concatenated sequences of several texts.

    ``codes``: equal numbers for equal words of one text, other numbers in each text, growing from text to text.
    ``left``: how many words from a place to the end of its text, itself included.
    """

    def __init__(self, codes: np.ndarray, left: np.ndarray):
        n = len(codes)
        levels = self._ranks(codes, left)
        self.rank = levels[-1]
        order = np.empty(n, np.int32)
        order[self.rank] = np.arange(n, dtype=np.int32)
        common = self._neighbours(order, levels)
        del levels
        self.table = [common]
        while 1 << len(self.table) <= int(left.max(initial=1)):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            if half >= n:
                break
            low = last.copy()
            np.minimum(last[:-half], last[half:], out=low[:-half])
            self.table.append(low)
        self.table = np.stack(self.table)

    @staticmethod
    def _ranks(codes: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        """Ranks by the first 1, 2, 4, ... words until all differ; equal prefixes share the place of their first."""
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        by = codes[order]
        new = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(new, np.diff(np.append(new, n)))
        size = np.diff(np.append(new, n))
        open_ = order[np.repeat(size > 1, size)]
        levels, step = [rank], 1
        while len(open_):
            own = rank[open_].astype(np.int64)
            ends = left[open_] <= step
            after = np.where(ends, -1, rank[np.minimum(open_ + step, n - 1)])
            key = own * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            open_, own, key = open_[order], own[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.concatenate([[True], own[1:] != own[:-1]])
            at = np.arange(len(key))
            inside = np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
            rank = rank.copy()
            rank[open_] = own + inside
            levels.append(rank)
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(key)))
            open_ = open_[np.repeat(size > 1, size)]
            step *= 2
        return levels

    @staticmethod
    def _neighbours(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """LCP of each suffix with the one before it in the suffix array."""
        n = len(order)
        out = np.zeros(n, np.int32)
        near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
        a, b, common = order[near].astype(np.int64), order[near - 1].astype(np.int64), np.zeros(len(near), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + common, b + common
            inside = (x < n) & (y < n)
            same = levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
            common += (same & inside) * (1 << k)
        out[near] = common
        return out

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from place a on equal those from place b on; a and b differ and lie in one text."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        flat, n = self.table.reshape(-1), self.table.shape[1]
        row = k * n
        return np.minimum(flat[row + low], flat[row + high - (1 << k)])


def _grid(counts: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, p, number of pairs of neighbouring points), for all texts and periods, about PAIRS pairs at a time."""
    row, p = _ramp(counts // 2)
    p += 1
    pairs = (counts[row] - 1) // p
    cut = np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum() + PAIRS, PAIRS))
    for a, b in zip(cut[:-1], np.append(cut[1:-1], len(row))):
        if a < b:
            yield row[a:b], p[a:b], pairs[a:b]


def find_runs(codes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Columns (text, start, length, period) of all runs, in this order; codes of words, counts of words by text."""
    n, none = len(codes), np.empty((0, 4), np.int64)
    if not n:
        return none
    begin = np.cumsum(counts) - counts
    text, place = _ramp(counts)
    # another number for a word in each text, dense and in order of texts
    codes = np.unique(text.astype(np.int64) * (int(codes.max()) + 1) + codes, return_inverse=True)[1].astype(np.int64)
    forward = Extensions(codes, counts[text] - place)
    backward = Extensions(codes[::-1].max(initial=0) - codes[::-1], (place + 1)[::-1])
    found = [none]
    for row, p, pairs in _grid(counts):
        owner, j = _ramp(pairs)
        step = p[owner]
        a = begin[row[owner]] + j * step
        b = a + step
        inner = j > 0
        same_before = inner & (codes[a - inner] == codes[b - 1])
        some = np.flatnonzero((codes[a] == codes[b]) | same_before)
        a, b, step, inner, owner = a[some], b[some], step[some], inner[some], owner[some]
        right = forward.lce(a, b)
        back = np.zeros(len(a), np.int64)
        before = np.flatnonzero(inner)
        back[before] = backward.lce(n - a[before], n - b[before])
        whole = step + right + back
        long_enough = (right + back >= step) & (whole >= least)
        at = np.flatnonzero(long_enough)
        if len(at):
            t = row[owner[at]]
            found.append(_smallest_periods(np.stack([t, a[at] - back[at] - begin[t], whole[at], step[at]], 1)))
    return _smallest_periods(np.concatenate(found))


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """One row of each stretch, with its smallest period; in order of text, start, period."""
    rows = rows[np.lexsort(rows.T[::-1])]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _work(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in text_slices(batches, SLICE):
        words, counts = split_words(batch.column("text"))
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        runs = find_runs(codes, counts)
        at = np.searchsorted(runs[:, 0], np.arange(len(counts) + 1)).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
        # dropped: what any run covers after its first period
        begin = np.cumsum(counts) - counts
        change = np.zeros(len(codes) + 1, np.int64)
        first = begin[runs[:, 0]] + runs[:, 1]
        np.add.at(change, first + runs[:, 3], 1)
        np.add.at(change, first + runs[:, 2], -1)
        kept = np.cumsum(change[:-1]) == 0
        left = np.bincount(_ramp(counts)[0][kept], minlength=len(counts))
        collapsed = join_words(words.filter(pa.array(kept)), left)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), each), collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: its runs in order of start and period, and its words but those that a run repeats."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _work, SCHEMA)


def _looped(text: Column) -> Column:
    """The query's own repeats, for one document in ten: from a word on, the text goes round in a period. A null doc_id counts as ''."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), F.slice(cycle, 1, n - a)), " ")).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: runs of all documents, one in ten of them looped; digests of all runs and of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _looped(F.coalesce("text", F.lit(""))).alias("text"))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    # longest first, then earliest, then of the smallest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    length, period = -F.col("b.back"), F.col("b.period")
    exponent = F.expr("(1000 * -b.back) div b.period").cast("long")
    return rows.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
