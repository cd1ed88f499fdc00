"""Operator 13, near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to it if it lies in the cap around that direction. Directions come from
random product codes: after a structured random rotation (signs and Hadamard transforms, twice) a vector is cut into
BLOCKS blocks, each block has CODES random unit vectors, and a direction joins one of each block. There are CODES **
BLOCKS of them in each of TABLES rotations, and a vector finds all that its score reaches without trying the others:
blocks are gone through in turn, keeping what the best of the blocks to come could still lift over the threshold. Two
vectors of one label that share a filter are compared by their cosine, in double precision.

The filters' threshold is HEIGHT deviations of a random score, so vectors without neighbours share few filters (some 35
of 33 million a vector; two random vectors share any with a chance of 3.5e-5). Two vectors at a cosine of exactly 0.98
shared one in 2000 of 2000 random cases; recall against all pairs is tested. Nothing found lies below the limit.

Equal vectors of a label are one class with a count of copies, so copies cost one row. Filters that only one class has
are dropped by counts with partial sums. A filter with many classes is cut into blocks of BLOCK classes, and each two
blocks are a task of their own, which gives a count of links for each class and the edges of a spanning forest, never
pairs. A pair that shares several filters is counted only in the one with the smallest key. Components come from the
edges as for the other operators.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with
nothing; so do vectors of different lengths. Repeated rows and repeated ids are vectors of their own. A null vec_id
takes part, but is no component's id as long as there is another one, and is not kept. An empty table gives no rows;
columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, partitions, staged, table
from .components import components

LIMIT = 0.98
BLOCKS, CODES, TABLES, HEIGHT = 2, 1024, 32, 4.4
WIDTH = 64  # vectors are padded to a power of two, this at least
BLOCK = 1024  # classes of a filter that meet in one task
ROWS = 1000  # vectors whose filters are found together
SEED = 20240613
_FOUND = "a long, b long, links long"


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=4)
def _tables(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signs of the rotation and codewords of the blocks, for each table."""
    rng, out = np.random.default_rng(SEED), []
    for _ in range(TABLES):
        signs, codes = rng.choice([-1.0, 1.0], (2, width)), rng.standard_normal((BLOCKS, CODES, width // BLOCKS))
        out.append((signs, codes / np.linalg.norm(codes, axis=2, keepdims=True)))
    return out


def _exceeded(units: np.ndarray, signs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) for all filters of one table whose score reaches the threshold."""
    blocks = _hadamard(_hadamard(units * signs[0]) * signs[1]).reshape(len(units), BLOCKS, -1)
    scores = [blocks[:, b] @ codes[b].T for b in range(BLOCKS)]
    best = np.stack([s.max(1) for s in scores])
    rest = np.concatenate([np.cumsum(best[::-1], 0)[::-1], np.zeros((1, len(units)))])
    least = HEIGHT * np.sqrt(BLOCKS / units.shape[1])
    vec, total, code = np.arange(len(units)), np.zeros(len(units)), np.zeros(len(units), np.int64)
    for b in range(BLOCKS):
        row, word = np.nonzero(scores[b] >= (least - rest[0] + best[b])[:, None])
        n = np.bincount(row, minlength=len(units))
        owner = np.repeat(np.arange(len(vec)), n[vec])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n[vec]) - n[vec], n[vec]) + np.repeat((np.cumsum(n) - n)[vec], n[vec])
        total, code, vec = total[owner] + scores[b][row[at], word[at]], code[owner] * CODES + word[at], vec[owner]
        real = total >= least - rest[b + 1][vec]
        total, code, vec = total[real], code[real], vec[real]
    return vec, code


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1; very large and very small components do no harm."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cap_filters(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) over all tables."""
    width = max(WIDTH, 1 << (units.shape[1] - 1).bit_length())
    padded = np.zeros((len(units), width))
    padded[:, : units.shape[1]] = units
    found = [(v, c + t * CODES**BLOCKS) for t, table_ in enumerate(_tables(width)) for v, c in [_exceeded(padded, *table_)]]
    return np.concatenate([v for v, _ in found]), np.concatenate([c for _, c in found])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vectors."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, _matrix(vectors.take(pa.array(rows)))


def _filters(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            node = part.column("node").to_numpy()
            for rows, vectors in _by_length(part.column("embedding")):
                vec, code = cap_filters(unit_vectors(vectors))
                at = pa.array(rows[vec])
                yield pa.RecordBatch.from_arrays([part.column("label").take(at), pa.array(np.full(len(vec), vectors.shape[1])), pa.array(code), pa.array(node[rows[vec]])], ["label", "size", "code", "node"])


def _linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which cosines reach the limit; near it they are taken anew, pair by pair, so a pair always gets the same answer."""
    cosine = x @ y.T
    i, j = np.nonzero(np.abs(cosine - LIMIT) < 1e-9)
    low, high = (x[i], y[j])
    cosine[i, j] = (low * high).sum(1)
    return cosine >= LIMIT


def _earlier(keys: pa.Array, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of the filters with a smaller key."""
    flat = keys.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy(zero_copy_only=False))
    own = flat < key
    return row[own], flat[own]


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The first row of each row's component; ``linked`` is of the rows ``left`` by the rows ``right``."""
    root = np.arange(n, dtype=np.int32)
    while True:
        new = root.copy()
        if linked.size:
            np.minimum.at(new, left, np.where(linked, root[right][None, :], n).min(1))
            np.minimum.at(new, right, np.where(linked, root[left][:, None], n).min(0))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Links and edges of one filter's block, or of two of its blocks (``side`` 0 and 1)."""
    node, copies, side = (rows.column(c).to_numpy() for c in ("node", "copies", "side"))
    units, key = unit_vectors(_matrix(rows.column("embedding"))), rows.column("key")[0].as_py()
    two = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    left = np.flatnonzero(side == 0) if two else np.arange(len(node))
    right = np.flatnonzero(side == 1) if two else left
    linked = _linked(units[left], units[right])
    if not two:
        np.fill_diagonal(linked, False)
    # counted here only if no filter with a smaller key has both
    row, code = _earlier(rows.column("keys"), key)
    codes, at, n = np.unique(code, return_inverse=True, return_counts=True)
    row, at = row[n[at] > 1], at[n[at] > 1]
    kinds, at = np.unique(at, return_inverse=True)
    counted = linked
    for begin in range(0, len(kinds), 512):
        own = (at >= begin) & (at < begin + 512)
        has = np.zeros((len(node), min(512, len(kinds) - begin)), np.float32)
        has[row[own], at[own] - begin] = 1
        counted = counted & (has[left] @ has[right].T == 0)
    links = np.zeros(len(node), np.int64)
    links[left] += counted @ copies[right]
    if two:
        links[right] += counted.T @ copies[left]
    some = np.flatnonzero(links)
    root = _roots(linked, left, right, len(node))
    tied = np.flatnonzero(root != np.arange(len(node)))
    x, y = node[tied], node[root[tied]]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], x])), pa.array(np.concatenate([node[some], y])), pa.array(np.concatenate([links[some], np.zeros(len(x), np.int64)]))], ["a", "b", "links"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows come in order of (key, i, j); each such group is one block or two."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        cut = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [len(group)]])
        for a, b in zip(cut[:-1], cut[1:]):
            if now is not None and now != tuple(group[a]):
                yield from _done(held)
                held = []
            now = tuple(group[a])
            held.append(batch.slice(a, b - a))
    yield from _done(held)


def _done(held: list[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    if sum(len(b) for b in held) > 1:
        yield _block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _usable() -> Column:
    """Whether a row's vector can have a cosine at all."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(x, lambda e: e != 0), F.lit(False))


def link_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("digest", F.when(_usable(), F.sha2(F.col("embedding").cast("string").cast("binary"), 256)))
    classes = rows.filter("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "label", "digest", "first_id", "copies", "embedding"), "vector-classes")
    found = map_arrow(classes.select("node", "label", "embedding"), _filters, "label string, size long, code long, node long")
    # for one label and size the hash tells all codes apart, so a class has each key once
    filters = staged(found.select(F.xxhash64("label", "size", "code").alias("key"), "node"), "filters")
    common = filters.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = filters.join(common, "key").groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("shared"))
    held = staged(classes.select("node", "copies", "embedding").join(shared, "node"), "shared")
    # a filter with n classes is cut into about n / BLOCK blocks; every class goes to each pair of its block with another
    blocks = F.ceil(F.col("f.n") / BLOCK).cast("int")
    every = held.select("node", "copies", "embedding", F.transform("shared", lambda s: s["key"]).alias("keys"), F.explode("shared").alias("f"))
    every = every.select("*", F.col("f.key").alias("key"), blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = every.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies", "embedding", "keys")
    dealt = meet.repartition(partitions(meet.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = staged(map_arrow(dealt, _blocks, _FOUND), "vector-links")
    counts = links.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(links.filter("a != b").select("a", "b"))
    known = classes.select("node", "label", "digest", "first_id", "copies").join(counts, "node", "left").join(labels.withColumnRenamed("label", "root"), "node", "left")
    known = staged(known.withColumn("root", F.coalesce("root", "node")), "vector-nodes")
    ids = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(ids, "root").select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "digest").join(known, ["label", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op13_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all rows of ``embeddings``."""
    return link_vectors(table(spark, sf_dir, "embeddings"))
