"""Connected components, by one task if the edges are few, else as a distributed fixed point; none reach the driver."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged

LOCAL_EDGES = 2_000_000  # of 16 bytes: 32 MB for one task


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not (new == new[new]).all():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _one_task(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        nodes, label = _smallest(*(np.concatenate(c) for c in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])


def components(edges: DataFrame, rounds: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) with the smallest node of each component, for edges (a, b) of longs.

    Up to ``local`` edges, by their count, one task of an executor has them all. Beyond it, each round takes the
    smallest label among a node's neighbours and then that label's own label, so labels travel twice as far each time
    on chains. Every round is written to the shared folder. Minima are taken before the shuffle, so a node with very
    many neighbours costs each task one row.
    """
    edges = staged(edges.select("a", "b").filter("a != b"), "edges")
    if edges.count() <= local:
        return staged(map_arrow(edges.coalesce(1), _one_task, "node long, label long"), "labels")
    both = staged(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = staged(labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low")), "labels")
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("far"))
        moved = staged(step.join(jump, "low", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("far", "low")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("old != label").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
