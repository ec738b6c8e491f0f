"""Connected components of an edge table by repeated contraction, on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

#: A graph of no more edges than this is finished by one task (16 bytes an edge).
ONE_TASK = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of an edge list."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, label[x], label[y])
        np.minimum.at(new, label[y], label[x])
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _finish(batches):
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, label = least_labels(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(label, pa.int64())], names=["node", "up"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node, label): the label is the least node of the component.

    Every node hooks onto its least neighbour, paths are halved, and the graph of
    what is left between the roots is contracted again; once no more than
    ``ONE_TASK`` edges remain, one task finishes. The labels stay distributed; the
    driver asks only for the number of edges.
    """
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    left = materialize(left, "edges")
    labels = None
    while n := left.count():
        if n <= ONE_TASK:
            up = left.coalesce(1).mapInArrow(_finish, "node long, up long")
        else:
            both = left.union(left.select("b", "a")).toDF("node", "other")
            up = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("up")), "hooks")
            for _ in range(3):
                over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
                up = up.join(over, "up").select("node", F.col("top").alias("up"))
        up = materialize(up, "jumped")
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            labels = labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            labels = materialize(labels, "labels")
        if n <= ONE_TASK:
            break
        a = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        b = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = left.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()
        left = materialize(left, "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    return labels
