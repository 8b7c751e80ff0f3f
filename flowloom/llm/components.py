"""Connected components: inside a task with numpy, over the cluster with joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import written


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i], in place. labels[i] <= i points to a member of i's set, a root to itself."""
    while len(a):
        a, b = labels[a], labels[b]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b: long) -> (node, component), component the smallest node reachable; nodes without edges aren't listed.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, so the number of
    rounds grows with the logarithm of the longest path. All steps are joins of written tables, which Spark can split
    where a node has very many neighbours, and minima that are combined before the shuffle. Each round is written to
    the shared folder."""
    both = edges.where(F.col("a") != F.col("b")).select("a", "b").unionByName(edges.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), f"{name}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        met = written(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), f"{name}-met")
        up = met.select(F.col("node").alias("above"), F.col("label").alias("top"))
        labels = written(met.join(up, met.label == up.above).select("node", "was", F.col("top").alias("label")), f"{name}-labels")
        if labels.where(F.col("was") != F.col("label")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("was")
