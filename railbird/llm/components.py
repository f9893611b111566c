"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.operators.groups import durable

# edges that one task works through; beyond, they stay spread over all
FEW = 1_000_000


def _in_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges given, by handing smallest numbers on and halving chains."""
    held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if not held:
        return
    a, b = (np.concatenate(side) for side in zip(*held, strict=True))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        smaller = np.minimum(label[left], label[right])
        # a number also goes to the node that the old one stands for
        for side in (left, right):
            np.minimum.at(label, before[side], smaller)
            np.minimum.at(label, side, smaller)
        label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the edges ``a, b`` (longs).

    In turn, each node hands its larger neighbours, then its smaller ones, to the smallest it knows, until nothing moves;
    the rounds grow with the logarithm of the longest chain. Neighbours are never gathered: a node's smallest is an
    aggregate, which is joined back to its edges. At most ``FEW`` edges are one task's work instead, with the same result.
    """
    edges = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= FEW:
        return durable(edges.coalesce(1).mapInArrow(_in_a_task, "node long, component long"))
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = durable(large)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.union(smallest.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
