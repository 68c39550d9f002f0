"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.scratch import written

#: Edges up to which one task joins the components; beyond it, star rounds over the cluster.
ONE_TASK_EDGES = 4_000_000


def min_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of their component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = min_labels(places[: len(a)], places[len(a) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node joined to it.

    Edges with a null end count for nothing; self edges make a component of one node; repeated edges are as one;
    no edges give no rows. Up to ``one_task_edges`` edges are joined by one task of an executor. Beyond that, rounds of
    large-star and small-star contraction run over the cluster, each cut by a written table."""
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if pairs.count() <= one_task_edges:
        return pairs.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    loops = pairs.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"))  # u > v
    seen = None
    while True:
        both = loops.union(loops.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        loops = written(small, "small-star")
        state = loops.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(loops.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
