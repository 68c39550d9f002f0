"""Groups of passages that are alike, by single linkage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.vectors import dot
from sextant.operators.blocks import matrix, pairs_over
from sextant.operators.components import connected_components
from sextant.scratch import written


def clusters(vectors: DataFrame, threshold: float, strip_rows: int | None = None) -> DataFrame:
    """``(id, cluster_id)`` for every row of ``vectors`` (``id``, ``vector``): joined by chains of cosines of ``threshold`` or
    more, named by the lowest id. A row alike to none is a cluster of one.

    Rows of one vector are linked to the first of them, which alone is compared with others; of the pairs found, each
    task keeps a forest."""
    rows = vectors.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    same = F.round(dot("vector", "vector"), 6) >= threshold  # a short vector isn't alike to itself
    first = F.when(same, F.min("id").over(Window.partitionBy("vector"))).otherwise(F.col("id"))
    placed = written(rows.select("id", "vector", first.alias("first_")), "placed")
    copies = placed.where("first_ <> id").select(F.col("first_").alias("a"), F.col("id").alias("b"))
    found = pairs_over(placed.where("first_ = id").select("id", "vector").dropDuplicates(["id", "vector"]), None, threshold, strip_rows, forest=True)
    joined = connected_components(copies.unionByName(found.select("a", "b")))
    ids = vectors.where("id is not null").select(F.col("id").cast("long").alias("id")).distinct()
    return ids.join(joined, ids["id"] == joined["node"], "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        v, key = matrix(batch.column(1)), batch.column(0).to_numpy()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        sums = np.add.reduceat(v[order], starts, axis=0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * v.shape[1]), pa.array(sums.ravel()))
        own = np.add.reduceat((v * v).sum(1)[order], starts)
        yield pa.RecordBatch.from_arrays([pa.array(key[order][starts]), lists, pa.array(own), pa.array(np.diff(np.append(starts, len(key))))], ["key", "sums", "own", "n"])


def vector_sums(rows: DataFrame, key: str) -> DataFrame:
    """``(key, sums, own, n)``: over each key (a long) the sum of ``vector``, of its squares, and the number of rows.

    Each batch is summed as a matrix; only its sums are taken apart and shuffled."""
    rows = rows.where("vector is not null").select(F.col(key).cast("long").alias("key"), "vector")
    parts = rows.mapInArrow(_partial_sums, "key long, sums array<double>, own double, n long")
    entries = parts.select("key", "own", "n", F.posexplode("sums").alias("pos", "x")).groupBy("key", "pos").agg(F.sum("x").alias("x"), F.sum("own").alias("own"), F.sum("n").alias("n"))
    whole = entries.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("sums"), F.max("own").alias("own"), F.max("n").alias("n"))
    return whole.withColumnRenamed("key", key)


def centroid(rows: DataFrame) -> DataFrame:
    """One row ``(vector)``: the mean at length one; no row if there are no vectors."""
    from sextant.functions.vectors import normalized

    sums = vector_sums(rows.select(F.lit(0).alias("all_"), "vector"), "all_")
    return sums.select(normalized(F.transform("sums", lambda x: x / F.col("n"))).alias("vector"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, strip_rows: int | None = None) -> DataFrame:
    """``(cluster_id, size, members, mean_cosine)`` of clusters of two or more; the mean is over all pairs of members.

    It comes from the sum of the members' vectors, so a large cluster costs no more than its rows."""
    placed = clusters(vectors, threshold, strip_rows)
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members")).where("size > 1")
    ids = sizes.select("cluster_id", F.explode("members").alias("id"))
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector").join(ids, "id")
    sums = vector_sums(rows, "cluster_id")
    mean = (dot("sums", "sums") - F.col("own")) / (F.col("size") * (F.col("size") - 1))
    return sizes.join(sums, "cluster_id").select("cluster_id", "size", "members", F.round(mean, 6).alias("mean_cosine"))
