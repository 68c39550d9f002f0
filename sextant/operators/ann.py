"""Approximate search in cells around sampled centres, re-scored exactly; how many cells a query needs is measured."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.operators import blocks
from sextant.operators.blocks import best_of, matrix, product, vector_bytes
from sextant.operators.clusters import vector_sums
from sextant.scratch import written

#: Passages above which an index is worth its while.
INDEX_ABOVE = 5000
#: Centres are fitted on at most so many rows a cell, and there are at most so many cells: what is broadcast has a bound.
SAMPLE_PER_CELL, MAX_CELLS, ROUNDS = 64, 16_384, 8
#: Rows whose nearest ``DEPTH`` are searched for exactly, to find how many cells hold ``RECALL`` of them.
AUDIT, DEPTH, RECALL = 256, 10, 0.97


@dataclass(frozen=True)
class Index:
    """Cell centres, the passages with their ``cell``, and how many cells a query looks at, with the share of the nearest
    passages that the audit found there."""

    centres: np.ndarray
    rows: DataFrame
    probes: int = 1
    recall: float = 1.0


def _centres(sample: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Spherical k-means: tasks sum the rows of each cell, the driver sees centres alone."""
    first = sample.orderBy(F.xxhash64("passage_idx", F.lit(seed + 1)), "passage_idx").limit(cells).select("vector").toArrow().combine_chunks()
    c = matrix(first["vector"].combine_chunks())
    for _ in range(ROUNDS):
        sums = vector_sums(assigned(sample, c), "cell").select("cell", "sums").toArrow().combine_chunks()
        s = matrix(sums["sums"].combine_chunks())
        size = np.linalg.norm(s, axis=1, keepdims=True)
        some = size[:, 0] > 1e-9
        c = c.copy()
        c[sums["cell"].to_numpy()[some]] = s[some] / size[some]
    return c


def _order(queries: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The nearest ``probes`` cells of each query, nearest first."""
    return np.argsort(-product(queries, centres), axis=1, kind="stable")[:, :probes]


def build(passages: DataFrame, cells: int | None = None, vector: str = "vector", seed: int = 0, recall: float = RECALL) -> Index:
    """About as many cells as the square root of the passages, at most ``MAX_CELLS``, fitted on a seeded sample; every passage goes to its
    nearest centre.

    ``AUDIT`` seeded passages are searched for exactly, and queries will look at as many cells as hold ``recall`` of what
    these found: few where passages form clusters, most where vectors lie any way."""
    rows = passages.where(F.col(vector).isNotNull())
    n = rows.count()
    cells = max(1, min(cells or round(n**0.5), MAX_CELLS, n))
    if not n:
        return Index(np.zeros((0, 0)), assigned(rows, np.zeros((0, 0)), vector))
    plain = rows.select(F.col("passage_idx").cast("long").alias("passage_idx"), F.col(vector).alias("vector"))
    sample = written(plain.orderBy(F.xxhash64("passage_idx", F.lit(seed)), "passage_idx").limit(cells * SAMPLE_PER_CELL), "sample")
    centres = _centres(sample, cells, seed)
    asked = written(plain.orderBy(F.xxhash64("passage_idx", F.lit(seed + 2)), "passage_idx").limit(AUDIT).withColumnRenamed("passage_idx", "query_id"), "audit")
    near = best_of(plain, asked, DEPTH, False).join(asked, "query_id").select("query_id", F.col("vector").alias("asked"), "passage_idx")
    found = assigned(near.join(plain, "passage_idx"), centres).select("query_id", "asked", "cell").toArrow().combine_chunks()  # AUDIT x DEPTH rows
    order = _order(matrix(found["asked"].combine_chunks()), centres, len(centres))
    depth = np.sort((order == found["cell"].to_numpy()[:, None]).argmax(1))
    probes = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1
    return Index(centres, assigned(rows, centres, vector), probes, float((depth < probes).mean()))


def assigned(rows: DataFrame, centres: np.ndarray, vector: str = "vector") -> DataFrame:
    """``rows`` with their ``cell``."""
    columns = [c for c in rows.columns if c != "cell"]
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(columns.index(vector)))
            cell = product(v, shared.value).argmax(1) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*columns, "cell"])

    return rows.select(*columns).mapInArrow(run, T.StructType([*rows.select(*columns).schema.fields, T.StructField("cell", T.IntegerType())]))


def save(index: Index, path: str) -> None:
    """The rows in order of their cells, so that a search skips the files and row groups of others, and the centres."""
    spark = index.rows.sparkSession
    index.rows.repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([(json.dumps({"probes": index.probes, "recall": index.recall}),)], "value string").coalesce(1).write.text(f"{path}/audit")


def load(spark, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return Index(np.array([r.centre for r in rows]), spark.read.parquet(f"{path}/rows"), **json.loads(spark.read.text(f"{path}/audit").first()[0]))


def search(index: Index, queries: DataFrame, k: int = 10, dedup: bool = True, probes: int | None = None, vector: str = "vector", broadcast_bytes: int | None = None) -> DataFrame:
    """Like ``best_of`` over the passages of each query's ``probes`` nearest cells (by default as many as the audit found to do), exact
    within them: what else is asked at the same time changes nothing.

    Queries that are checked to be small go to every task, which scores the passages of a cell for those queries alone that look there; the cells
    that any of them needs become a filter on the scan. More queries are sent to their cells, each cell in parts of
    bounded size."""
    probes = min(len(index.centres), probes or index.probes)
    rows, centres = index.rows, index.centres
    asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    keys = ["source_file", "char_offset"] if dedup else []
    schema = "query_id long, passage_idx long, score double" + (", source_file string, char_offset long" if dedup else "")
    n, size = vector_bytes(asked)
    if not n or not len(centres) or k <= 0:
        return best_of(rows.limit(0), asked, k, dedup, vector)
    rows = rows.select(F.col("passage_idx").cast("long").alias("passage_idx"), F.col(vector).alias("vector"), *keys, "cell")
    if size <= (blocks.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        table = asked.toArrow().combine_chunks()
        ids, q = table["query_id"].to_numpy(), matrix(table["vector"].combine_chunks())
        looks = np.concatenate([_order(q[part], centres, probes) for part in blocks._cuts(len(q), len(centres))])
        used = np.unique(looks)
        shared = rows.sparkSession.sparkContext.broadcast((ids, q, looks))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, looks = shared.value
            floor = np.full(len(ids), -np.inf)
            flat = np.argsort(looks.ravel(), kind="stable")
            ends = np.searchsorted(looks.ravel()[flat], np.arange(looks.max() + 2))
            who = flat // looks.shape[1]
            for batch in batches:
                cell = batch.column(batch.num_columns - 1).to_numpy()
                for c in np.unique(cell):
                    mine = np.sort(who[ends[c] : ends[c + 1]]) if c + 1 < len(ends) else who[:0]
                    if len(mine):
                        part = batch.take(pa.array(np.flatnonzero(cell == c)))
                        least = floor[mine]
                        yield from blocks._leading(part.select(range(batch.num_columns - 1)), ids[mine], q[mine], least, k, dedup)
                        floor[mine] = least

        few = rows.where(F.col("cell").isin(*used.tolist())) if len(used) < len(centres) else rows
        return blocks.ranked(few.mapInArrow(scan, schema), k, dedup)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _order(matrix(batch.column(1)), shared.value, probes)
                row = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(cells.ravel().astype(np.int32))], ["query_id", "vector", "cell"])

    to = asked.mapInArrow(looked, "query_id long, vector array<double>, cell int")
    most = max(1, blocks.STRIP_BYTES // (8 * centres.shape[1]))
    parts = written(rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "parts")
    cut = written(to.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("cuts")).join(parts, "cell"), "cuts")  # a row a cell
    rows = rows.join(F.broadcast(cut), "cell").withColumn("part", F.pmod(F.xxhash64("passage_idx"), F.col("parts"))).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    to = to.join(F.broadcast(cut.toDF(*(f"to_{c}" for c in cut.columns))), F.col("cell") == F.col("to_cell"))
    to = to.withColumn("to_cut", F.pmod(F.xxhash64("query_id"), F.col("to_cuts"))).withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)))

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        p, q = p.select(["passage_idx", "vector", *keys]).combine_chunks(), q.combine_chunks()
        if not len(p) or not len(q):
            return pa.table({f.name: pa.array([], f.type) for f in _hits(dedup)})
        ids = q["query_id"].to_numpy()
        out = list(blocks._leading(p.to_batches()[0], ids, matrix(q["vector"].combine_chunks()), np.full(len(ids), -np.inf), k, dedup))
        return pa.Table.from_batches(out)

    found = rows.groupBy("cell", "part", "cut").cogroup(to.groupBy("to_cell", "to_part", "to_cut")).applyInArrow(meet, schema)
    return blocks.ranked(found, k, dedup)


def _hits(dedup: bool) -> list[pa.Field]:
    names = [("query_id", pa.int64()), ("passage_idx", pa.int64()), ("score", pa.float64()), ("source_file", pa.string()), ("char_offset", pa.int64())]
    return [pa.field(*x) for x in names[: 5 if dedup else 3]]


def recall(index: Index, queries: DataFrame, k: int = 10, vector: str = "vector") -> DataFrame:
    """``(query_id, n_exact, n_found)``: how many of the ``k`` nearest passages, places repeated, a search by the index finds."""
    exact = best_of(index.rows, queries, k, False, vector).select("query_id", "passage_idx")
    got = search(index, queries, k, False, vector=vector).select("query_id", "passage_idx", F.lit(1).alias("hit"))
    return exact.join(got, ["query_id", "passage_idx"], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))


def retrieve(passages: DataFrame, queries: DataFrame, k: int = 10, index: Index | None = None, dedup: bool = True, vector: str = "vector") -> DataFrame:
    """By the index if there is one, else exact."""
    return search(index, queries, k, dedup, vector=vector) if index else best_of(passages, queries, k, dedup, vector)


def should_index(count: int) -> bool:
    return count > INDEX_ABOVE
