"""Bounded samples of labelled documents, and models fitted on one executor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 7) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``most`` labelled documents, the first by a seeded hash of the id.

    Labels other than 0 and 1, ids with both, and rows without id or text are left out; one text stands for rows that repeat an id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    picked = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(most).select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fitted(sample: DataFrame, fit: Callable[[pa.Array, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What ``fit(texts, labels)`` makes of the sample in one executor task; only its arrays reach the driver."""

    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := [x for x in batches if x.num_rows]) else None
        if table is not None:
            table = table.sort_by("doc_id")
            model = fit(table["text"].cast(pa.large_string()).combine_chunks(), table["label"].to_numpy())
            names = list(model)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([str(model[n].dtype) for n in names]), pa.array([list(model[n].shape) for n in names], pa.list_(pa.int64())), pa.array([model[n].tobytes() for n in names], pa.binary())], ["name", "kind", "shape", "data"])

    rows = sample.coalesce(1).mapInArrow(run, "name string, kind string, shape array<long>, data binary").collect()
    return {r.name: np.frombuffer(bytes(r.data), r.kind).reshape(r.shape) for r in rows}


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's bounds; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]
