"""Quality by nearest-neighbour voting over labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.sample import bytes_of, fitted, labelled_sample
from sextant.llm.words import cuts, split_words

WIDTH = 2048
#: Weight of the term that a word following itself counts for.
REPEAT_WEIGHT = 3.0
DIMENSIONS = 64
NEIGHBOURS = 15
MAX_LABELLED = 4096
THRESHOLD = 0.5
_ROWS = 512


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of each row's byte trigrams, hashed to ``WIDTH`` places, and of words that follow themselves:
    float32 [rows, WIDTH + 1]."""
    raw, bounds = bytes_of(texts)
    n = len(bounds) - 1
    out = np.zeros((n, WIDTH + 1), np.float32)
    if len(raw) < 3:
        return out
    x = raw.astype(np.uint32)
    h = ((x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(2246822519) + x[2:] * np.uint32(3266489917)) >> np.uint32(21)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    inside = row[:-2] == row[2:]
    out[:, :WIDTH] = np.bincount(row[:-2][inside] * WIDTH + h[inside], minlength=n * WIDTH).reshape(n, WIDTH)
    _, codes, ends = split_words(texts)
    row = np.repeat(np.arange(n), np.diff(ends))
    out[:, WIDTH] = np.bincount(row[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])], minlength=n)
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    for i, j in cuts(texts, most_rows=_ROWS):
        yield texts.slice(i, j - i)


def latent(texts: pa.Array, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit latent-semantic vectors; texts of fewer than three bytes have zeros."""
    return _unit(_weighted(term_counts(texts), idf) @ axes)


def fit(texts: pa.Array, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Inverse document frequencies, the leading singular directions, and the labelled vectors."""
    counts = np.concatenate([term_counts(x) for x in _pieces(texts)])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    idf[WIDTH] *= REPEAT_WEIGHT
    x = _weighted(counts, idf)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS].astype(np.float32))
    return {"idf": idf, "axes": axes, "vectors": _unit(x @ axes), "labels": labels.astype(np.float32)}


def votes(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The share of label 1 among the nearest ``neighbours`` by exact cosine, weighted by the cosine; NaN without a neighbour
    of positive cosine. Ties at the last place go to the labelled row that comes first."""
    cosines = vectors @ known.T
    k = min(neighbours, len(known))
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(cosines, near, 1).min(1)
    unsure = np.flatnonzero((cosines >= last[:, None]).sum(1) > k)
    if len(unsure):
        near[unsure] = np.argsort(-cosines[unsure], axis=1, kind="stable")[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64)
    total = weight.sum(1)
    return np.where(total > 0, (weight * labels[near]).sum(1) / np.where(total > 0, total, 1), np.nan)


def quality_model(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7) -> dict[str, np.ndarray]:
    """Fitted on at most ``max_labelled`` labelled documents; empty without any."""
    return fitted(labelled_sample(docs, labels, "quality", max_labelled, seed), fit)


def with_quality(docs: DataFrame, model: dict[str, np.ndarray], neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``quality_score`` in 0..1 and ``keep`` (score at least ``threshold``, or none).

    The score compares each whole text with every labelled vector. A null text, one of fewer than three bytes, or any text
    while nothing is labelled has a null score and is kept: nothing speaks against it. Rows that repeat get equal
    results. Columns of these two names, in any case, are replaced; others pass through. An empty table gives an empty one."""
    columns = [c for c in docs.columns if c.lower() not in ("quality_score", "keep")]
    if not model:
        return docs.select(*columns, F.lit(None).cast("double").alias("quality_score"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        found = [votes(latent(x, m["idf"], m["axes"]), m["vectors"], m["labels"], neighbours) for x in _pieces(texts)]
        return pa.array(np.round(np.concatenate(found), 6) if found else np.zeros(0), from_pandas=True, type=pa.float64())

    # only the texts go to Python; said not to be deterministic, it isn't worked out again for a filter on its result
    scored = docs.select(*columns, score.asNondeterministic()(docs["text"]).alias("quality_score"))
    return scored.withColumn("keep", F.coalesce(F.col("quality_score") >= threshold, F.lit(True)))
