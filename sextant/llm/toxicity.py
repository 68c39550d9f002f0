"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.sample import fitted, labelled_sample

ORDERS = (3, 4, 5)
BITS = 18
MAX_LABELLED = 4096
THRESHOLD = 0.5
LENGTH = 10.0


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the character n-grams of a text (lower case, each run of white space one blank, a blank at both ends), hashed to
    ``2 ** BITS``, in rising order, and how often each occurs."""
    c = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    g = np.empty(sum(max(0, len(c) - n + 1) for n in ORDERS), np.uint32)
    h, at = c, 0
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193)
        h += c[n - 1 :]
        if n in ORDERS and len(h):
            out = g[at : at + len(h)]
            np.multiply(h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF), np.uint32(0x85EBCA6B), out=out)
            at += len(h)
        if not len(h):
            break
    g = g[:at] >> np.uint32(32 - BITS)
    g.sort()
    ends = np.append(np.flatnonzero(g[1:] != g[:-1]), len(g) - 1) if len(g) else np.zeros(0, np.int64)
    return g[ends], np.diff(ends, prepend=-1)


def _shares(n: np.ndarray) -> np.ndarray:
    """Counts at length ``LENGTH``: a long text counts no more than a short one, and what it says often more than what it says once."""
    x = n.astype(np.float64)
    return x * (LENGTH / np.sqrt(max(1.0, float(x @ x))))


class _Table:
    """A sparse matrix by rows and by columns, for products with vectors; all in single precision, as they steer steps only."""

    def __init__(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        order = np.argsort(col, kind="stable")
        self.sides = [self._side(row, col, x), self._side(col[order], row[order], x[order])]

    @staticmethod
    def _side(major: np.ndarray, minor: np.ndarray, x: np.ndarray) -> tuple:
        starts = np.flatnonzero(np.concatenate([[True], major[1:] != major[:-1]])) if len(major) else np.zeros(0, np.int64)
        return major[starts], starts, minor.astype(np.int32), x.astype(np.float32)

    def times(self, v: np.ndarray, turned: bool = False) -> np.ndarray:
        """The product with ``v``, or, ``turned``, that of the transpose."""
        at, starts, minor, x = self.sides[turned]
        out = np.zeros(self.shape[turned])
        if len(starts):
            out[at] = np.add.reduceat(v.astype(np.float32)[minor] * x, starts)
        return out


def ratios(places: np.ndarray, value: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The naive Bayes log-count ratio of each place: its smoothed sum of shares a toxic text against that a text of the others."""
    least = value.mean() if len(value) else 1.0
    total = np.bincount(places, weights=value, minlength=1 << BITS)
    p = np.bincount(places[toxic], weights=value[toxic], minlength=1 << BITS)
    return np.log((p + least) / y.sum()) - np.log((np.maximum(total - p, 0) + least) / (1 - y).sum())


def fit(texts: pa.Array, labels: np.ndarray, steps: int = 40, penalty: float = 1.0) -> dict[str, np.ndarray]:
    """Weights by hashed n-gram and the intercept.

    The log-count ratio r of an n-gram compares its smoothed share among toxic and other texts; a logistic regression with
    both classes of equal weight runs over shares times r, by accelerated gradient steps as long as the loss's largest curvature allows."""
    y = labels.astype(np.float64)
    if y.min() == y.max():
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": np.array([60.0 if y.max() else -60.0])}
    rows = [grams(t) for t in texts.to_pylist()]
    row = np.repeat(np.arange(len(y)), [len(g) for g, _ in rows])
    places = np.concatenate([g for g, _ in rows]).astype(np.int64)
    value = np.concatenate([_shares(n) for _, n in rows])
    ratio = ratios(places, value, y[row] == 1, y)
    used = np.flatnonzero((np.bincount(places, minlength=1 << BITS) >= 3) & (np.abs(ratio) > 0.1))
    index = np.full(1 << BITS, -1)
    index[used] = np.arange(len(used))
    col = index[places]
    r = ratio[used]
    row, value, col = row[col >= 0], value[col >= 0], col[col >= 0]
    x = _Table(row, col, r[col] * value, (len(y), len(used)))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    v, vb, most = np.full(len(used), 1.0), 1.0, 1.0
    for _ in range(10):  # the largest curvature, by powers
        norm = np.sqrt(v @ v + vb * vb) or 1.0
        u = weight * (x.times(v / norm) + vb / norm)
        v, vb = x.times(u, True), u.sum()
        most = np.sqrt(v @ v + vb * vb)
    step = 1.0 / (0.25 * 1.1 * most + penalty / len(y))
    w, bias, pw, pb, t = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0, 1.0
    for _ in range(steps):
        z = x.times(w) + bias
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        nw = w - step * (x.times(slope, True) + penalty / len(y) * w)
        nb = bias - step * slope.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, bias, pw, pb, t = nw + (t - 1) / nt * (nw - pw), nb + (t - 1) / nt * (nb - pb), nw, nb, nt
    out = np.zeros(1 << BITS, np.float32)
    out[used] = pw * r
    return {"weights": out, "bias": np.array([pb])}


def scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    def one(text: str) -> float:
        g, n = grams(text)
        return float((weights[g] * _shares(n)).sum(dtype=np.float64))

    z = np.array([one(t) for t in texts]) + bias
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def toxicity_model(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7) -> dict[str, np.ndarray]:
    """Trained on at most ``max_labelled`` labelled documents; empty without any."""
    return fitted(labelled_sample(docs, labels, "toxic", max_labelled, seed), fit)


def toxicity(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, toxic_score, toxic)`` for every row of ``docs``, from its whole text.

    A text that is null or blank scores 0; without labels every score is null and nothing is toxic. Rows without an id and
    rows that repeat are scored like any other. Other columns are not read. An empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not model:
        return rows.select("doc_id", F.lit(None).cast("double").alias("toxic_score"), F.lit(False).alias("toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1)
            blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(pc.fill_null(texts, ""))), 0).to_numpy(False)
            s = np.where(blank, 0.0, scores([x or "" for x in texts.to_pylist()], m["weights"], float(m["bias"][0])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(s, 6)), pa.array(s >= threshold)], ["doc_id", "toxic_score", "toxic"])

    return rows.mapInArrow(score, "doc_id long, toxic_score double, toxic boolean")
