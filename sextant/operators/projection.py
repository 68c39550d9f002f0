"""A learned projection of the vectors: samples, hard negatives, training, and what it is worth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.blocks import best_of

PER_FILE, SAMPLE = 3, 6000
NEGATIVES, POOL = 7, 64
DIMS = (64, 128, 256, 512)
STEPS, BATCH, RATE, TEMPERATURE = 250, 128, 5e-4, 0.02
#: Dollars a million tokens in and out, tokens a passage in and out.
PRICE_IN, PRICE_OUT = 1.0, 5.0
TOKENS_IN, TOKENS_OUT = 900, 120


def _drawn(seed: int, *columns: str) -> Column:
    """A seeded order: hexadecimal digits."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)), 256)


def stratified_sample(passages: DataFrame, per_file: int = PER_FILE, most: int = SAMPLE, seed: int = 0) -> DataFrame:
    """``passages``: at most ``per_file`` of each file, and ``most`` in all, by a seeded hash of the index."""
    rows = passages.withColumn("draw_", _drawn(seed, "passage_idx"))
    each = F.row_number().over(Window.partitionBy("source_file").orderBy("draw_", "passage_idx"))
    rows = rows.withColumn("at_", each).where(F.col("at_") <= per_file)
    return rows.orderBy("draw_", "passage_idx").limit(most).drop("draw_", "at_")


def usable_query(query: Column | str) -> Column:
    """Trimmed, of 10 to 400 characters, and not about "the passage"."""
    q = F.trim(F.col(query) if isinstance(query, str) else query)
    return F.length(q).between(10, 400) & ~F.contains(F.lower(F.substring(q, 1, 40)), F.lit("passage"))


def corpus_fingerprint(rows: DataFrame) -> DataFrame:
    """One row ``(fingerprint, n)`` of ``(source_file, char_offset, text)``, whatever their order.

    Each row is hashed where it lies; the sum of the hashes' 13-digit parts, which the number of rows and any row changes, is
    combined across tasks, so that nothing is gathered."""
    one = F.sha2(F.concat_ws("\x1f", F.coalesce("source_file", F.lit("")), F.coalesce(F.col("char_offset").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substring(one, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(5)]
    sums = rows.agg(F.count("*").alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws("\x1e", F.col("n").cast("string"), *(F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in range(5))), 256).alias("fingerprint"), "n")


def hard_negatives(queries: DataFrame, passages: DataFrame, pool: int = POOL, n: int = NEGATIVES, seed: int = 0) -> DataFrame:
    """``(query_id, place, passage_idx)``: ``n`` of each query's ``pool`` nearest passages without its own (``positive``), by a
    seeded order; fewer are repeated in turn. Queries without any are left out."""
    near = best_of(passages, queries, pool, False)
    own = queries.select("query_id", F.col("positive").alias("passage_idx"))
    rows = near.join(own, ["query_id", "passage_idx"], "left_anti").withColumn("draw", _drawn(seed, "query_id", "passage_idx"))
    lists = rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "passage_idx"))), lambda x: x["passage_idx"]).alias("all_"))
    taken = lists.select("query_id", F.slice("all_", 1, n).alias("all_"))
    return taken.select("query_id", "all_", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place")).select("query_id", "place", F.get("all_", F.pmod("place", F.size("all_"))).alias("passage_idx"))


def cost_usd(tokens_in: Column | float, tokens_out: Column | float):
    return (tokens_in * PRICE_IN + tokens_out * PRICE_OUT) / 1e6


def estimated_cost(passages: int) -> float:
    """Dollars for one call a passage and one for the style."""
    return cost_usd((passages + 1) * TOKENS_IN, (passages + 1) * TOKENS_OUT)


def estimated_seconds(passages: int, queries: int, device: str = "cpu") -> float:
    rate = {"cuda": 600.0, "cpu": 40.0}[device]
    return (passages + queries) / rate + STEPS * (0.02 if device == "cuda" else 0.5)


@dataclass
class Trained:
    weights: np.ndarray
    losses: list[float]
    recall: float
    stopped: str


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    return x / norm, norm


def loss_and_slope(w: np.ndarray, q: np.ndarray, p: np.ndarray, neg: np.ndarray, dims: tuple[int, ...], temperature: float = TEMPERATURE) -> tuple[float, np.ndarray]:
    """Contrastive loss over nested prefixes of the projected vectors, and its derivative by ``w``.

    A query's passage competes with the batch's other passages and its own negatives."""
    n = len(q)
    docs = np.concatenate([p, neg.reshape(-1, neg.shape[-1])])
    total, slope = 0.0, np.zeros_like(w)
    own = np.arange(n)
    for d in dims:
        zq, zd = q @ w[:d].T, docs @ w[:d].T
        uq, nq = _unit(zq)
        ud, nd = _unit(zd)
        s = uq @ ud.T / temperature
        mask = np.zeros_like(s, bool)  # of the negatives only a query's own count
        mask[:, n:] = np.repeat(own, neg.shape[1])[None, :] != own[:, None]
        s[mask] = -np.inf
        top = s.max(1, keepdims=True)
        e = np.exp(s - top)
        prob = e / e.sum(1, keepdims=True)
        total += float((top[:, 0] + np.log(e.sum(1)) - s[own, own]).mean())
        prob[own, own] -= 1
        g = prob / (n * temperature)
        gq, gd = g @ ud, g.T @ uq
        gq = (gq - uq * (gq * uq).sum(1, keepdims=True)) / nq
        gd = (gd - ud * (gd * ud).sum(1, keepdims=True)) / nd
        slope[:d] += gq.T @ q + gd.T @ docs
    return total / len(dims), slope / len(dims)


def train(q: np.ndarray, p: np.ndarray, positive: np.ndarray, negatives: np.ndarray, dims: tuple[int, ...] = DIMS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0, held_out: float = 0.1, progress: Callable[[int, float], None] | None = None) -> Trained:
    """Fits the projection on the driver: queries and passages are the bounded sample of ``stratified_sample``.

    Stops early if by step 100 fewer than a fifth of the held-out queries find their passage, or after 60 steps without gain,
    unless the loss is below 0.01 already."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(q))
    dev, fit = order[: max(1, int(held_out * len(q)))], order[max(1, int(held_out * len(q))) :]
    d = min(max(dims), q.shape[1])
    dims = tuple(x for x in dims if x <= d) or (d,)
    w = np.linalg.qr(rng.standard_normal((q.shape[1], d)))[0].T.copy()
    m, v, losses, best, since, stopped = np.zeros_like(w), np.zeros_like(w), [], (np.inf, w.copy()), 0, ""
    for step in range(1, steps + 1):
        rows = rng.choice(fit, min(batch, len(fit)), replace=False)
        loss, g = loss_and_slope(w, q[rows], p[positive[rows]], p[negatives[rows]], dims)
        losses.append(loss)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 0.01 * w)
        since = 0 if loss < best[0] - 1e-4 else since + 1
        if loss < best[0]:
            best = loss, w.copy()
        if progress:
            progress(step, loss)
        if best[0] >= 0.01:
            if step == 100 and recall_at_1(w, q[dev], p, positive[dev]) < 0.2:
                stopped = "recall"
            elif since >= 60:
                stopped = "no gain"
            if stopped:
                break
    return Trained(best[1].astype(np.float32), losses, recall_at_1(best[1], q[dev], p, positive[dev]), stopped)


def recall_at_1(w: np.ndarray, q: np.ndarray, p: np.ndarray, positive: np.ndarray) -> float:
    if not len(q):
        return 0.0
    s = _unit(q @ w.T)[0] @ _unit(p @ w.T)[0].T
    return float((s.argmax(1) == positive).mean())


def with_projection(passages: DataFrame, weights: np.ndarray, vector: str = "vector", name: str = "optimised") -> DataFrame:
    """``passages`` with each vector projected and at length one, a matrix product per batch."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import types as T

    from sextant.operators.blocks import matrix

    columns = [c for c in passages.columns if c != name]
    shared = passages.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            v = batch.column(columns.index(vector))
            some = v.is_valid()
            out = [None] * len(v)
            if some.true_count:
                z = _unit(matrix(v.filter(some)) @ w.T)[0]
                for i, x in zip(np.flatnonzero(some.to_numpy(False)), z):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*columns, name])

    schema = T.StructType([*passages.select(*columns).schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return passages.select(*columns).mapInArrow(run, schema)
