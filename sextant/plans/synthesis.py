"""Queries that a language model, supplied by the caller, writes for sampled passages."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.projection import corpus_fingerprint, stratified_sample, usable_query
from sextant.plans.deep import Model
from sextant.sources.model import _fs

THREADS, SLICE, ANCHORS = 8, 1000, 5
_STYLE = "Describe in three lines how people who need these texts would word their questions."
_WRITE = "Write one question per line that the text answers, worded as described. No numbering."
_ROWS = "passage_idx long, query string, tokens_in long, tokens_out long"


def style_anchors(passages: DataFrame, model: Model) -> str:
    """One call over a few passages: how the questions should sound."""
    texts = [r.text[:600] for r in passages.orderBy("passage_idx").select("text").limit(ANCHORS).collect()]
    return model(_STYLE, "\n\n".join(texts))[0]


def written_queries(passages: DataFrame, model: Model, style: str) -> DataFrame:
    """``(passage_idx, query, tokens_in, tokens_out)``: one call for each passage, several at a time in each task; a passage that yields no
    line has one row with a null query, so that it isn't asked for again. Tokens stand at a passage's first row."""

    def ask(text: str | None) -> tuple[list[str | None], int, int]:
        reply, a, b = model(_WRITE, f"{style}\n\n{text or ''}")
        return [line.strip() for line in reply.split("\n") if line.strip()] or [None], a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                got = list(pool.map(ask, batch.column(1).to_pylist()))
                rows = [(i, q, a if k == 0 else 0, b if k == 0 else 0) for i, (qs, a, b) in zip(batch.column(0).to_pylist(), got) for k, q in enumerate(qs)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["passage_idx", "query", "tokens_in", "tokens_out"])

    return passages.select(F.col("passage_idx").cast("long").alias("passage_idx"), "text").mapInArrow(run, _ROWS)


def synthesised(passages: DataFrame, model: Model, folder: str, seed: int = 0, most: int | None = None) -> DataFrame:
    """``(passage_idx, query)`` for ``stratified_sample`` of ``passages`` (with texts), by passage and query.

    Rows are kept in ``folder`` under the corpus' fingerprint, a slice at a time: what a broken run has paid for isn't asked again."""
    spark = passages.sparkSession
    path = f"{folder}/{corpus_fingerprint(passages).first().fingerprint[:16]}-{seed}"
    sample = stratified_sample(passages, seed=seed, **({"most": most} if most else {})).select("passage_idx", "text")
    style = None
    while True:
        fs, p = _fs(spark, path)
        done = spark.read.schema(_ROWS).parquet(path) if fs.exists(p) else spark.createDataFrame([], _ROWS)
        todo = sample.join(done.select("passage_idx"), "passage_idx", "left_anti").orderBy("passage_idx").limit(SLICE)
        if todo.isEmpty():
            return done.where(usable_query("query")).select("passage_idx", F.trim("query").alias("query")).distinct()
        style = style or style_anchors(sample, model)
        written_queries(todo, model, style).write.mode("append").parquet(path)
