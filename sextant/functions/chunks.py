"""Passages of a text: paragraphs, merged where short and cut at sentences where long."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import content_hash, in_parts, passage_id, text_slice

LEAST, MOST = 200, 3200
_GAP = re.compile(r"\n[ \t]*\n+")
_STOP = re.compile(r"(?<=[.!?])\s+")


def _between(breaks: re.Pattern, text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, end with the break after it) of each part."""
    at = 0
    for m in breaks.finditer(text):
        yield at, m.start(), m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text), len(text)


def _sentences(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Sentences with the space after them, packed up to ``most``; one that is longer is cut every ``most`` characters."""
    lo = hi = 0
    for start, _, end in _between(_STOP, text):
        if hi > lo and end - lo > most:
            yield lo, hi
            lo = start
        while end - lo > most:
            yield lo, lo + most
            lo += most
            if lo + most >= end:  # what is left of a long sentence stands alone
                yield lo, end
                lo = end
        hi = end
    if hi > lo:
        yield lo, hi


def chunk_spans(text: str | None, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """``(offset, length)`` of the passages, in order and without overlap.

    A text of white space has none. Paragraphs end at blank lines. One of ``least`` to ``most`` characters is a passage;
    a longer one is cut at sentences; shorter ones run together, gaps included, until they have ``least``, while they fit into
    ``most``. A short end is a passage too."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    run: tuple[int, int] | None = None
    for lo, hi, _ in _between(_GAP, text):
        if lo == hi:
            continue
        whole = hi - lo
        if run and (whole > most or whole >= least or hi - run[0] > most):
            out.append(run)
            run = None
        if whole > most:
            out += [(lo + a, lo + b) for a, b in _sentences(text[lo:hi], most)]
        elif whole >= least:
            out.append((lo, hi))
        else:
            run = (run[0] if run else lo, hi)
            if hi - run[0] >= least:
                out.append(run)
                run = None
    if run:
        out.append(run)
    return [(a, b - a) for a, b in out]


def chunk(files: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``(source_file, char_offset, char_length)`` of every passage of ``files`` (``source_file``, ``text``). Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [chunk_spans(t, least, most) for t in batch.column(1).to_pylist()]
            row = pa.array([i for i, s in enumerate(spans) for _ in s], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([a for s in spans for a, _ in s], pa.int32()), pa.array([n for s in spans for _, n in s], pa.int32())], ["source_file", "char_offset", "char_length"])

    return files.select("source_file", "text").mapInArrow(run, "source_file string, char_offset int, char_length int")


def candidates(files: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``(source_file, char_offset, char_length, content_hash, passage_id, text)``: passages with their texts and identities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            texts = batch.column(1).to_pylist()
            spans = [chunk_spans(t, least, most) for t in texts]
            row = pa.array([i for i, s in enumerate(spans) for _ in s], pa.int64())
            cuts = [texts[i][a : a + n] for i, s in enumerate(spans) for a, n in s]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([a for s in spans for a, _ in s], pa.int32()), pa.array([n for s in spans for _, n in s], pa.int32()), pa.array(cuts, pa.string())], ["source_file", "char_offset", "char_length", "text"])

    cut = files.select("source_file", "text").mapInArrow(run, "source_file string, char_offset int, char_length int, text string")
    return cut.select("source_file", "char_offset", "char_length", content_hash("text").alias("content_hash"), passage_id("source_file", "char_offset", "char_length").alias("passage_id"), "text")


def registry(files: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``candidates`` with ``passage_idx``: a running number in order of file and offset, without a sort of the whole in one task."""
    return numbered(candidates(files, least, most), ["source_file", "char_offset"])


def numbered(df: DataFrame, order: list[str], name: str = "passage_idx") -> DataFrame:
    """``df`` with a running number from 0 in the given order.

    Rows are range-partitioned; each partition's count shifts the numbers of those after it."""
    from pyspark.sql import Window

    from sextant.scratch import written

    columns = [c for c in df.columns if c != name]
    placed = written(df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()), "numbered")
    starts = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    starts = starts.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("start_"))
    row = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return placed.join(F.broadcast(starts), "part_").select((F.col("start_") + row - 1).alias(name), *columns)


__all__ = ["LEAST", "MOST", "candidates", "chunk", "chunk_spans", "numbered", "registry", "text_slice"]
