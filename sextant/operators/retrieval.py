"""Hits with their citations: search, verification against the sources as they are now, confidence."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions.text import content_hash, in_parts, text_slice
from sextant.operators.blocks import best_of
from sextant.scratch import written

CITATION = ["passage_idx", "source_file", "char_offset", "char_length", "content_hash", "passage_id"]
STATUSES = ("verified", "drifted", "missing")
#: Hits up to which they are broadcast to the registry and the sources instead of being shuffled with them.
BROADCAST_HITS = 200_000


def small(df: DataFrame, count: int, most: int = BROADCAST_HITS) -> DataFrame:
    """``df`` marked for a broadcast if its checked ``count`` allows."""
    return F.broadcast(df) if count <= most else df


def drift_status(text: Column | str, char_offset: Column | str, char_length: Column | str, known: Column | str) -> Column:
    """Whether the slice of the current text still has the known hash; ``missing`` without a text."""
    text = F.col(text) if isinstance(text, str) else text
    known = F.col(known) if isinstance(known, str) else known
    same = content_hash(text_slice(text, char_offset, char_length)) == known
    return F.when(text.isNull(), "missing").when(same, "verified").otherwise("drifted")


def verified(passages: DataFrame, sources: DataFrame, texts_too: bool = True) -> DataFrame:
    """``passages`` with ``drift_status`` and ``text`` (empty unless verified, or without ``texts_too``). ``sources`` has one row per ``source_file``; where it
    has a column ``drifted``, a file so marked, which isn't the one pinned, has drifted as a whole.

    The passages of a file, without its text, are gathered first, so each text is joined once, and decoded once: cutting it by
    expressions would look for each passage from the text's start."""
    pinned = F.coalesce("drifted", F.lit(False)) if "drifted" in sources.columns else F.lit(False)
    now = sources.select(F.col("source_file").alias("now_file"), F.col("text").alias("now_text"), pinned.alias("now_other"))
    columns = [c for c in passages.columns if c not in ("drift_status", "text")]
    own = [c for c in columns if c != "source_file"]
    gathered = passages.groupBy("source_file").agg(F.collect_list(F.struct(*own)).alias("own_"))
    joined = gathered.join(now, gathered["source_file"] == F.col("now_file"), "left").select("source_file", "own_", "now_text", "now_other")
    at, many, known = (own.index(c) for c in ("char_offset", "char_length", "content_hash"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 2):
            lists, texts, other = batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            row, flat = pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())), lists.flatten()
            states, cuts = [], []
            for i, lo, n, hash_ in zip(row.to_pylist(), *(flat.field(k).to_pylist() for k in (at, many, known))):
                text = texts[i]
                cut = "" if text is None or lo is None or n is None else text[lo : lo + n]
                same = text is not None and not other[i] and "sha256:" + sha256(cut.encode()).hexdigest() == hash_
                states.append("missing" if text is None else "verified" if same else "drifted")
                cuts.append(cut if same and texts_too else "")
            parts = [batch.column(0).take(row) if c == "source_file" else flat.field(own.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(states, pa.string()), pa.array(cuts, pa.string())], [*columns, "drift_status", "text"])

    return joined.mapInArrow(check, T.StructType([*(passages.schema[c] for c in columns), T.StructField("drift_status", T.StringType()), T.StructField("text", T.StringType())]))


def search(passages: DataFrame, queries: DataFrame, k: int = 10, dedup: bool = True, vector: str = "vector", hits_at_most: int | None = None) -> DataFrame:
    """``(query_id, rank, score, citation columns)`` of each query's ``k`` best passages. See ``best_of``.

    Only found rows are joined with the registry."""
    hits = best_of(passages, queries, k, dedup, vector)
    count = hits_at_most if hits_at_most is not None else k * queries.count()
    if count > BROADCAST_HITS:
        hits = written(hits, "hits")  # more than one table may come of them
    return passages.select(*CITATION).join(small(hits, count), "passage_idx").select("query_id", "rank", "score", *CITATION)


def verify_hits(hits: DataFrame, sources: DataFrame, count: int | None = None) -> DataFrame:
    """``hits`` with ``drift_status`` and ``text``; none is dropped."""
    files = hits.select("source_file").distinct()
    if count is not None:
        files = small(files, count)
    return verified(hits, sources.join(files, "source_file", "left_semi"))


def verified_only(hits: DataFrame) -> DataFrame:
    return hits.where("drift_status = 'verified'")


def confidence(hits: DataFrame) -> DataFrame:
    """``(query_id, n_hits, top1_score, top1_top2_gap, source_diversity, drift_fraction)`` of verified hits.

    A single hit has a gap of 1. Queries without a hit have no row; ``with_all_queries`` adds zeros."""
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"),
        top.alias("top1_score"),
        F.round(F.coalesce(top - second, F.lit(1.0)), 6).alias("top1_top2_gap"),
        F.round(F.count_distinct("source_file") / F.count("*"), 6).alias("source_diversity"),
        F.round(F.avg((F.col("drift_status") != "verified").cast("double")), 6).alias("drift_fraction"),
    )


def with_all_queries(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.select("query_id").join(metrics, "query_id", "left").fillna(0)


def evidence(passages: DataFrame, sources: DataFrame, queries: DataFrame, k: int = 10, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Verified hits by exact search, and their confidence per query."""
    count = k * queries.count()
    hits = verify_hits(search(passages, queries, k, vector=vector, hits_at_most=count), sources, count)
    return hits, with_all_queries(confidence(hits), queries)


def locate(passages: DataFrame, wanted: int | DataFrame) -> DataFrame:
    """The citation of one passage; raises ``IndexError`` if there is none. Of a table's ``passage_idx``: those that there are."""
    if isinstance(wanted, DataFrame):
        return passages.select(*CITATION).join(wanted.select("passage_idx").distinct(), "passage_idx", "left_semi")
    row = passages.where(F.col("passage_idx") == wanted).select(*CITATION)
    if row.isEmpty():
        raise IndexError(wanted)
    return row


def neighbors(passages: DataFrame, wanted: int | DataFrame, k: int = 10, vector: str = "vector") -> DataFrame:
    """``(rank, passage_idx, score)`` of the nearest other passages, places repeated. ``IndexError`` if there is no such passage.
    For a table's ``passage_idx``, ``query_id`` says whose they are; those that aren't there have none."""
    many = isinstance(wanted, DataFrame)
    own = passages.join(wanted.select("passage_idx").distinct(), "passage_idx", "left_semi") if many else passages.where(F.col("passage_idx") == wanted)
    own = own.select(F.col("passage_idx").alias("query_id"), F.col(vector).alias("vector"))
    if not many and own.isEmpty():
        raise IndexError(wanted)
    if k <= 0:
        return best_of(passages, own, 0, False, vector).select(*["query_id"] * many, "rank", "passage_idx", "score")
    near = best_of(passages, own, k + 1, False, vector).where("passage_idx <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(*["query_id"] * many, "rank", "passage_idx", "score")


def profile(passages: DataFrame) -> DataFrame:
    """``(source_file, n_passages)``; the whole has as many rows as files."""
    return passages.groupBy("source_file").agg(F.count("*").alias("n_passages"))


def drift_report(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of all passages with their ``drift_status``."""
    return verified(passages.select(*CITATION), sources, False).drop("text")


def drift_counts(report: DataFrame) -> DataFrame:
    """``(drift_status, n)`` with all three states."""
    states = report.sparkSession.createDataFrame([(s,) for s in STATUSES], "drift_status string")
    return states.join(report.groupBy("drift_status").agg(F.count("*").alias("n")), "drift_status", "left").fillna(0)


def deduplicated(hits: DataFrame, *order: Column | str) -> DataFrame:
    """The first hit of each ``(query_id, source_file, char_offset)``, by default the best."""
    w = Window.partitionBy("query_id", "source_file", "char_offset").orderBy(*(order or (F.desc("score"), "passage_idx")))
    return hits.withColumn("at_", F.row_number().over(w)).where("at_ = 1").drop("at_")


def fused(hits: DataFrame) -> DataFrame:
    """Hits of several wordings of a question (``variant``) as one list: each place once, as the first wording found it."""
    first = deduplicated(hits, "variant", "rank")
    order = Window.partitionBy("query_id").orderBy("variant", "rank")
    return first.withColumn("place", F.row_number().over(order))
