"""Continuous upkeep: documents as they arrive, memories as they are told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.functions.chunks import candidates
from sextant.operators.delta import apply_delta
from sextant.sources.encoders import Encoder, encode_with
from sextant.sources.model import KnowledgeModel, read, write


def latest(batch: DataFrame) -> DataFrame:
    """``(source_file, text)``: of a file that repeats, the row of the latest ``modified``."""
    return batch.groupBy("source_file").agg(F.max_by("text", F.struct("modified", "text")).alias("text"))


def refreshed(km: KnowledgeModel, files: DataFrame, encoder: Encoder) -> KnowledgeModel:
    """``km`` with the passages of ``files`` renewed; a null text takes a file out. The same files again change nothing."""
    from dataclasses import replace

    from sextant.functions.chunks import numbered

    own = km.passages.join(files.select("source_file"), "source_file", "left_semi")
    rest = km.passages.join(files.select("source_file"), "source_file", "left_anti")
    renewed = apply_delta(own, candidates(files), encode_with(encoder))
    columns = [c for c in renewed.columns if c != "passage_idx"]
    return replace(km, passages=numbered(rest.select(*columns).unionByName(renewed.select(*columns)), ["source_file", "char_offset", "passage_id"]))


def maintain(stream: DataFrame, path: str, encoder: Encoder, checkpoint: str, on_batch: Callable[[int, int], None] | None = None, **trigger) -> StreamingQuery:
    """Keeps the local-mode model at ``path`` up to date with a stream of ``(source_file, text, modified)``.

    A batch that is replayed after a failure finds its passages unchanged, so the result is the same."""
    if not trigger:
        trigger = {"availableNow": True}

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = write(refreshed(read(spark, path), latest(batch), encoder), path)
        if on_batch:
            on_batch(number, version)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def told_once(memories: DataFrame, within: str = "1 hour") -> DataFrame:
    """A stream of ``(text, created, ...)`` without texts repeated ``within`` that time; state older than that is let go."""
    rows = memories.withColumn("text_hash", F.sha2("text", 256)).withWatermark("created", within)
    return rows.dropDuplicatesWithinWatermark(["text_hash"])


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream's events with a watermark, which wants times with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, event_type, n, total)`` per tumbling window; as a stream, events later than ``late`` are left out."""
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(user_id, start, n)`` per run of a user's events with gaps below ``gap``."""
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
