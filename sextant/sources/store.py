"""The texts behind a model, wherever they are kept, and memories on disk."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.memory import SCHEMA, TIERS, checked
from sextant.sources import files, remote
from sextant.sources.model import KnowledgeModel, _put, claimed, current


def local_texts(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """``(source_file, text)`` of some files below ``root``; those that aren't there have no row, and none outside is read."""
    paths = [p for p in (files.resolve_inside(root, n) for n in names) if os.path.isfile(p)]
    if not paths:
        return spark.createDataFrame([], "source_file string, text string")
    return files.walk(spark, paths, root, tuple({os.path.splitext(p)[1].lstrip(".") for p in paths}))[0]


def open_sources(km: KnowledgeModel, source_root: str | None = None, opener: remote.Opener = remote.open_url, only: list[str] | None = None) -> DataFrame:
    """``(source_file, text)`` as the texts are now; ``only`` names the few files wanted. Remote texts have a third column,
    ``drifted``, where their hash isn't the one pinned: no passage of such a file counts as verified.

    Local texts need a root, given or recorded, remote ones a manifest with entries; else ``ValueError``."""
    spark = km.passages.sparkSession
    if km.mode == "bundled":
        rows = km.sources.select("source_file", "text")
        return rows if only is None else rows.where(F.col("source_file").isin(*only))
    if km.mode == "remote":
        pins = km.manifest if only is None else km.manifest.where(F.col("source_file").isin(*only))
        if km.manifest.isEmpty():
            raise ValueError("the manifest is empty")
        return remote.against_pins(remote.fetched(pins, opener), pins)
    root = source_root or km.metadata.get("build_config", {}).get("root")
    if not root:
        raise ValueError("local texts need a source root")
    if only is not None:
        return local_texts(spark, root, only)
    known = km.passages.select("source_file").distinct()
    return files.walk(spark, [root], root, tuple(km.metadata.get("build_config", {}).get("extensions") or files.EXTENSIONS))[0].join(known, "source_file", "left_semi")


def read_memory(spark: SparkSession, root: str) -> DataFrame:
    """All tiers; none if there is nothing yet."""
    version = current(spark, root)
    if version < 0:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{root}/v={version}")


def write_memory(memory: DataFrame, root: str) -> int:
    """The next version, a folder a tier, then the pointer: a crash between leaves the old one whole."""
    spark = memory.sparkSession
    version = claimed(spark, root)
    memory.write.mode("overwrite").partitionBy("tier").parquet(f"{root}/v={version}")
    _put(spark, f"{root}/CURRENT", str(version))
    return version


def append_memory(entries: DataFrame, root: str) -> int:
    """New entries beside those that there are, which stay as they lie; the first ones make a version. An unknown tier fails."""
    spark = entries.sparkSession
    entries, version = checked(entries), current(spark, root)
    if version < 0:
        return write_memory(entries, root)
    entries.write.mode("append").partitionBy("tier").parquet(f"{root}/v={version}")
    return version


def replace_tier(entries: DataFrame, tier: str, root: str) -> int:
    """The next version, in which one tier holds ``entries`` alone and the others what they held."""
    if tier not in TIERS:
        raise ValueError(f"no such tier: {tier}")
    rest = read_memory(entries.sparkSession, root).where(F.col("tier") != tier)
    return write_memory(rest.unionByName(entries.withColumn("tier", F.lit(tier)).select(*rest.columns)), root)
