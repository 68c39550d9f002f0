"""Documents to packed training bins, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import line_dedup, mixing, near_duplicates, packing, quality
from sextant.llm.queries import MIX
from sextant.scratch import written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]

#: Patience alignment, graph search and greedy packing have no SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted on the labelled ones among them."""
    model = quality.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_quality(docs.select(*DOCUMENT), model).where("keep").select(*DOCUMENT)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; one that loses all its text goes."""
    rows = line_dedup.line_dedup(docs.select(*DOCUMENT))
    return rows.where(F.expr("removed_lines = 0 or trim(text) <> ''")).select(*DOCUMENT)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_duplicates.without_near_duplicates(docs.select(*DOCUMENT))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for."""
    return mixing.mixed(docs.select(*DOCUMENT), **MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which bin each piece of each document goes to."""
    return packing.pack_documents(docs.select(*DOCUMENT))


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
