"""The tables of a data folder as passages, sources, memories and trials."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import content_hash, passage_id

URL_BASE = "https://texts.example.org/v1"
NOW = "2024-01-31T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def other_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same corpus after an edit: entries of the upper half of the labels are moved by one place."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.concat(F.slice("embedding", F.lit(2), F.size("embedding") - 1), F.slice("embedding", 1, 1))
    return rows.select(F.col("vec_id").alias("id"), F.when(F.col("label") >= 5, moved).otherwise(F.col("embedding")).alias("vector"))


def by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose places repeat: a file for each label, twenty offsets."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("passage_idx"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("source_file"), F.pmod("vec_id", F.lit(20)).cast("int").alias("char_offset"), F.col("embedding").alias("vector"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query."""
    return vectors(spark, sf_dir).select(F.col("id").alias("query_id"), "vector")


#: Searches that one passage at a time would be asked for take as queries the rows whose id this divides.
EVERY = 50


def asked_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query, by its id."""
    return asked(spark, sf_dir).where(F.col("query_id") % EVERY == 0)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"), F.coalesce("text", F.lit("")).alias("text"))


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents later on: those of one source are withdrawn, those of another changed."""
    docs = table(spark, sf_dir, "documents").where("source <> 'src3' or source is null")
    text = F.when(F.col("source") == "src5", F.replace("text", F.lit("e"), F.lit("3"))).otherwise(F.col("text"))
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"), F.coalesce(text, F.lit("")).alias("text"))


def edited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edited_documents``, and web pages that have come."""
    old = edited_documents(spark, sf_dir)
    new = table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("source_file"), F.coalesce("html", F.lit("")).alias("text"))
    return old.unionByName(new)


def whole(files: DataFrame) -> DataFrame:
    """Each file as one passage, with its text."""
    size = F.length("text")
    return files.select("source_file", F.lit(0).alias("char_offset"), size.alias("char_length"), content_hash("text").alias("content_hash"), passage_id("source_file", F.lit(0), size).alias("passage_id"), "text")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a passage."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_idx"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("passage_idx", *whole(docs).columns[:1], F.lit(0).alias("char_offset"), F.length("text").alias("char_length"), content_hash("text").alias("content_hash"), passage_id("source_file", F.lit(0), F.length("text")).alias("passage_id"))


def passages(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """Every document as a passage with a vector, or one of ``other_vectors``; there being fewer vectors, they are given out in turn."""
    v = (other_vectors if edited else vectors)(spark, sf_dir)
    turn = F.pmod("passage_idx", F.lit(max(1, v.count())))
    return cited(spark, sf_dir).withColumn("id", turn).join(v, "id").drop("id")


def fetch(url: str) -> bytes:
    """A web where every address tells its name, but those that end in 7 are gone."""
    if url.endswith("7"):
        raise OSError("gone")
    return f"text of {url}".encode()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").join(texts(spark, sf_dir).withColumnRenamed("id", "vec_id"), "vec_id", "left")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    label = F.col("label")
    return rows.select(
        F.col("vec_id").alias("memory_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        (0.5 + label / 10).alias("salience"),
        F.concat(F.lit("label_"), label.cast("string")).alias("source_id"),
        F.concat(F.lit("s"), label.cast("string")).alias("session"),
        at.alias("created_utc"),
        F.when(label < 3, "working").when(label < 7, "episodic").otherwise("semantic").alias("tier"),
        F.lit(1).cast("long").alias("recurrence_count"),
        F.col("embedding").alias("vector"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers that were judged."""
    e = table(spark, sf_dir, "events")
    k = F.pmod(F.floor("value"), F.lit(5))
    verdict = F.when(k == 0, "correct").when(k == 1, "partial").when(k == 2, "wrong").when(k == 3, "refused")
    second = F.when(k == 4, "correct").when(k == 0, "correct").when(k == 1, "refused")
    return e.select(
        F.col("event_id").alias("trial_id"),
        F.col("event_type").alias("approach"),
        F.when(F.pmod("user_id", F.lit(4)) == 0, "distractor").otherwise("answerable").alias("kind"),
        verdict.alias("verdict"),
        verdict.alias("verdict1"),
        second.alias("verdict2"),
        (F.pmod("user_id", F.lit(4)) + 1).cast("int").alias("tier"),
        (F.col("value") / 1000).alias("cost_usd"),
        F.col("value").alias("wall_seconds"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("It doesn't cover "), "props")).otherwise(F.col("props")).alias("answer"),
    )


def weights(rows: int = 16, columns: int = 64) -> list[list[float]]:
    """A fixed projection."""
    return [[math.sin(i * columns + j + 1) for j in range(columns)] for i in range(rows)]
