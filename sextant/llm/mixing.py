"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.scratch import written

#: Sources up to which their few numbers are broadcast to the documents; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_epochs(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, max_epochs: float = 2.0, budget: float | None = None) -> DataFrame:
    """``(source, chars, weight, allotted, epochs)`` for every source.

    Of ``budget`` characters (as many as there are, if None) each source is due its share by weight, at most ``max_epochs``
    times its own; what that cuts off is divided among the others in proportion, and so on. The fixed point is a water level:
    with sources in order of capacity / weight, a prefix is filled and the rest stand at one level.

    A null source is a source of its own, of ``default_weight``. Sources of weight 0 or of no characters get 0 epochs."""
    named = F.create_map(*(F.lit(x) for kv in (weights or {}).items() for x in kv)) if weights else None
    weight = F.coalesce(named[F.col("source")], F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    sizes = sizes.select("source", "chars", weight.alias("weight")).withColumn("cap", F.col("chars") * F.lit(float(max_epochs)))
    real = (F.col("chars") > 0) & (F.col("weight") > 0)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = sizes.where(real).select(
        "*",
        (F.lit(float(budget)) if budget is not None else F.sum("chars").over(whole).cast("double")).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(after).alias("open"),
    ).withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open"))
    # what a level pours out is concave in it, so each segment's line lies above: the true level is the highest of theirs
    level = level.withColumn("water", F.max("level").over(whole))
    shares = level.select("source", "chars", "weight", F.least(F.col("water") * F.col("weight"), F.col("cap")).alias("allotted"))
    rest = sizes.where(~real).select("source", "chars", "weight", F.lit(0.0).alias("allotted"))
    return shares.unionByName(rest).withColumn("epochs", F.when(F.col("chars") > 0, F.col("allotted") / F.col("chars")).otherwise(0.0))


def with_copies(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """``docs`` with ``copies``: the whole epochs of its source, and one more where the document's seeded hash in [0, 1) lies below
    the fraction. Options are those of ``source_epochs``.

    Rows that repeat an id share its hash; a null id hashes like an empty one. Empty and null texts are drawn like any other and
    add nothing to their source. A column named ``copies``, in any case, is replaced, others pass through. An empty table gives an empty one."""
    shares = written(source_epochs(docs, **options).select(F.col("source").alias("mix_source"), F.col("epochs").alias("mix_epochs")), "epochs")
    if shares.count() <= BROADCAST_SOURCES:
        shares = F.broadcast(shares)
    columns = [c for c in docs.columns if c.lower() != "copies"]
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    epochs = shares["mix_epochs"]
    copies = (F.floor(epochs) + F.when(chance < epochs - F.floor(epochs), 1).otherwise(0)).cast("int")
    return docs.join(shares, docs["source"].eqNullSafe(shares["mix_source"])).select(*(docs[c] for c in columns), copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as its ``copies``. See ``with_copies``; the column itself goes."""
    rows = with_copies(docs, **options).where("copies > 0")
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
