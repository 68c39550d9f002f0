"""A memory of short texts in three tiers that decays, is capped, and consolidates what recurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import preview
from sextant.functions.vectors import cosine
from sextant.operators.blocks import best_of
from sextant.operators.clusters import centroid, clusters
from sextant.operators.context import CHARS_PER_TOKEN, within_budget

TIERS = ("working", "episodic", "semantic")
WEIGHTS = dict(zip(TIERS, (0.5, 0.3, 0.2)))
OTHER_WEIGHT = 0.1
#: Half-life in seconds (None: no decay) and most entries of each tier.
POLICIES = {"working": (86_400.0, 200), "episodic": (14 * 86_400.0, 2_000), "semantic": (None, 20_000)}
FLOOR = 1e-3
SCHEMA = "memory_id long, text string, salience double, source_id string, session string, created_utc string, tier string, recurrence_count long, vector array<float>"


def _by_tier(values: dict, default=None, kind: str = "double") -> Column:
    out = F.lit(default).cast(kind)
    for tier, value in values.items():
        out = F.when(F.col("tier") == tier, F.lit(value).cast(kind)).otherwise(out)
    return out


def checked(entries: DataFrame) -> DataFrame:
    """``entries``, failing at run time on a tier that doesn't exist."""
    known = F.col("tier").isin(*TIERS)
    return entries.withColumn("tier", F.when(known, F.col("tier")).otherwise(F.raise_error(F.concat(F.lit("no such tier: "), F.coalesce("tier", F.lit("null"))))))


def added(memory: DataFrame, entries: DataFrame) -> DataFrame:
    """``memory`` and new entries; what they lack has defaults: salience 1, no session, seen once."""
    defaults = {"salience": F.lit(1.0), "source_id": F.lit(""), "session": F.lit(None).cast("string"), "recurrence_count": F.lit(1).cast("long"), "tier": F.lit("working"), "created_utc": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")}
    full = entries.select(*(F.col(c) if c in entries.columns else defaults[c].alias(c) for c in memory.columns))
    return memory.unionByName(checked(full))


def recall(memory: DataFrame, query: list[float] | DataFrame, k: int = 10, weights: dict[str, float] | None = None, tiers: list[str] | None = None) -> DataFrame:
    """``(rank, memory_id, tier, score)``: the ``k`` entries of largest cosine x tier weight x salience. For a table of queries
    (``query_id``, ``vector``) with the ``query_id`` before them."""
    many = isinstance(query, DataFrame)
    names = [*["query_id"] * many, "rank", "memory_id", "tier", "score"]
    asked = query if many else memory.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, vector array<double>")
    rows = memory if tiers is None else memory.where(F.col("tier").isin(*tiers))
    weight = _by_tier(weights or WEIGHTS, OTHER_WEIGHT) * F.col("salience")
    rows = rows.where(weight.isNotNull()).select(F.col("memory_id").alias("passage_idx"), F.transform("vector", lambda x: x.cast("double") * weight).alias("vector"))
    found = best_of(rows, asked, k, False)
    return found.join(memory.select(F.col("memory_id").alias("passage_idx"), "tier"), "passage_idx").withColumnRenamed("passage_idx", "memory_id").select(*names)


def age_seconds(created: Column | str, now: str) -> Column:
    """0 for none or a time to come, infinite for what isn't a time. Offsets count; without one it is UTC."""
    c = F.col(created) if isinstance(created, str) else created
    at = F.unix_micros(F.try_to_timestamp(c))
    age = (F.unix_micros(F.to_timestamp(F.lit(now))) - at) / 1e6
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).when(at.isNull(), float("inf")).otherwise(F.greatest(age, F.lit(0.0)))


def decayed(salience: Column | str, age: Column, half_life: Column) -> Column:
    """What is left after ``age``; without a half-life all, but nothing of what has no known time."""
    s = F.col(salience) if isinstance(salience, str) else salience
    left = F.when(half_life.isNull() | (age <= 0), s).otherwise(s * F.pow(F.lit(0.5), age / half_life))
    return F.when(age == float("inf"), 0.0).otherwise(left)


def effective(memory: DataFrame, now: str) -> DataFrame:
    """``memory`` with ``age_seconds`` and ``effective`` salience."""
    half = _by_tier({t: p[0] for t, p in POLICIES.items()})
    rows = memory.withColumn("age_seconds", age_seconds("created_utc", now))
    return rows.withColumn("effective", decayed("salience", F.col("age_seconds"), half))


def collected(memory: DataFrame, now: str, floor: float = FLOOR, caps: dict[str, int] | None = None) -> DataFrame:
    """``memory`` without entries faded below ``floor``, and of each tier only the strongest up to its cap.

    Each task keeps its strongest of a tier, so no tier is sorted as a whole in one. ``memory_id`` names one entry."""
    rows = effective(memory, now).where(F.col("effective") >= floor).select("memory_id", "tier", "effective")
    kept = None
    for tier, most in (caps or {t: p[1] for t, p in POLICIES.items()}).items():
        top = rows.where(F.col("tier") == tier).orderBy(F.desc("effective"), "memory_id").limit(most).select("memory_id")
        kept = top if kept is None else kept.unionByName(top)
    return memory.join(kept, "memory_id", "left_semi")


def consolidated(memory: DataFrame, recurrence: int = 3, threshold: float = 0.92, session: str | None = None) -> DataFrame:
    """``memory`` after entries of the episodic tier (of one session, if given) that recur became one of the semantic tier.

    Entries alike at ``threshold`` by chains form a cluster; one of ``recurrence`` or more leaves its first entry, promoted, with
    ``recurrence_count`` set to its size."""
    rows = memory.where("tier = 'episodic'")
    if session is not None:
        rows = rows.where(F.col("session") == session)
    placed = clusters(rows.select(F.col("memory_id").alias("id"), "vector"), threshold)
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("size_")).where(F.col("size_") >= recurrence)
    members = placed.join(sizes, "cluster_id").select(F.col("id").alias("memory_id"), "cluster_id", "size_")
    joined = memory.join(members, "memory_id", "left").where("cluster_id is null or cluster_id = memory_id")
    now = {"tier": F.when(F.col("cluster_id").isNull(), F.col("tier")).otherwise("semantic"), "recurrence_count": F.coalesce("size_", "recurrence_count")}
    return joined.select(*(now[c].alias(c) if c in now else F.col(c) for c in memory.columns))


def primer(memory: DataFrame, novelty: float = 0.3, budgets: dict[str, int] | None = None) -> DataFrame:
    """``(tier, rank, memory_id, score, line)``: entries of the semantic and episodic tiers near their common centroid, as
    many lines as each tier's budget of characters lets through."""
    budgets = budgets or {"semantic": 600 * CHARS_PER_TOKEN, "episodic": 1600 * CHARS_PER_TOKEN}
    rows = memory.where("tier in ('semantic', 'episodic')")
    middle = centroid(rows.select("vector")).select(F.col("vector").alias("middle"))
    rows = rows.crossJoin(F.broadcast(middle)).withColumn("cos_", cosine("vector", "middle")).where(F.col("cos_") >= novelty)
    score = F.round(F.col("cos_") * _by_tier({"semantic": 1.0, "episodic": 0.7}) * F.col("salience"), 6)
    rows = rows.withColumn("score", score)
    # a line has twenty characters at least, so no more of them than this can fit
    order = Window.partitionBy("tier").orderBy(F.desc("score"), "memory_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(budgets.values()) // 20 + 1)
    line = F.format_string("- (%+.3f, seen %d times) %s: %s", "score", "recurrence_count", F.when(F.col("source_id") == "", "·").otherwise(F.coalesce("source_id", F.lit("·"))), preview("text"))
    fits = within_budget(rows.withColumn("line", line), F.length("line"), _by_tier(budgets, 0, "int"), ["tier"], ["rank"])
    return fits.select("tier", "rank", "memory_id", "score", "line")
