"""Keeping passages up to date: what changed, and only that encoded anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = ("unchanged", "updated", "added", "removed")
#: Encodes ``(passage_id, text)`` into ``(passage_id, vector)``.
Encode = Callable[[DataFrame], DataFrame]


def bucketise(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(passage_id, bucket)`` of the passages of either side, by id and ``content_hash``. Ids that repeat count once."""
    o = old.select("passage_id", F.col("content_hash").alias("old_hash")).dropDuplicates(["passage_id"])
    n = new.select("passage_id", F.col("content_hash").alias("new_hash")).dropDuplicates(["passage_id"])
    both = o.join(n, "passage_id", "full_outer")
    bucket = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return both.select("passage_id", bucket.alias("bucket"))


def bucket_counts(buckets: DataFrame) -> DataFrame:
    """``(bucket, n)`` with all four buckets."""
    names = buckets.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return names.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").fillna(0)


def apply_delta(old: DataFrame, new: DataFrame, encode: Encode) -> DataFrame:
    """The passages of ``new`` (``candidates`` with texts), vectors kept where the text is unchanged, others encoded once.

    Numbered by file and offset."""
    from sextant.functions.chunks import numbered
    from sextant.scratch import written

    fresh = new.dropDuplicates(["passage_id"])
    known = old.select("passage_id", F.col("content_hash").alias("old_hash"), F.col("vector").alias("old_vector")).dropDuplicates(["passage_id"])
    rows = written(fresh.join(known, "passage_id", "left"), "delta")
    same = F.col("old_hash").eqNullSafe(F.col("content_hash"))
    kept = rows.where(same).select(*(c for c in fresh.columns if c != "text"), F.col("old_vector").alias("vector"))
    changed = rows.where(~same)
    vectors = encode(changed.select("passage_id", "text"))
    done = changed.drop("text", "old_hash", "old_vector").join(vectors, "passage_id")
    return numbered(kept.unionByName(done), ["source_file", "char_offset", "passage_id"])


def manifest_delta(pinned: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(source_file, bucket)`` of two manifests (``source_file``, ``url``, ``sha256``): changed if the hash or the place differs."""
    o = pinned.select("source_file", F.struct("url", "sha256").alias("old"))
    n = catalog.select("source_file", F.struct("url", "sha256").alias("new"))
    bucket = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return o.join(n, "source_file", "full_outer").select("source_file", bucket.alias("bucket"))


def poll_delta(pinned: DataFrame, fetched: DataFrame) -> DataFrame:
    """``(source_file, bucket)``: pinned files against what was fetched (``source_file``, ``text``; null if it failed)."""
    got = fetched.select("source_file", F.sha2("text", 256).alias("now"))
    bucket = F.when(F.col("now").isNull(), "unavailable").when(F.col("now") == F.col("sha256"), "unchanged").otherwise("modified")
    return pinned.join(got, "source_file", "left").select("source_file", bucket.alias("bucket"))


def freshness(pinned: DataFrame, fetched: DataFrame) -> DataFrame:
    """``(source_file, drift_status)`` of each pinned file."""
    names = F.when(F.col("bucket") == "unavailable", "missing").when(F.col("bucket") == "unchanged", "verified").otherwise("drifted")
    return poll_delta(pinned, fetched).select("source_file", names.alias("drift_status"))


def changed_files(delta: DataFrame) -> DataFrame:
    return delta.where("bucket in ('added', 'modified')").select("source_file")


class Unavailable(RuntimeError):
    """Files of a sync that can't be reached."""


def sync(old: DataFrame, pinned: DataFrame, delta: DataFrame, fetched: DataFrame, encode: Encode, allow_unavailable: bool = False, least: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Passages and manifest after a remote change.

    ``delta`` names the files by bucket, ``fetched`` holds ``(source_file, url, text)`` of those added or modified. Files that were not
    reached raise ``Unavailable`` unless allowed, and keep their passages then. The manifest is pinned to the hashes of what came."""
    from sextant.functions import chunks
    from sextant.functions.text import lines_normalized

    if not allow_unavailable:
        away = [r.source_file for r in delta.where("bucket = 'unavailable'").select("source_file").orderBy("source_file").limit(20).collect()]
        if away:
            raise Unavailable(", ".join(away))
    came = fetched.where("text is not null").select("source_file", "url", lines_normalized("text").alias("text"))
    touched = delta.where("bucket in ('removed', 'modified', 'added')").select("source_file")
    untouched = old.join(touched, "source_file", "left_anti")
    before = old.join(came.select("source_file"), "source_file", "left_semi")
    now = chunks.candidates(came, least or chunks.LEAST, most or chunks.MOST)
    renewed = apply_delta(before, now, encode)
    columns = [c for c in renewed.columns if c != "passage_idx"]
    passages = chunks.numbered(untouched.select(*columns).unionByName(renewed.select(*columns)), ["source_file", "char_offset", "passage_id"])
    manifest = pinned.join(touched, "source_file", "left_anti").unionByName(came.select("source_file", "url", F.sha2("text", 256).alias("sha256")))
    return passages, manifest
