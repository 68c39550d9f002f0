"""Texts that live elsewhere: manifests with pinned hashes, fetched in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import lines_normalized, quoted_path

THREADS = 8
Opener = Callable[[str], bytes]


class ShaMismatch(ValueError):
    """Fetched texts that aren't those pinned."""


def open_url(url: str) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as r:
        return r.read()


def compose_manifest(files: DataFrame, url_base: str | Column) -> DataFrame:
    """``(source_file, url, sha256)`` for ``files`` (``source_file``, ``text``) below a base address."""
    base = F.lit(url_base.rstrip("/")) if isinstance(url_base, str) else url_base
    return files.select("source_file", F.concat(base, F.lit("/"), quoted_path("source_file")).alias("url"), F.sha2("text", 256).alias("sha256"))


def fetched(manifest: DataFrame, opener: Opener = open_url, threads: int = THREADS) -> DataFrame:
    """``(source_file, url, text, error)``: each file fetched, several at a time in each task; what fails has a null text."""

    def one(url: str) -> tuple[str | None, str | None]:
        try:
            return opener(url).decode("utf-8"), None
        except Exception as e:  # noqa: BLE001 - whatever a network says is the file's state
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                got = list(pool.map(one, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["source_file", "url", "text", "error"])

    rows = manifest.select("source_file", "url").mapInArrow(run, "source_file string, url string, text string, error string")
    return rows.withColumn("text", lines_normalized("text"))


def against_pins(got: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(source_file, text, drifted)`` of what was fetched: ``drifted`` where the text isn't the one whose hash is pinned."""
    rows = got.where("text is not null").select("source_file", "text").join(manifest.select("source_file", "sha256"), "source_file")
    return rows.select("source_file", "text", (F.sha2("text", 256) != F.col("sha256")).alias("drifted"))


def pinned_texts(manifest: DataFrame, opener: Opener = open_url, cache: DataFrame | None = None) -> DataFrame:
    """``(source_file, text)`` with every hash as pinned, failing at run time with the file's name if one isn't.

    ``cache`` (``source_file``, ``sha256``, ``text``) spares fetching what it has."""
    wanted = manifest
    known = None
    if cache is not None:
        known = manifest.join(cache.select("source_file", "sha256", "text"), ["source_file", "sha256"]).select("source_file", "text")
        wanted = manifest.join(cache, ["source_file", "sha256"], "left_anti")
    got = fetched(wanted, opener).join(wanted.select("source_file", "sha256"), "source_file")
    ok = F.sha2("text", 256) == F.col("sha256")
    why = F.concat(F.lit("ShaMismatch: "), F.col("source_file"), F.lit(" "), F.coalesce("error", F.lit("has another text")))
    fresh = got.select("source_file", F.when(ok, F.col("text")).otherwise(F.raise_error(why)).alias("text"))
    return fresh if known is None else known.unionByName(fresh)


def catalog_ref(catalog: bytes) -> str:
    from hashlib import sha256

    return sha256(catalog).hexdigest()[:16]


def poll_ref(manifest: DataFrame) -> str:
    """Changes with any pin of the manifest."""
    total = manifest.select(F.sum(F.xxhash64("source_file", "url", "sha256").cast("decimal(38,0)"))).first()[0] or 0
    return f"poll-{int(total) & 0xFFFFFFFFFFFF:012x}"
