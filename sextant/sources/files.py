"""Text files as a table ``(source_file, text)``, and those that couldn't be read."""

from __future__ import annotations

import os
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import lines_normalized

EXTENSIONS = ("md", "rst", "txt", "py", "js", "ts", "go", "rs", "java", "c", "h", "cpp", "html", "json", "yaml", "yml", "toml", "ipynb", "sql", "sh")
PROJECT_DIRS, PROJECT_FILES = "docs src lib notebooks examples".split(), EXTENSIONS[:3]


def common_root(paths: list[str]) -> str:
    """A single folder itself, a single file's folder, else what all share."""
    full = [os.path.abspath(p) for p in paths]
    if len(full) == 1:
        return full[0] if os.path.isdir(full[0]) else os.path.dirname(full[0])
    return os.path.commonpath(full)


def project_sources(folder: str) -> list[str]:
    """What of a project is worth reading: its usual folders, and texts at its top."""
    here = Path(folder)
    dirs = [str(here / d) for d in PROJECT_DIRS if (here / d).is_dir()]
    return dirs + sorted(str(p) for p in here.iterdir() if p.is_file() and p.suffix.lower().lstrip(".") in PROJECT_FILES)


def resolve_inside(root: str, source_file: str) -> str:
    """The path of a file below ``root``; ``ValueError`` if it leads out."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, source_file))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{source_file} lies outside {root}")
    return full


def walk(spark: SparkSession, paths: list[str], root: str | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """``(source_file, text)`` of all files with an allowed extension below ``paths``, and ``(source_file, reason)`` of those that
    can't be read or aren't UTF-8. Names are relative to ``root``, absolute outside it; line ends become single newlines; a file named twice counts once."""
    root = os.path.abspath(root or common_root(paths)).rstrip("/")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    inside = F.startswith(plain, F.lit(root + "/"))
    name = F.when(inside, F.expr(f"substring(plain_, {len(root) + 2})")).otherwise(F.col("plain_"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    named = lambda raw: raw.where(ending.isin(*(e.lower().lstrip(".") for e in extensions))).withColumn("plain_", plain)
    raw = named(found.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(paths))
    rows = raw.select(name.alias("source_file"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).dropDuplicates(["source_file"])
    good = rows.where("text is not null").select("source_file", lines_normalized("text").alias("text"))
    wrong = rows.where("text is null").select("source_file", F.lit("not utf-8").alias("reason"))
    listed = spark.createDataFrame([(str(x),) for x in _listed(raw)], "path string")
    lost = named(listed).select(name.alias("source_file")).distinct().join(rows.select("source_file"), "source_file", "left_anti")
    return good, wrong.unionByName(lost.select("source_file", F.lit("can't be read").alias("reason")))


def _listed(raw: DataFrame) -> list[str]:
    """The files that the reader lists, whether or not they can be read; the driver holds this list anyway."""
    return [unquote(x) for x in raw.inputFiles()]
