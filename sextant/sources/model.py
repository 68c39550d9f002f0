"""Knowledge models on disk: versions of Parquet tables, and a pointer that moves last."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import passage_id
from sextant.functions.vectors import normalized

VERSION = 4
MODES = ("bundled", "local", "remote")
REGISTRY = "passage_idx long, source_file string, char_offset int, char_length int, content_hash string, passage_id string"


@dataclass(frozen=True)
class KnowledgeModel:
    """``passages``: citations and ``vector``, with ``optimised`` if a projection was trained. ``metadata`` keeps keys it doesn't know.
    ``sources`` are bundled texts, ``manifest`` pins remote ones (``source_file``, ``url``, ``sha256``)."""

    passages: DataFrame
    metadata: dict = field(default_factory=dict)
    sources: DataFrame | None = None
    manifest: DataFrame | None = None
    projection: list[list[float]] | None = None

    @property
    def mode(self) -> str:
        return self.metadata.get("store_mode", "local")

    def band(self, prefer: str | None = None) -> str:
        """The column of a band; by default ``optimised`` if there is one. ``KeyError`` for one that isn't there."""
        has = "optimised" in self.passages.columns
        if prefer in (None, "base"):
            return "optimised" if has and prefer is None else "vector"
        if prefer == "optimised" and has:
            return "optimised"
        raise KeyError(prefer)

    def queries_for(self, queries: DataFrame, prefer: str | None = None) -> DataFrame:
        """Query vectors in the band's space."""
        if self.band(prefer) == "vector":
            return queries
        from sextant.functions.vectors import projected

        w = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in self.projection))
        return queries.withColumn("vector", projected("vector", w))


def new_metadata(mode: str, dim: int, encoder: str, revision: str, created_utc: str = "", **build) -> dict:
    return {"version": VERSION, "kind": "corpus", "store_mode": mode, "encoder": {"name": encoder, "revision": revision}, "bands": {"base": {"dim": dim}}, "created_utc": created_utc, "build_config": build}


def check(km: KnowledgeModel) -> None:
    """What must agree between the parts; ``ValueError`` if it doesn't."""
    meta = km.metadata
    if meta.get("version") != VERSION:
        raise ValueError(f"version {meta.get('version')}, not {VERSION}")
    if meta.get("store_mode") not in MODES:
        raise ValueError(f"no such mode: {meta.get('store_mode')}")
    has = "optimised" in km.passages.columns
    if has != ("optimised" in meta["bands"]) or has != (km.projection is not None):
        raise ValueError("the optimised band needs its vectors, its projection and its entry")
    if (km.manifest is not None) != (meta["store_mode"] == "remote"):
        raise ValueError("a manifest goes with remote sources, and they with it")
    if (km.sources is not None) != (meta["store_mode"] == "bundled"):
        raise ValueError("texts go with bundled sources, and they with them")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> int:
    """The version that the pointer names; -1 if there is none."""
    fs, p = _fs(spark, f"{path}/CURRENT")
    return int(spark.read.text(f"{path}/CURRENT").first()[0]) if fs.exists(p) else -1


def write(km: KnowledgeModel, path: str) -> int:
    """Writes the next version, then moves the pointer: readers see the old version or the new. Vectors are stored at length one."""
    check(km)
    spark = km.passages.sparkSession
    version = claimed(spark, path)
    at = f"{path}/v={version}"
    bands = [b for b in ("vector", "optimised") if b in km.passages.columns]
    rows = km.passages.select(*(c for c in km.passages.columns if c not in bands), *(normalized(b).cast("array<float>").alias(b) for b in bands))
    rows.write.mode("overwrite").parquet(f"{at}/passages")
    if km.sources is not None:
        km.sources.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/sources")
    if km.manifest is not None:
        km.manifest.write.mode("overwrite").parquet(f"{at}/manifest")
    if km.projection is not None:
        spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(km.projection)], "i int, w array<double>").coalesce(1).write.mode("overwrite").parquet(f"{at}/projection")
    _put(spark, f"{at}/metadata.json", json.dumps(km.metadata, sort_keys=True))
    _put(spark, f"{path}/CURRENT", str(version))
    return version


def _put(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced in one step: a crash leaves the old one or the new."""
    fs, target = _fs(spark, path)
    if fs.getUri().getScheme() == "file":
        import os

        plain = target.toUri().getPath()
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        draft = f"{plain}.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, plain)
        return
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, how)


def claimed(spark: SparkSession, path: str) -> int:
    """The next version's number, that no other writer gets: an empty file is made for each."""
    version = current(spark, path) + 1
    while True:
        fs, mark = _fs(spark, f"{path}/claimed-{version}")
        fs.mkdirs(mark.getParent())
        if fs.createNewFile(mark):
            return version
        version += 1


def read(spark: SparkSession, path: str) -> KnowledgeModel:
    """The current version; ``FileNotFoundError`` without one, ``ValueError`` for a format that isn't known."""
    version = current(spark, path)
    if version < 0:
        raise FileNotFoundError(path)
    at = f"{path}/v={version}"
    meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{at}/metadata.json").collect()))
    if meta.get("version") != VERSION:
        raise ValueError(f"version {meta.get('version')}, not {VERSION}")
    have = lambda name: (lambda fs, p: fs.exists(p))(*_fs(spark, f"{at}/{name}"))
    table = lambda name: spark.read.parquet(f"{at}/{name}") if have(name) else None
    w = table("projection")
    km = KnowledgeModel(spark.read.parquet(f"{at}/passages"), meta, table("sources"), table("manifest"), [r.w for r in w.orderBy("i").collect()] if w is not None else None)
    check(km)
    return km


def with_optimised(km: KnowledgeModel, weights: list[list[float]]) -> KnowledgeModel:
    """``km`` with the projected band; the base stays as it is."""
    import numpy as np

    from sextant.operators.projection import with_projection

    passages = with_projection(km.passages, np.asarray(weights))
    bands = km.metadata["bands"] | {"optimised": {"dim": len(weights), "w_shape": [len(weights), len(weights[0])]}}
    return replace(km, passages=passages, metadata=km.metadata | {"bands": bands}, projection=[list(map(float, r)) for r in weights])


def without_optimised(km: KnowledgeModel) -> KnowledgeModel:
    bands = {k: v for k, v in km.metadata["bands"].items() if k != "optimised"}
    return replace(km, passages=km.passages.drop("optimised"), metadata=km.metadata | {"bands": bands}, projection=None)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry of JSON lines; a bad line is an error, a missing id is derived."""
    rows = spark.read.schema(REGISTRY).option("mode", "FAILFAST").json(path)
    return rows.withColumn("passage_id", F.coalesce("passage_id", passage_id("source_file", "char_offset", "char_length")))


def write_registry(passages: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; ``ValueError`` if the numbers have gaps or repeat."""
    n, low, high, distinct = passages.agg(F.count("*"), F.min("passage_idx"), F.max("passage_idx"), F.count_distinct("passage_idx")).first()
    if n and (low != 0 or high != n - 1 or distinct != n):
        raise ValueError("passage numbers must run from 0 without gaps")
    names = sorted(x.split()[0] for x in REGISTRY.split(", "))
    passages.select(*names).write.json(path)
