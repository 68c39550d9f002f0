"""Changing where a model's texts live."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from sextant.operators.retrieval import CITATION, drift_report
from sextant.sources.model import MODES, KnowledgeModel, check
from sextant.sources.remote import compose_manifest


class Drifted(ValueError):
    """Passages whose texts aren't what they were: nothing was converted."""


def converted(km: KnowledgeModel, mode: str, sources: DataFrame, url_base: str | None = None) -> KnowledgeModel:
    """``km`` with its texts kept in another ``mode``; vectors and ids stay.

    Every passage is verified against ``sources`` (``source_file``, ``text``) first; any that is drifted or missing stops it."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode == km.mode:
        raise ValueError(f"texts are {mode} already")
    if mode == "remote" and not url_base:
        raise ValueError("remote texts need a base address")
    bad = drift_report(km.passages.select(*CITATION), sources).where("drift_status <> 'verified'")
    files = [r.source_file for r in bad.select("source_file").distinct().orderBy("source_file").limit(20).collect()]
    if files:
        raise Drifted(", ".join(files))
    used = sources.join(km.passages.select("source_file").distinct(), "source_file", "left_semi").select("source_file", "text")
    out = replace(km, metadata=km.metadata | {"store_mode": mode}, sources=used if mode == "bundled" else None, manifest=compose_manifest(used, url_base) if mode == "remote" else None)
    check(out)
    return out
