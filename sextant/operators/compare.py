"""Set algebra on similarity between corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions.vectors import dot
from sextant.operators.blocks import best_of, best_of_both, best_over, pairs_over
from sextant.operators.clusters import centroid, clusters


class Mismatch(ValueError):
    """Two corpora that can't be compared."""


def require_pair(a: dict, b: dict, strict: bool = True) -> bool:
    """Checks the base bands of two corpora's metadata; whether their encoder revisions agree.

    Sizes must agree always, revisions if ``strict``."""
    for meta in (a, b):
        if "base" not in meta.get("bands", {}):
            raise Mismatch("a base band is needed")
    if a["bands"]["base"].get("dim") != b["bands"]["base"].get("dim"):
        raise Mismatch("vectors differ in size")
    same = a.get("encoder", {}).get("revision") == b.get("encoder", {}).get("revision")
    if strict and not same:
        raise Mismatch("encoder revisions differ")
    return same


def sampled(vectors: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """At most ``size`` rows of ``(id, vector)``, the first by a seeded hash of the id: the same whichever side asks."""
    return vectors.orderBy(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256), "id").limit(size)


def mean_coverage(a: DataFrame, b: DataFrame, size: int = 512, seed: int = 0) -> DataFrame:
    """One row ``(coverage)``: the mean over a sample of ``a`` of the largest cosine with ``b``; 0 if either is empty."""
    best = best_over(sampled(a, size, seed), b)
    return best.agg(F.round(F.coalesce(F.avg(F.when(F.col("score") > float("-inf"), F.col("score"))), F.lit(0.0)), 6).alias("coverage"))


def compare(a: DataFrame, b: DataFrame, size: int = 512, seed: int = 0) -> DataFrame:
    """One row ``(centroid_cosine, coverage_ab, coverage_ba, overlap)``; swapping the sides swaps the coverages only."""
    ca, cb = centroid(a).select(F.col("vector").alias("x")), centroid(b).select(F.col("vector").alias("y"))
    one = a.sparkSession.range(1).select()
    ab = mean_coverage(a, b, size, seed).select(F.col("coverage").alias("coverage_ab"))
    ba = mean_coverage(b, a, size, seed).select(F.col("coverage").alias("coverage_ba"))
    sides = one.join(ca, how="left").join(cb, how="left").join(ab).join(ba)
    return sides.select(F.round(F.coalesce(dot("x", "y"), F.lit(0.0)), 6).alias("centroid_cosine"), "coverage_ab", "coverage_ba", F.round((F.col("coverage_ab") + F.col("coverage_ba")) / 2, 6).alias("overlap"))


def unique(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(a, score)``: rows of ``a`` whose best match in ``b`` is below ``threshold``; all of them if ``b`` is empty."""
    return best_over(a, b).where(F.col("score") < threshold)


def intersection(a: DataFrame, b: DataFrame, threshold: float = 0.7, max_pairs: int = 10_000) -> DataFrame:
    """``(a, b, score)``: the ``max_pairs`` best pairs at ``threshold`` or more."""
    return pairs_over(a, b, threshold).orderBy(F.desc("score"), "a", "b").limit(max_pairs)


def corpus_diff(old: DataFrame, new: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(id, side)``: ``removed`` rows of ``old`` without a match in ``new``, ``added`` ones of ``new`` without one in ``old``,
    and the ``unchanged`` rest of ``old``."""
    alone = F.col("score") < threshold
    side = F.when(F.col("other"), "added").when(alone, "removed").otherwise("unchanged")
    return best_of_both(old, new).where(~F.col("other") | alone).select(F.col("a").alias("id"), side.alias("side"))


def compose(**members: DataFrame) -> DataFrame:
    """Passages of all members with their ``label``."""
    if not members:
        raise ValueError("nothing to compose")
    out = None
    for label, passages in members.items():
        rows = passages.withColumn("label", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


def compose_models(**models) -> DataFrame:
    """``compose`` of the base bands of whole models; those that differ in size or lack the band are refused. Revisions may differ: the order
    of scores holds within each."""
    first = None
    for km in models.values():
        first = first or km.metadata
        require_pair(first, km.metadata, strict=False)
    return compose(**{label: km.passages.drop("optimised") for label, km in models.items()})


def composed_search(queries: DataFrame, k: int = 10, **members: DataFrame) -> DataFrame:
    """``(query_id, rank, label, passage_idx, score)``: the best ``k`` over all members, places repeated. Ties go by label, then index."""
    found = None
    for label, passages in members.items():
        rows = best_of(passages, queries, k, False).withColumn("label", F.lit(label))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("nothing to search")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label", "passage_idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "label", "passage_idx", "score")


def merged(a: DataFrame, b: DataFrame, threshold: float = 0.92) -> DataFrame:
    """``(side, old_id, passage_idx)`` of the rows that stay of both corpora (``id``, ``vector``): of rows alike at ``threshold`` or
    more, by chains, the first stays, and those of ``a`` come before those of ``b``. They are numbered anew from 0."""
    from sextant.functions.chunks import numbered

    both = a.select(F.lit(0).alias("side"), F.col("id").cast("long").alias("old_id"), "vector").unionByName(b.select(F.lit(1).alias("side"), F.col("id").cast("long").alias("old_id"), "vector"))
    placed = numbered(both, ["side", "old_id"], "at_")
    placed = placed.withColumnRenamed("at_", "id")
    keep = clusters(placed.select("id", "vector"), threshold).where("id = cluster_id").select("id")
    kept = placed.join(keep, "id", "left_semi").select("side", "old_id", "id")
    return numbered(kept, ["id"]).select("side", "old_id", "passage_idx")


def merged_model(a, b, threshold: float = 0.92):
    """A model of local mode with what ``merged`` keeps of both, numbered anew, and the counts in its ``build_config``.

    Bundled models are refused, as their texts would be lost, and so are pairs of another size or revision. Only base bands are merged."""
    from sextant.scratch import written
    from sextant.sources.model import KnowledgeModel

    if "bundled" in (a.mode, b.mode):
        raise ValueError("bundled models can't be merged: convert them to local ones first")
    require_pair(a.metadata, b.metadata)
    sides = [k.passages.select(F.col("passage_idx").alias("id"), "vector") for k in (a, b)]
    kept = written(merged(*sides, threshold), "merged")
    both = [k.passages.drop("optimised").withColumnRenamed("passage_idx", "old_id").withColumn("side", F.lit(i)) for i, k in enumerate((a, b))]
    columns = [c for c in both[0].columns if c in both[1].columns]
    rows = both[0].select(*columns).unionByName(both[1].select(*columns)).join(kept, ["side", "old_id"]).drop("side", "old_id")
    n = [s.count() for s in sides]
    config = {"merged_from": [k.metadata.get("build_config", {}).get("root", "") for k in (a, b)], "dedupe_threshold": threshold, "n_a": n[0], "n_b": n[1], "n_merged": kept.count()}
    meta = {k: v for k, v in a.metadata.items() if k not in ("ann", "pinned_ref")} | {"store_mode": "local", "bands": {"base": a.metadata["bands"]["base"]}, "build_config": config}
    return KnowledgeModel(rows.select("passage_idx", *(c for c in rows.columns if c != "passage_idx")), meta)


#: Pairs that are tried first for each one wanted, and bytes of trigrams that one task holds of either side.
TRIED, GRAM_BYTES = 16, 96 << 20


def worded(pairs: DataFrame, texts: DataFrame, gram_bytes: int | None = None) -> DataFrame:
    """``pairs`` (``a``, ``b``, more) of which both have a text, with ``jaccard``, the overlap of their trigram sets.

    The sets meet in cells, a part of those of ``a`` with a part of those of ``b``: a set is sent once for each part of the other side,
    not once for each pair."""
    from sextant.functions.text import hashed_trigrams
    from sextant.operators.blocks import _by_cell
    from sextant.scratch import written

    most = gram_bytes or GRAM_BYTES
    ends = [pairs.select(F.col(c).alias("id")).distinct() for c in ("a", "b")]
    legible = texts.where("text is not null and text <> ''").select("id", "text")
    grams = written(legible.join(ends[0].union(ends[1]).distinct(), "id", "left_semi").select("id", hashed_trigrams("text").alias("grams")), "grams")
    sides = [written(grams.join(e, "id", "left_semi"), "side") for e in ends]
    size = [x.agg(F.sum(8 * F.coalesce(F.size("grams"), F.lit(0)).cast("long") + 8)).first()[0] or 0 for x in sides]
    n, m = (max(1, -(-x // most)) for x in size)
    while n * m < 24 and max(size[0] / n, size[1] / m) > most / 24:  # enough for a cluster to share
        n, m = (n + 1, m) if size[0] / n > size[1] / m else (n, m + 1)
    own = lambda c, k: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(k)).cast("int")
    more = [c for c in pairs.columns if c not in ("a", "b")]
    none = F.lit(None).cast("long")
    rows = sides[0].select("id", none.alias("b"), "grams", own("id", n).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), F.lit(0).alias("kind"))
    rows = rows.unionByName(sides[1].select("id", none.alias("b"), "grams", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), own("id", m).alias("j"), F.lit(1).alias("kind")))
    rows = rows.unionByName(pairs.select(F.col("a").alias("id"), "b", F.lit(None).cast("array<long>").alias("grams"), own("a", n).alias("i"), own("b", m).alias("j"), F.lit(2).alias("kind"), *more), allowMissingColumns=True)
    rows = rows.select("kind", "id", "b", "grams", *more, (F.col("i") * m + F.col("j")).cast("int").alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[], [], []]
        for batch in batches:
            kind = batch.column(0).to_numpy()
            for k in range(3):
                if (kind == k).any():
                    part = batch.filter(pa.array(kind == k))
                    parts[k].append(part.select([1, 3]) if k < 2 else part.select([1, 2, *range(4, part.num_columns)]))
        if not all(parts):
            return
        (ida, la, ga), (idb, lb, gb) = (_sets(p) for p in parts[:2])
        known, ga = np.unique(ga, return_inverse=True)
        at = np.minimum(np.searchsorted(known, gb), max(0, len(known) - 1))
        some = known[at] == gb if len(known) else np.zeros(len(gb), bool)
        codes, ends = at[some].astype(np.int32), np.concatenate([[0], np.cumsum(some)])
        ga, sa, sb = ga.astype(np.int32), _starts(la), _starts(lb)
        mark = np.zeros(len(known), bool)
        for batch in parts[2]:
            a, b = _places(ida, batch.column(0).to_numpy()), _places(idb, batch.column(1).to_numpy())
            there = np.flatnonzero((a >= 0) & (b >= 0))
            there = there[np.argsort(b[there], kind="stable")]
            a, b = a[there], b[there]
            both = np.zeros(len(a), np.int64)
            for group in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1) if len(b) else ():
                for lo in range(0, len(group), 2048):
                    g = group[lo : lo + 2048]
                    size = np.maximum(la[a[g]], 0)
                    if not size.sum():
                        continue
                    mine = codes[ends[sb[b[g[0]]]] : ends[sb[b[g[0]] + 1]]]
                    mark[mine] = True
                    run_ = np.cumsum(size)
                    hit = mark[ga[np.repeat(sa[a[g]] - (run_ - size), size) + np.arange(run_[-1])]]
                    mark[mine] = False
                    total = np.concatenate([[0], np.cumsum(hit)])
                    both[g] = total[run_] - total[run_ - size]
            either = np.where((la[a] < 0) | (lb[b] < 0), -1, la[a] + lb[b] - both)
            kept = batch.take(pa.array(there))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(both), pa.array(either)], ["a", "b", *more, "both", "either"])

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), *(pairs.schema[c] for c in more), T.StructField("both", T.LongType()), T.StructField("either", T.LongType())])
    out = _by_cell(rows, n * m, run, schema)
    jaccard = F.when(F.col("either") < 0, F.lit(1.0)).otherwise(F.col("both") / F.col("either"))
    return out.select("a", "b", *more, F.round(jaccard, 6).alias("jaccard"))


def _sets(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, how many trigrams each has (-1: too short to tell), and these one after another."""
    ids = np.concatenate([b.column(0).to_numpy() for b in batches])
    lists = pa.chunked_array([b.column(1) for b in batches]).combine_chunks()
    order = np.argsort(ids, kind="stable")
    lists = lists.take(pa.array(order))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), -1)).astype(np.int64)
    return ids[order], sizes, lists.flatten().to_numpy()


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id is among the sorted ``ids``; -1 if it isn't."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def contradictions(vectors: DataFrame, texts: DataFrame, cosine: float = 0.85, lexical: float = 0.3, max_pairs: int = 1000, tried: int | None = None) -> DataFrame:
    """``(a, b, score, jaccard)``: pairs that mean alike but are worded differently, the ``max_pairs`` most alike.

    Only ids and scores are paired. The most alike are read first, ``tried`` of them; if too few of these are worded differently, all pairs
    are. Passages without a text are in no pair."""
    from sextant.scratch import written

    tried = max_pairs * TRIED if tried is None else tried
    legible = vectors.join(texts.where("text is not null and text <> ''").select("id"), "id", "left_semi")
    legible = written(legible.select("id", "vector"), "legible")
    best = [F.desc("score"), "a", "b"]
    pairs = written(pairs_over(legible, None, cosine, most=tried).orderBy(*best).limit(tried), "alike")
    found = written(worded(pairs, texts).where(F.col("jaccard") <= lexical).orderBy(*best).limit(max_pairs), "contradictions")
    if pairs.count() == tried and found.count() < max_pairs:
        pairs = written(pairs_over(legible, None, cosine), "all-alike")
        found = worded(pairs, texts).where(F.col("jaccard") <= lexical)
    return found.orderBy(*best).limit(max_pairs)


def supporters(vectors: DataFrame, claims: DataFrame, support: float = 0.7, k: int = 10) -> DataFrame:
    """``(query_id, rank, passage_idx, score)`` for claims ``(query_id, vector)``: the ``k`` best with a score of ``support`` or more."""
    return best_of(vectors.select(F.col("id").alias("passage_idx"), "vector"), claims, k, False).where(F.col("score") >= support)


def audit(vectors: DataFrame, texts: DataFrame, claims: DataFrame, support: float = 0.7, k: int = 10, cosine: float = 0.85, lexical: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """The ``supporters`` of claims, and what speaks against them, ``(query_id, passage_idx, supporter, score, jaccard)``: passages
    near a readable supporter but worded differently, no supporters themselves, under the first supporter that finds them.

    Texts are compared once for each supporter and passage, however many claims it supports."""
    from sextant.scratch import written

    found = written(supporters(vectors, claims, support, k), "support")
    legible = texts.where("text is not null and text <> ''").select(F.col("id").alias("passage_idx"))
    readable = written(found.join(legible, "passage_idx", "left_semi"), "readable")
    askers = readable.select(F.col("passage_idx").alias("id")).distinct().join(vectors, "id")
    near = written(pairs_over(askers, vectors, cosine).where("a <> b"), "near")
    unlike = worded(near, texts).where(F.col("jaccard") <= lexical)
    rows = readable.select("query_id", "rank", F.col("passage_idx").alias("a")).join(unlike, "a").join(found.select("query_id", F.col("passage_idx").alias("b")), ["query_id", "b"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "b").orderBy("rank"))
    against = rows.withColumn("at", first).where("at = 1").select("query_id", F.col("b").alias("passage_idx"), F.col("a").alias("supporter"), "score", "jaccard")
    return found, against


def audit_summary(support: DataFrame, claims: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    """``(query_id, n_support, source_count, drift_fraction)`` of every claim: how many passages of how many files back it, and the share
    of these that the sources no longer hold."""
    from sextant.operators.retrieval import CITATION, verified

    hits = verified(support.select("query_id", "passage_idx").join(passages.select(*CITATION), "passage_idx"), sources)
    drifted = F.avg((F.col("drift_status") != "verified").cast("double"))
    out = hits.groupBy("query_id").agg(F.count("*").alias("n_support"), F.count_distinct("source_file").alias("source_count"), F.round(drifted, 6).alias("drift_fraction"))
    return claims.select("query_id").join(out, "query_id", "left").fillna(0)
