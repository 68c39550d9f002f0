"""Document fingerprints: Merkle trees over paragraphs and sections."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(text: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """The root, and each section's hash with its paragraphs' hashes.

    A paragraph is a line that isn't empty once spaces around it are cut. A section ends before an empty line or a heading (a line
    that starts with ``#``), and after a paragraph whose hash ends in 0 or 8: so long runs are cut too, at places that an edit elsewhere
    does not move. A section's hash is over its paragraphs' joined hashes, the root over the sections'."""
    sections: list[list[str]] = []
    fresh = True
    for line in text.split("\n"):
        line = line.strip(" ")
        if not line:
            fresh = True
            continue
        leaf = sha256(line.encode()).hexdigest()
        if fresh or line[0] == "#":
            sections.append([])
        sections[-1].append(leaf)
        fresh = leaf[-1] in "08"
    named = [(sha256("".join(s).encode()).hexdigest(), s) for s in sections]
    return sha256("".join(h for h, _ in named).encode()).hexdigest(), named


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [None if t is None else tree(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([t and t[0] for t in trees], pa.string()),
                pa.array([None if t is None else [h for h, _ in t[1]] for t in trees], pa.list_(pa.string())),
                pa.array([None if t is None else [p for _, p in t[1]] for t in trees], pa.list_(pa.list_(pa.string()))),
            ],
            ["doc_id", "root", "sections", "paragraphs"],
        )


def merkle_trees(docs: DataFrame) -> DataFrame:
    """``(doc_id, root, sections, paragraphs)`` for every row: hashes of the whole tree, ``paragraphs`` per section.

    A null text has a null tree; a text without a paragraph has no sections and the hash of nothing as its root. Rows without an id
    and rows that repeat each get a tree. Other columns are not read. An empty table gives no rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_trees, "doc_id long, root string, sections array<string>, paragraphs array<array<string>>")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, root, section_hashes, n_sections, n_paragraphs)``; the section hashes joined by commas. See ``merkle_trees``."""
    t = merkle_trees(docs)
    return t.select("doc_id", "root", F.array_join("sections", ",").alias("section_hashes"), F.size("sections").cast("long").alias("n_sections"), F.size(F.flatten("paragraphs")).cast("long").alias("n_paragraphs"))


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(doc_id, change, section, paragraph, hash)``: where the trees of ``old`` and ``new`` (as of ``merkle_trees``) differ.

    Roots are compared first, then the sections of documents whose roots differ, and only differing sections' paragraphs: each that one side has
    and the other has not, ``removed`` or ``added``, with its place in its own tree. Repeats count: a paragraph in a differing section twice before and once
    after is removed once, the last of them. A moved section is no change of paragraphs. A document on one side only has all its paragraphs removed or
    added. Null trees have none; rows without an id are left out. Of rows that repeat an id on one side the one of the least root stands for them."""

    def side(trees: DataFrame, s: str) -> DataFrame:
        one = trees.where("doc_id is not null").groupBy("doc_id").agg(F.min("root").alias(f"{s}_root"), F.min_by(F.struct("sections", "paragraphs"), "root").alias("t"))
        return one.select("doc_id", f"{s}_root", *(F.coalesce(F.col("t")[c], F.array()).alias(f"{s}_{c}") for c in ("sections", "paragraphs")))

    o, n = side(old, "o"), side(new, "n")
    both = o.join(n, "doc_id", "full_outer").where(~F.col("o_root").eqNullSafe(F.col("n_root")))

    def leaves(side: str, other: str, change: str) -> DataFrame:
        rows = both.select("doc_id", F.coalesce(f"{other}_sections", F.array()).alias("same"), F.posexplode(F.arrays_zip(F.col(f"{side}_sections").alias("h"), F.col(f"{side}_paragraphs").alias("p"))).alias("section", "z"))
        rows = rows.where(~F.array_contains("same", F.col("z.h")))
        return rows.select("doc_id", "section", F.posexplode("z.p").alias("paragraph", "hash")).withColumn("change", F.lit(change))

    rows = leaves("o", "n", "removed").unionByName(leaves("n", "o", "added"))
    sides = rows.groupBy("doc_id", "hash").agg(*(F.sort_array(F.collect_list(F.when(F.col("change") == c, F.struct("section", "paragraph")))).alias(c) for c in ("removed", "added")))
    k = F.least(F.size("removed"), F.size("added"))
    parts = [sides.select("doc_id", F.lit(c).alias("change"), "hash", F.explode(F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1)))).alias("at")) for c in ("removed", "added")]
    return parts[0].unionByName(parts[1]).select("doc_id", "change", "at.section", "at.paragraph", "hash")
