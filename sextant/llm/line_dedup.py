"""Line dedup: documents that share rare runs of lines are aligned with patience diff."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.scratch import written

MIN_BLOCK_CHARS = 120
RARE = 8
#: Lines of both sides that are aligned at once.
SLICE_LINES = 500_000
_KEY = ["id_", "th_"]


def patience_matches(a: list, b: list, blank=0) -> list[tuple[int, int]]:
    """Aligned places (i, j) of two line sequences, in order.

    Equal lines at both ends match; then lines that each side has once anchor the alignment along their
    longest increasing subsequence, and the gaps between anchors are aligned alike. A gap without such lines stays
    unmatched. ``blank`` lines never anchor."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo += 1
            blo += 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi -= 1
            bhi -= 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        many, place = Counter(a[alo:ahi]), {}
        for j in range(blo, bhi):
            place[b[j]] = -1 if b[j] in place else j
        pairs = [(i, place[a[i]]) for i in range(alo, ahi) if a[i] != blank and many[a[i]] == 1 and place.get(a[i], -1) >= 0]
        if not pairs:
            continue
        tops, at, back = [], [], []
        for n, (_, j) in enumerate(pairs):
            k = bisect_left(tops, j)
            back.append(at[k - 1] if k else -1)
            tops[k : k + 1], at[k : k + 1] = [j], [n]
        n, chain = at[-1], []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        for i, j in chain:  # from the last anchor to the first
            todo.append((i, ahi, j, bhi))
            ahi, bhi = i, j
        todo.append((alo, ahi, blo, bhi))
    return sorted(out)


def common_blocks(a: list, b: list, chars: list, least: int = MIN_BLOCK_CHARS, blank=0) -> list[int]:
    """Places in ``b`` of aligned blocks, runs of neighbouring matches with ``least`` characters (``chars`` per line of ``b``)."""
    gone, block = [], []
    for i, j in [*patience_matches(a, b, blank), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(chars[y] for _, y in block) >= least:
                gone += [y for _, y in block]
            block = []
        block.append((i, j))
    return gone


def windows(lines: pa.ListArray, chars: pa.ListArray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first place, place after the last and hash of the shortest runs of lines with ``least`` characters that start
    or end at a line that isn't blank. A block that two documents share and that has so many characters is made of such runs, blank lines at its ends aside.
    Places count through all rows."""
    bounds = lines.offsets.to_numpy().astype(np.int64) - lines.offsets[0].as_py()
    h, c = lines.flatten().to_numpy().view(np.uint64), chars.flatten().to_numpy().astype(np.int64)
    total = np.concatenate([[0], np.cumsum(c)])
    row = np.repeat(np.arange(len(lines)), np.diff(bounds))
    place = np.arange(len(row))
    end = np.searchsorted(total, total[place] + least, side="left")
    start = np.searchsorted(total, total[place + 1] - least, side="right") - 1
    ahead, back = (c > 0) & (end <= bounds[row + 1]), (c > 0) & (start >= bounds[row])
    row, first, last = np.concatenate([row[ahead], row[back]]), np.concatenate([place[ahead], start[back]]), np.concatenate([end[ahead], place[back] + 1])
    powers = np.uint64(0x9E3779B97F4A7C15)
    key = np.zeros(len(first), np.uint64)
    step, open_ = first.copy(), np.arange(len(first))
    while len(open_):
        key[open_] = (key[open_] ^ h[step[open_]]) * powers
        key[open_] ^= key[open_] >> np.uint64(29)
        step[open_] += 1
        open_ = open_[step[open_] < last[open_]]
    return row, first, last, key


def _runs(least: int):
    """The hashes of each document's ``windows``."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, _, key = windows(batch.column(2), batch.column(3), least)
            row_key = np.unique(np.stack([row.astype(np.uint64), key], axis=1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
            rows = pa.array(row_key[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(row_key[:, 1].view(np.int64))], ["id_", "th_", "run"])

    return runs


def _covered(bounds: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Per row the places, from the row's start, that lie in one of the spans."""
    depth = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    gone = np.cumsum(depth)[:-1] > 0
    return [np.flatnonzero(gone[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]


_SALT = np.uint64(0xD6E8FEB86659FD93)


def shared_runs(earlier: pa.ListArray, earlier_chars: pa.ListArray, later: pa.ListArray, chars: pa.ListArray, least: int) -> list[np.ndarray]:
    """Per row the places in ``later`` of all ``windows`` that ``earlier`` has too, wherever and however often."""
    row, _, _, key = windows(earlier, earlier_chars, least)
    return _places(later, chars, key, row, least)


def _places(lines: pa.ListArray, chars: pa.ListArray, key: np.ndarray, row: np.ndarray, least: int) -> list[np.ndarray]:
    """Per row the places of its ``windows`` with a hash that ``key`` has for that ``row``."""
    known = key + row.astype(np.uint64) * _SALT
    row, first, last, key = windows(lines, chars, least)
    hit = np.isin(key + row.astype(np.uint64) * _SALT, known)
    return _covered(lines.offsets.to_numpy().astype(np.int64) - lines.offsets[0].as_py(), first[hit], last[hit])


def _slices(batch: pa.RecordBatch, *lists: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``SLICE_LINES`` lines in the columns ``lists``."""
    size = np.cumsum(sum(np.diff(batch.column(k).offsets.to_numpy()) for k in lists))
    cuts = np.flatnonzero(np.diff(size // SLICE_LINES)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(batch)]):
        yield batch.slice(i, j - i)


def _gone(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
    some = pa.array([len(g) > 0 for g in gone], pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some), pa.array([g for g in gone if len(g)], pa.list_(pa.int32()))], ["id_", "th_", "gone"])


def _delete(least: int):
    """The places of each document's runs that are listed beside its lines."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2):
                runs = batch.column(4)
                key, row = runs.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
                yield _gone(batch, _places(batch.column(2), batch.column(3), key, row, least))

    return delete


def _align(least: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2, 4):
                earlier, later, chars = (batch.column(k) for k in (2, 4, 5))
                blocks = [common_blocks(x.values.to_pylist(), y.values.to_pylist(), z.values.to_pylist(), least) for x, y, z in zip(earlier, later, chars)]
                yield _gone(batch, [sorted({*g, *r.tolist()}) for g, r in zip(blocks, shared_runs(earlier, batch.column(3), later, chars, least))])

    return align


def line_table(docs: DataFrame) -> DataFrame:
    """Per distinct document: its key, and the hash (0 if blank) and length of each trimmed line."""
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.trim(F.regexp_replace(x, "\r$", "")))
    rows = docs.where("text is not null and doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("id_"), F.xxhash64("text").alias("th_"), trimmed.alias("l"))
    return rows.select(*_KEY, F.transform("l", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("lines"), F.transform("l", F.length).alias("chars"))


def overlapping(runs: DataFrame, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(id_, th_, eid_, eth_)`` of a later and an earlier document that share a rare run of lines, one that at most ``rare``
    documents have; and the commoner runs ``(id_, th_, runs)`` of each document that isn't the first to have them.

    A common run needs no partner: all but the first lose it wherever they have it, which is what an alignment with the first and
    ``shared_runs`` would come to. So no document's lines go to more partners than its rare runs have holders."""
    doc = F.struct(*_KEY)
    stats = runs.groupBy("run").agg(F.count("*").alias("df"), F.min(doc).alias("first")).where("df > 1")
    shared = runs.join(stats, "run")
    common = shared.where(F.col("df") > rare).where(doc > F.col("first")).groupBy(*_KEY).agg(F.collect_list("run").alias("runs"))
    groups = shared.where(F.col("df") <= rare).groupBy("run").agg(F.sort_array(F.collect_list(doc)).alias("docs"))
    pairs = groups.select(F.posexplode("docs").alias("k", "d"), "docs").select("d", F.explode(F.slice("docs", F.lit(1), F.col("k"))).alias("e"))
    return pairs.select("d.*", "e.id_", "e.th_").toDF(*_KEY, "eid_", "eth_").distinct(), common


def deletions(docs: DataFrame, min_block_chars: int = MIN_BLOCK_CHARS, rare: int = RARE) -> DataFrame:
    """``(id_, th_, gone)``: the places of the lines to delete from each later document."""
    lines = written(line_table(docs), "lines")
    runs = written(lines.mapInArrow(_runs(min_block_chars), "id_ long, th_ long, run long").distinct(), "runs")
    pairs, common = (written(x, name) for x, name in zip(overlapping(runs, rare), ("pairs", "common")))
    sides = lines.dropDuplicates(_KEY)
    early = sides.select(F.col("id_").alias("eid_"), F.col("th_").alias("eth_"), F.col("lines").alias("earlier"), F.col("chars").alias("earlier_chars"))
    schema = "id_ long, th_ long, gone array<int>"
    both = pairs.join(early, ["eid_", "eth_"]).join(sides, _KEY).select(*_KEY, "earlier", "earlier_chars", "lines", "chars")
    found = both.mapInArrow(_align(min_block_chars), schema).union(sides.join(common, _KEY).select(*_KEY, "lines", "chars", "runs").mapInArrow(_delete(min_block_chars), schema))
    return found.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def line_dedup(docs: DataFrame, min_block_chars: int = MIN_BLOCK_CHARS, rare: int = RARE) -> DataFrame:
    """``docs`` with common blocks deleted from the later document, ``n_chars`` set anew where lines went (if there
    is such a column), and ``removed_lines``, ``removed_chars``.

    Documents are ordered by (doc_id, hash of the text). Two overlap if they share a run of whole lines with
    ``min_block_chars`` characters, spaces and carriage returns at the ends of lines aside. Those that share a rare one are aligned (``overlapping``):
    the later document loses each block with so many characters, and each run with so many that the earlier
    one has in another order or more than once. A common run goes from all but the first that has it; shorter shared lines, such as common short sentences, stay.

    Rows without id or text, and empty texts, pass unchanged with 0 removed. Rows equal in id and text are one document and
    lose the same lines; rows of one id with different texts are different documents. Lines repeated within a document
    stay if no earlier document has them. A document that only has deleted lines keeps an empty text. Extra columns pass through; columns named
    ``removed_lines`` or ``removed_chars``, in any case, are replaced. An empty table gives an empty one."""
    columns = [c for c in docs.columns if c.lower() not in ("removed_lines", "removed_chars")]
    gone = deletions(docs, min_block_chars, rare).withColumnsRenamed({"id_": "ld_id", "th_": "ld_hash", "gone": "ld_gone"})
    hit = docs.join(gone, (docs["doc_id"] == gone["ld_id"]) & (F.xxhash64(docs["text"]) == gone["ld_hash"]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(gone["ld_gone"], i)), "\n")
    text = F.when(gone["ld_gone"].isNull(), docs["text"]).otherwise(kept)
    out = []
    for c in columns:
        if c.lower() == "text":
            out.append(text.alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(gone["ld_gone"].isNull(), docs[c]).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(docs[c])
    return hit.select(*out, F.coalesce(F.size(gone["ld_gone"]), F.lit(0)).alias("removed_lines"), F.coalesce(F.length(docs["text"]) - F.length(text), F.lit(0)).alias("removed_chars"))
