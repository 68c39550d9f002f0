"""Best-fit packing of documents into bins of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.scratch import written

CAPACITY = 8192
SHARD_PIECES = 50_000


def pack(sizes: list[int], capacity: int) -> list[int]:
    """A bin for each size in 1..capacity.

    Sizes above a third of the capacity go at most twice into a bin: from the largest down, each is matched with the largest
    one left that fits beside it. Smaller ones, from the largest down, go where the least room is left that suffices, or into a
    new bin. Of equal sizes the earlier comes first, of equal gaps the one that came to be last."""
    out = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    n_large = sum(3 * s > capacity for s in sizes)
    gaps: dict[int, list[int]] = {}
    bins = 0
    rising = order[:n_large][::-1]  # smallest first; of equal sizes the last
    values = [sizes[i] for i in rising]
    gone = [False] * n_large
    left = list(range(n_large + 1))  # left[k]: nearest place at or before k - 1 that isn't gone, plus one

    def find(k: int) -> int:
        root = k
        while left[root] != root:
            root = left[root]
        while left[k] != root:
            left[k], k = root, left[k]
        return root

    for k in range(n_large - 1, -1, -1):
        if gone[k]:
            continue
        gone[k], left[k + 1] = True, k
        room = capacity - values[k]
        out[rising[k]] = bins
        mate = find(min(k, bisect_left(values, room + 1))) - 1
        if mate >= 0:
            gone[mate], left[mate + 1] = True, mate
            out[rising[mate]] = bins
            room -= values[mate]
        gaps.setdefault(room, []).append(bins)
        bins += 1
    rooms = sorted(gaps)
    for i in order[n_large:]:
        k = bisect_left(rooms, sizes[i])
        if k < len(rooms):
            room = rooms[k]
            at = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[k]
        else:
            room, at, bins = capacity, bins, bins + 1
        out[i] = at
        room -= sizes[i]
        if room not in gaps:
            gaps[room] = []
            insort(rooms, room)
        gaps[room].append(at)
    return out


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("hash_", "ascending"), ("copy_", "ascending"), ("piece", "ascending")])
        bins = np.array(pack(table["n_chars"].to_pylist(), capacity), np.int64)
        shard = table["shard"].to_numpy().astype(np.int64)
        return table.select(["doc_id", "piece", "first_char", "n_chars"]).append_column("bin_id", pa.array((shard << 32) + bins))

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``(doc_id, piece, first_char, n_chars, bin_id)``: where each piece of each document goes.

    A text longer than ``capacity`` characters is cut into full pieces, each a bin of its own, and the rest. Pieces shorter
    than that are packed by ``pack`` within shards of about ``shard_pieces``, drawn by a hash of the piece; each shard
    leaves at most one more bin half empty than a single run would. ``bin_id`` is unique over all shards, and
    a bin's pieces sum to at most ``capacity``.

    Null and empty texts have no piece and give no row. Rows without an id are packed and carry none. Rows that repeat are
    packed each. Other columns are not read; lengths come from the texts. An empty table gives no rows."""
    size = F.length("text").cast("long")
    rows = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash_"), size.alias("size"))
    # rows alike in all of this take turns: each gets a number of its own, whichever of them it is
    counted = rows.groupBy("doc_id", "hash_", "size").agg(F.count("*").alias("times"))
    rows = written(counted.select("doc_id", "hash_", "size", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy_")), "sizes")
    pieces = rows.select("doc_id", "hash_", "copy_", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity))).alias("piece"))
    first = F.col("piece") * capacity
    pieces = pieces.select("doc_id", "hash_", "copy_", F.col("piece").cast("int").alias("piece"), first.alias("first_char"), F.least(F.col("size") - first, F.lit(capacity)).cast("int").alias("n_chars"))
    total = rows.agg(F.sum(F.ceil(F.col("size") / capacity))).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    placed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "hash_", "copy_", "piece"), F.lit(shards)))
    return placed.groupBy("shard").applyInArrow(_pack_shard(capacity), "doc_id long, piece int, first_char long, n_chars int, bin_id long")
