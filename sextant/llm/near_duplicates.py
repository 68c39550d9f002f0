"""Near duplicates by SimHash, searched in small-world graphs and verified on the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.smallworld import searched
from sextant.llm.words import bigrams, cuts, distinct, hash_strings, mix, rows_reduce, simhash, split_words, word_hashes
from sextant.operators.components import connected_components, min_labels
from sextant.scratch import written

RADIUS = 32
SIMILARITY = 0.6
#: Min-hashes of neighbouring words, each over its own share of them, by which nodes meet in shards.
ROUTES = 8
SHARD_ROWS = 24_000
#: Ids up to which the documents of candidate pairs are picked by a broadcast; beyond it by a shuffled join.
BROADCAST_IDS = 1_000_000

#: Bytes of a sketch: as many buckets of the neighbouring words' hashes, each with a byte of its least one.
SKETCH = 128
#: Spanning forests whose edges are verified, the second and third among what the first leaves unsure.
FORESTS = 3
#: Pairs of a shard held before those that sure edges already join are let go.
POOL_EDGES = 1_000_000
#: Edges left by the forests that one task verifies, and grams that it looks at at once.
PART_EDGES, PART_GRAMS = 1_000_000, 4_000_000

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIGNATURE = "doc_id long, c1 long, c2 long, s1 long, s2 long, sketch binary, routes array<long>"


def _least(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least hash of each row's grams in each of ``SKETCH`` buckets: uint64 [rows, SKETCH], ``_NONE`` for a bucket without any."""
    rows = len(bounds) - 1
    h = mix(grams, 31)
    bits = np.uint64(SKETCH.bit_length() - 1)
    least = np.full(rows * SKETCH, _NONE)
    place = np.repeat(np.arange(rows), np.diff(bounds)) * SKETCH + (h >> (np.uint64(64) - bits)).astype(np.int64)
    np.minimum.at(least, place, h << bits)
    return least.reshape(rows, SKETCH)


def _bytes(least: np.ndarray) -> np.ndarray:
    out = (mix(least, 32) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    out[least == _NONE] = 0
    return out


def sketches(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One-permutation min-hash of each row: uint8 [rows, SKETCH], 0 for a bucket without a hash."""
    return _bytes(_least(grams, bounds))


def estimated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of buckets that agree, of those that either row uses, and the number of these."""
    used = ((a | b) > 0).sum(1)
    return ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1), used


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in cuts(batch.column(1)):
            yield batch.slice(i, j - i)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        vocabulary, codes, bounds = split_words(batch.column(1))
        hashes = hash_strings(vocabulary)
        n = np.diff(bounds)
        place = np.arange(len(codes), dtype=np.uint64) - np.repeat(bounds[:-1], n).astype(np.uint64)
        content = [rows_reduce(np.add, mix(hashes[codes] + mix(place, salt), salt), bounds, 0) for salt in (11, 12)]
        words, ends = distinct(codes, bounds)
        code = simhash(hashes[words], ends)
        some = n > 0
        least = _least(*bigrams(hashes[codes], bounds))[some]
        routes = least.reshape(len(least), ROUTES, SKETCH // ROUTES).min(2)
        has = routes != _NONE
        routes = mix(routes + np.arange(ROUTES, dtype=np.uint64), 33)  # a hash in one share of the grams is no route of another
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)), pa.array(routes[has].view(np.int64)))
        longs = lambda *xs: [pa.array(np.ascontiguousarray(x)[some].view(np.int64)) for x in xs]
        columns = [batch.column(0).cast(pa.int64()).filter(pa.array(some)), *longs(*content, code[:, 0], code[:, 1]), pa.array([x.tobytes() for x in _bytes(least)], pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "c1", "c2", "s1", "s2", "sketch", "routes"])


def signatures(docs: DataFrame) -> DataFrame:
    """For every document with an id and a word: its content hash over the word sequence (letter case and
    white space aside), the 128-bit SimHash of its word set, and of its pairs of neighbouring words a sketch and up to ``ROUTES`` min-hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(_signatures, _SIGNATURE)


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a least spanning forest; ties go to the earlier edge."""
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    label, alive, chosen = np.arange(n), np.arange(len(a)), []
    while True:
        alive = alive[label[a[alive]] != label[b[alive]]]
        if not len(alive):
            return order[np.unique(np.concatenate(chosen))] if chosen else np.zeros(0, np.int64)
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[alive]], alive)
        np.minimum.at(best, label[b[alive]], alive)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        x, y = label[a[pick]], label[b[pick]]
        while (x != y).any():
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (jump := label[label]).tobytes() != label.tobytes():
                label = jump
            x, y = label[a[pick]], label[b[pick]]


def _margin(used: np.ndarray, similarity: float) -> np.ndarray:
    """Four standard deviations of an estimate at ``similarity``."""
    return 4 * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))


def _weight(est: np.ndarray) -> np.ndarray:
    return np.round((1 - est) * 1000).astype(np.int64)


def _estimates(a: np.ndarray, b: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*(estimated(sketch[a[i : i + 65536]], sketch[b[i : i + 65536]]) for i in range(0, max(1, len(a)), 65536))))


def likely(a: np.ndarray, b: np.ndarray, sketch: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """Places of the edges to verify first, see ``narrowed``."""
    return narrowed(a, b, sketch, n, similarity)[0]


def narrowed(a: np.ndarray, b: np.ndarray, sketch: np.ndarray, n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the edges to verify first, at most ``FORESTS`` times as many as nodes, and of those that are left: they
    are to be verified too, unless the first have joined their ends.

    Edges whose sketches are four standard deviations below ``similarity`` are out. Of the others the spanning forest of most alike edges
    is taken, so that no edge to something else stands in for one between copies. Where it joins what the sketches can't tell for
    sure, a failed edge may hide another, so further forests are taken of the edges between what is surely joined."""
    est, used = _estimates(a, b, sketch)
    margin = _margin(used, similarity)
    left = np.flatnonzero(est >= similarity - margin)
    out = []
    for _ in range(FORESTS):
        pick = left[spanning(a[left], b[left], _weight(est[left]), n)]
        out.append(pick)
        sure = np.concatenate(out)
        sure = sure[est[sure] >= similarity + margin[sure]]
        label = min_labels(a[sure], b[sure], n)
        left = np.setdiff1d(left[label[a[left]] != label[b[left]]], pick)
        if not len(left):
            break
    return np.concatenate(out), left


class Pool:
    """Candidate edges of a shard as they are found. What can't be alike by its sketches is not held, and beyond ``most`` edges
    only a spanning forest of the most alike and the edges between what no sure edge joins."""

    def __init__(self, sketch: np.ndarray, similarity: float, most: int = POOL_EDGES):
        self.sketch, self.similarity, self.most = sketch, similarity, most
        self.parts: list[np.ndarray] = []
        self.held = self.limit = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.minimum(a, b), np.maximum(a, b)
        for i in range(0, len(a), 65536):
            x, y = a[i : i + 65536], b[i : i + 65536]
            est, used = estimated(self.sketch[x], self.sketch[y])
            good = (x != y) & (est >= self.similarity - _margin(used, self.similarity))
            self.parts.append(np.stack([x[good], y[good]]))
            self.held += int(good.sum())
            if self.held > max(self.most, self.limit):
                self.reduce()
                self.limit = 2 * self.held

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((2, 0), np.int64)
        n = len(self.sketch)
        key = np.unique(pairs[0] * n + pairs[1])
        self.parts, self.held = [np.stack([key // n, key % n])], len(key)
        return key // n, key % n

    def reduce(self) -> None:
        a, b = self.edges()
        est, used = _estimates(a, b, self.sketch)
        n = len(self.sketch)
        keep = np.zeros(len(a), bool)
        keep[spanning(a, b, _weight(est), n)] = True
        sure = est >= self.similarity + _margin(used, self.similarity)
        label = min_labels(a[sure], b[sure], n)
        keep |= ~sure & (label[a] != label[b])
        self.parts, self.held = [np.stack([a[keep], b[keep]])], int(keep.sum())


def _search_shard(radius: int, beam: int, similarity: float):
    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("s1", "ascending")])
        ids, member = table["rep"].to_numpy(), table["member"].to_numpy()
        codes = np.stack([table[c].to_numpy() for c in ("s1", "s2")], axis=1).view(np.uint64)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        _, first, place = np.unique(np.concatenate([codes, sketch.view(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
        kind = first[place.ravel()]  # the row of the least id with this code and sketch
        known = np.zeros(len(ids), bool)
        known[kind[member]] = True
        heads = np.unique(kind)
        nodes = heads[known[heads]]
        pool = Pool(sketch, similarity)
        recall = searched(codes[nodes], codes[heads], radius, lambda q, node: pool.add(heads[q], nodes[node]), beam)
        a, b = pool.edges()
        more = np.zeros(0, bool)
        if len(a):
            keep, left = narrowed(a, b, sketch, len(ids), similarity)
            more = np.repeat([False, True], [len(keep), len(left)])
            keep = np.concatenate([keep, left])
            a, b = a[keep], b[keep]
        same = np.flatnonzero(kind != np.arange(len(ids)))  # alike in code and sketch: linked to the first of them
        a, b, more = np.concatenate([a, kind[same]]), np.concatenate([b, same]), np.concatenate([more, np.zeros(len(same), bool)])
        shard = np.full(len(a), table["shard"][0].as_py(), np.int64)
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b]), "recall": pa.array(np.full(len(a), recall)), "more": pa.array(more), "shard": pa.array(shard)})

    return search


def candidate_edges(nodes: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, beam: int = 12, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(a, b, recall, more, shard)``: of each shard's pairs within ``radius`` those that ``narrowed`` picks or, with ``more``, leaves,
    and the shard's audited recall.

    A node enters a shard by each of its min-hashes that other nodes have too, and queries every other node there. Two texts share a min-hash with a
    probability of their Jaccard similarity s, so they miss each other with one of (1 - s) ** ``ROUTES``, 0.0007 at 0.6, at any size of the table.
    Rare min-hashes fill shards of ``shard_rows`` nodes together. The nodes of one that more nodes have are cut into graphs
    of that size, and each node's query goes to all of them."""
    every = nodes.select("rep", F.explode("routes").alias("key"))
    size = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(every.join(size, "key").select("rep", "key", "n"), "met")
    total = met.where(F.col("n") <= shard_rows).count()
    shards = F.lit(max(1, -(-total // shard_rows)))
    parts = F.ceil(F.col("n") / shard_rows).cast("int")
    own = F.when(parts > 1, F.pmod(F.xxhash64("rep", F.lit(5)), parts)).otherwise(0).cast("int")
    rows = met.select("rep", "key", parts.alias("parts"), own.alias("own"))
    rows = rows.select("*", F.explode(F.sequence("own", F.col("parts") - 1)).alias("part"))  # of two parts the earlier one's nodes query the later one
    shard = F.when(F.col("parts") > 1, F.xxhash64("key", "part")).otherwise(F.pmod("key", shards))
    rows = rows.select("rep", (F.col("part") == F.col("own")).alias("member"), shard.alias("shard")).distinct()
    rows = rows.join(nodes.select("rep", "s1", "s2", "sketch"), "rep")
    return rows.groupBy("shard").applyInArrow(_search_shard(radius, beam, similarity), "a long, b long, recall double, more boolean, shard long")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        values, bounds = distinct(*bigrams(*word_hashes(batch.column(1))))
        low = (values >> np.uint64(32)).astype(np.uint32)
        grams = [np.unique(low[i:j]).tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["doc_id", "grams"])


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = (np.frombuffer(z.as_buffer(), np.uint32) for z in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(1, len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def gram_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, grams)`` of the documents whose id is in the one column of ``ids``."""
    ids = written(ids.toDF("id_"), "ids")
    picked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return written(rows.join(picked, F.col("doc_id") == F.col("id_"), "left_semi").mapInArrow(_grams, "doc_id long, grams binary"), "grams")


def verified_edges(docs: DataFrame, edges: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The edges whose documents' whole sets of neighbouring words have a Jaccard similarity of ``similarity`` or more."""
    grams = gram_sets(docs, edges.select("a").union(edges.select("b")).distinct())
    left, right = grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
    pairs = edges.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return pairs.mapInArrow(_similarities, "a long, b long, similarity double").where(F.col("similarity") >= similarity)


def _verify_part(similarity: float):
    def verify(edges: pa.Table, members: pa.Table) -> pa.Table:
        order = np.argsort(members["node"].to_numpy(), kind="stable")
        node = members["node"].to_numpy()[order]
        sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in members["grams"].take(pa.array(order))]
        size = np.array([len(x) for x in sets], np.int64)
        values, codes = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint32), return_inverse=True)
        codes, start = codes.ravel().astype(np.int32), np.concatenate([[0], np.cumsum(size)])
        rank = np.argsort(edges["a"].to_numpy(), kind="stable")
        a, b = edges["a"].to_numpy()[rank], edges["b"].to_numpy()[rank]
        flag, good = np.zeros(len(values), bool), np.zeros(len(a), bool)
        heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
        for i, j in zip(heads, [*heads[1:], len(a)]):
            lo, n = np.searchsorted(node, b[i:j]), np.searchsorted(node, b[i:j], side="right") - np.searchsorted(node, b[i:j])
            edge = np.repeat(np.arange(i, j), n)
            row = np.repeat(lo, n) + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
            cuts = np.flatnonzero(np.diff(np.cumsum(size[row]) // PART_GRAMS)) + 1
            for own in range(np.searchsorted(node, a[i]), np.searchsorted(node, a[i], side="right")):
                flag[codes[start[own] : start[own + 1]]] = True
                for e, r in zip(np.split(edge, cuts), np.split(row, cuts)):
                    ends = np.cumsum(size[r])
                    grams = np.repeat(start[r] - (ends - size[r]), size[r]) + np.arange(ends[-1] if len(ends) else 0)
                    total = np.concatenate([[0], np.cumsum(flag[codes[grams]])])
                    both = total[ends] - total[ends - size[r]]
                    good[e[both / np.maximum(1, size[own] + size[r] - both) >= similarity]] = True
                flag[codes[start[own] : start[own + 1]]] = False
        a, b = a[good], b[good]
        known, ends = np.unique(np.concatenate([edges[c].to_numpy()[rank][good] for c in ("ca", "cb")]), return_inverse=True)
        some = spanning(ends.ravel()[: len(a)], ends.ravel()[len(a) :], np.zeros(len(a), np.int64), len(known))
        return pa.table({"a": pa.array(a[some], pa.int64()), "b": pa.array(b[some], pa.int64())})

    return verify


def verified_rest(docs: DataFrame, rest: DataFrame, edges: DataFrame, similarity: float = SIMILARITY, part_edges: int = PART_EDGES) -> DataFrame:
    """``(a, b)``: the copies among all edges of ``rest`` (``a, b, shard``) whose ends ``edges`` doesn't join, as far as needed to join them.

    The sets of neighbouring words go to each part of a shard once, not to each edge; a part has about ``part_edges`` edges."""
    label = connected_components(edges)
    for end in ("a", "b"):
        to = label.select(F.col("node").alias(end), F.col("component").alias("at_"))
        rest = rest.join(to, end, "left").withColumn(f"c{end}", F.coalesce("at_", end)).drop("at_")
    open_ = written(rest.where("ca <> cb").groupBy("a", "b").agg(F.min("shard").alias("shard"), F.first("ca").alias("ca"), F.first("cb").alias("cb")), "open")
    most = open_.groupBy("shard").count().agg(F.max("count")).first()[0]
    if not most:
        return edges.select("a", "b").limit(0)
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(-(-most // part_edges))))
    members = open_.select(F.col("a").alias("node"), "shard", "part").union(open_.select("b", "shard", "part")).distinct()
    grams = gram_sets(docs, members.select("node").distinct()).withColumnRenamed("doc_id", "node")
    sides = open_.groupBy("shard", "part"), members.toDF("node", "in_shard", "in_part").join(grams, "node").groupBy("in_shard", "in_part")
    return sides[0].cogroup(sides[1]).applyInArrow(_verify_part(similarity), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, beam: int = 12, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Groups of near copies: ``(doc_id, group_id, n_links, keep)`` for each document of a group of two or more; any other is a group of its own and has no row.

    Documents with one word sequence (letter case and white space aside) are copies. The distinct ones enter shards and are
    searched for others within ``radius`` of 128 bits; candidate edges are verified on the whole texts and unioned: forests of
    the most alike first, then every other edge between what these have not joined. So no link between different groups is left, while within
    a group not every pair is looked at. ``n_links`` counts the verified links at the document that hold its group together; a copy has one, to the
    first document with its words. ``group_id`` is the smallest doc_id of the group, the only one with ``keep``.

    Rows without an id or without a word belong to no group. Rows that repeat a doc_id are one document, alike in
    whatever its texts match. Ties of distance don't matter: all pairs within the radius count. Other columns, whatever their names,
    are not read. An empty table gives no rows."""
    signed = written(signatures(docs), "signatures")
    parts = ["c1", "c2"]
    nodes = written(signed.groupBy(*parts).agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("s1", "s2", "sketch", "routes"))), "nodes")
    copies = signed.select("doc_id", *parts).join(nodes.select("rep", *parts), parts).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = written(candidate_edges(nodes, radius, similarity, beam, shard_rows).where("a <> b"), "candidates")
    first = found.where("not more").select("a", "b").distinct()
    edges = written(verified_edges(docs, first, similarity).select("a", "b").union(copies), "verified")
    edges = written(edges.union(verified_rest(docs, found.where("more"), edges, similarity)).distinct(), "links")
    ends = edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    groups = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))
    return groups.join(ends, "doc_id").select("doc_id", "group_id", "n_links", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group; rows without an id or a word stay."""
    gone = near_duplicates(docs, **options).where("not keep").select(F.col("doc_id").alias("gone_"))
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti")
