"""Scores of vectors by whole matrix products inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.operators.components import min_labels

#: Bytes of vectors up to which a side is broadcast and the other one scanned; beyond it both meet in a grid of strips.
BROADCAST_BYTES = 8 << 20
#: Bytes of a strip's vectors in double precision: a cell of the grid multiplies two strips.
STRIP_BYTES = 64 << 20
#: Cells that a grid has at least, as far as its strips stay above so many bytes.
CELLS, LEAST_STRIP = 48, 4 << 20
#: Pairs of rows that a cell has at most: 64 MB of short vectors are many rows, and a task takes as long as it has pairs.
CELL_PAIRS = 1 << 31
#: Scores that are worked out at once in double precision, and rows by columns of those in single precision, which stay in a core's cache.
SCORES, TILE = 1 << 20, (256, 1024)
#: Rows that one task ranks.
RANKED_ROWS = 1 << 20


def native(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix [rows, size] in its own precision; rows must agree in size."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in size")
    return (flat if flat.dtype in (np.float32, np.float64) else flat.astype(np.float64)).reshape(len(column), -1)


def matrix(column: pa.Array) -> np.ndarray:
    """``native`` in double precision."""
    return native(column).astype(np.float64)


def _agree(a: np.ndarray, b: np.ndarray) -> None:
    if len(a) and len(b) and a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of {a.shape[1]} and {b.shape[1]} dimensions")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _agree(a, b)
    return np.round(a @ b.T, 6) if len(a) and len(b) else np.zeros((len(a), len(b)))


def _below(bound: np.ndarray, kind: np.dtype) -> np.ndarray:
    """A bound as a number of ``kind`` that isn't above it: compared with one of another kind, all products would be converted first."""
    with np.errstate(over="ignore"):
        return np.nextafter(np.asarray(bound).astype(kind), kind.type(-np.inf)) if bound.dtype != kind else bound


def _longest(x: np.ndarray) -> float:
    """The largest length of a row, of those that are finite."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)) if len(x) else np.zeros(0)
    return float(norms[np.isfinite(norms)].max(initial=0.0))


class Tiles:
    """Products of two matrices by tiles in single precision. They differ from the rounded scores by ``slack`` at most, so what is
    below a bound by more than that needs no score; the rest gets one in double precision."""

    def __init__(self, x: np.ndarray, y: np.ndarray, lengths: tuple[float, float] | None = None):
        _agree(x, y)
        nx, ny = lengths or (_longest(x), _longest(y))
        kind = np.float32 if max(nx, ny, nx * ny) < 1e18 else np.float64
        self.x, self.y = x, y
        self.one, self.two = np.ascontiguousarray(x, kind), np.ascontiguousarray(y, kind)
        self.slack = 2e-6 + (x.shape[1] + 8) * float(np.finfo(kind).eps) * nx * ny
        self.scores, self.over = np.empty(TILE[0] * TILE[1], kind), np.empty(TILE[0] * TILE[1] + 8, bool)

    def multiplied(self, rows: slice, columns: slice) -> np.ndarray:
        a, b = self.one[rows], self.two[columns]
        return np.matmul(a, b.T, out=self.scores[: len(a) * len(b)].reshape(len(a), len(b)))

    def near(self, rows: slice, columns: slice, least: np.ndarray | float, s: np.ndarray | None = None, down: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns (from the tile's corner) and products of a tile whose scores may be ``least`` or more, which each row, or ``down`` each
        column, may have for itself."""
        s = self.multiplied(rows, columns) if s is None else s
        bound = _below(np.asarray(least) - self.slack, s.dtype)
        n = s.size
        over = self.over[: n + 7 & ~7]
        over[n:] = False
        np.greater_equal(s, bound[:, None] if bound.ndim and not down else bound, out=over[:n].reshape(s.shape))
        words = np.flatnonzero(over.view(np.uint64) != 0)  # eight at a time
        w, b = np.nonzero(over.reshape(-1, 8)[words])
        at = words[w] * 8 + b
        return *np.divmod(at, s.shape[1]), s.reshape(-1)[at]

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of rows of the one with rows of the other."""
        out = [np.einsum("ij,ij->i", self.x[r[at]], self.y[c[at]], dtype=np.float64) for at in _steps(len(r), 1 << 15)]
        return np.round(np.concatenate(out), 6) if out else np.zeros(0)

    def hits(self, rows: slice, columns: slice, least: np.ndarray | float, s: np.ndarray | None = None, down: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and scores of ``least`` or more."""
        r, c, _ = self.near(rows, columns, least, s, down)
        v = self.exact(r + rows.start, c + columns.start)
        keep = v >= (least[c if down else r] if np.ndim(least) else least)
        return r[keep], c[keep], v[keep]


def _steps(n: int, step: int) -> Iterator[slice]:
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def vector_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and bytes of its ``vector`` in double precision."""
    n, size = df.agg(F.count("vector"), F.sum(F.size("vector").cast("long") * 8)).first()
    return n, size or 0


def strips(counted: tuple[int, int], key: str, rows: int | None = None, count: int | None = None) -> tuple[int, Column]:
    """How many strips so many rows and bytes are cut into, and each row's."""
    n, size = counted
    rows = rows or max(1, STRIP_BYTES * max(1, n) // max(1, size))
    n = count or max(1, -(-n // rows))
    return n, F.pmod(F.xxhash64(key, F.lit(3)), F.lit(n)).cast("int")


def _cut(sizes: tuple[tuple[int, int], tuple[int, int]], one: bool, rows: int | None) -> tuple[int, int]:
    """Strips of both sides: small enough for memory, with cells enough for a cluster to share and none that takes much longer as the sides grow."""
    n, m = (strips(s, "id", rows)[0] for s in sizes)
    while not rows:
        left, right = sizes[0][1] / n, sizes[1][1] / m
        few = (n * (n + 1) // 2 if one else n * m) < CELLS and max(left, right) >= 2 * LEAST_STRIP
        if not few and sizes[0][0] / n * (sizes[1][0] / m) <= CELL_PAIRS:
            break
        n, m = (n + 1, m + 1) if one else (n + 1, m) if left >= right else (n, m + 1)
    return n, m


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), "vector")


def _gathered(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table that was checked to be small."""
    table = df.select("id", "vector").toArrow().combine_chunks()
    return table["id"].to_numpy(), native(table["vector"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.float64())))


def _cuts(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, SCORES // max(1, columns))
    return (slice(i, i + step) for i in range(0, rows, step))


def _batch(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.float64())], ["a", "b", "score"])


class Pairs:
    """Pairs of ``threshold`` or more as they are found, in batches; with ``most`` only the best so many, by score and then ids, with
    ``forest`` so many that what they join is the same."""

    def __init__(self, threshold: float, most: int | None, forest: bool = False):
        self.threshold, self.most, self.forest, self.parts, self.n = threshold, most, forest, [], 0
        self.full = max(1 << 16, 2 * (most or 0))

    def add(self, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.parts.append((a, b, v))
            self.n += len(a)
        if self.n > self.full:
            yield from self.rest()

    def rest(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        a, b, v = (np.concatenate(z) for z in zip(*self.parts))
        self.parts, self.n = [], 0
        if self.most is not None:
            first = np.lexsort((b, a, -v))[: self.most]
            a, b, v = a[first], b[first], v[first]
            if len(a) == self.most:
                self.threshold = max(self.threshold, v[-1])
        if self.forest:
            nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
            first = nodes[min_labels(places[: len(a)], places[len(a) :], len(nodes))]
            a, b, v = first[first != nodes], nodes[first != nodes], np.full((first != nodes).sum(), np.nan)
            self.full = max(self.full, 2 * len(a))
        if not last and (self.forest or self.most is not None):
            self.parts, self.n = [(a, b, v)], len(a)
            return
        yield _batch(a, b, v)


def pairs_over(left: DataFrame, right: DataFrame | None, threshold: float, strip_rows: int | None = None, broadcast_bytes: int | None = None, most: int | None = None, forest: bool = False) -> DataFrame:
    """``(a, b, score)`` of all pairs with a cosine of ``threshold`` or more; ``left`` and ``right`` are ``(id, vector)``.

    Without ``right``, pairs a < b within ``left``. A side that is checked to be small goes to every task, which multiplies its batches of the
    other side with it: nothing is shuffled. Beyond that each row goes to one row or column of a grid of strips, as often as the other side has
    strips, and each cell is one product of matrices: memory per task doesn't grow with the data.
    Rows with a null id or vector take part in no pair. With ``most`` each task returns only its best so many, among
    which are the best so many of all; with ``forest`` each returns edges, without scores, that join the same rows as its pairs."""
    broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    one, left = right is None, _pairs(left)
    right = left if one else _pairs(right)
    size = vector_bytes(left)
    sizes = size, size if one else vector_bytes(right)
    turned = sizes[0][1] < sizes[1][1]
    schema = "a long, b long, score double"

    def met(found: Pairs, a, x, b, y, same: bool, tiles: Tiles | None = None) -> Iterator[pa.RecordBatch]:
        tiles = tiles or Tiles(x, y)
        for rows in _steps(len(a), TILE[0]):
            for columns in _steps(len(b), TILE[1]):
                if same and columns.stop <= rows.start:
                    continue
                r, c, v = tiles.hits(rows, columns, found.threshold)
                p, q = a[rows][r], b[columns][c]
                if same:
                    keep = r + rows.start < c + columns.start
                    p, q, v = p[keep], q[keep], v[keep]
                if one:
                    keep = p != q
                    p, q, v = np.minimum(p, q)[keep], np.maximum(p, q)[keep], v[keep]
                yield from found.add(p, q, v)

    if min(sizes[0][1], sizes[1][1]) > broadcast_bytes:

        def cell(a, x, b, y, same):
            found = Pairs(threshold, most, forest)
            if same:
                b, y = a, x
            yield from met(found, a, x, b, y, same)
            yield from found.rest(True)

        return _grid(left, None if one else right, sizes, cell, schema, strip_rows)
    shared = left.sparkSession.sparkContext.broadcast(_gathered(left if turned else right))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        found = Pairs(threshold, most, forest)
        length = _longest(vectors)
        for batch in batches:
            a, x = batch.column(0).to_numpy(), native(batch.column(1))
            if not len(a) or not len(ids):
                continue
            tiles = Tiles(x, vectors, (_longest(x), length))
            for rows in _steps(len(a), TILE[0]):
                for columns in _steps(len(ids), TILE[1]):
                    r, c, v = tiles.hits(rows, columns, found.threshold)
                    p, q = a[rows][r], ids[columns][c]
                    if one:
                        keep = p < q
                        p, q, v = p[keep], q[keep], v[keep]
                    yield from found.add(*((q, p) if turned else (p, q)), v)
        yield from found.rest(True)

    return (right if turned else left).mapInArrow(scan, schema)


def _raised(top: np.ndarray, tiles: Tiles, other: np.ndarray | None = None) -> None:
    """The best score of each row, where it is more than ``top`` has, and of each column, where it is more than ``other`` has."""
    for rows in _steps(len(tiles.x), TILE[0]):
        for columns in _steps(len(tiles.y), TILE[1]):
            s = tiles.multiplied(rows, columns)
            for down, own, at in ((False, top, rows), (True, other, columns)):
                if own is not None:
                    best = s.max(0 if down else 1) - tiles.slack  # of the tile; the best so far may be above all of it
                    *places, v = tiles.hits(rows, columns, np.maximum(own[at], np.where(np.isnan(best), -np.inf, best)), s, down)
                    np.maximum.at(own, places[down] + at.start, v)


def best_over(left: DataFrame, right: DataFrame, strip_rows: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """``(a, score)``: for every row of ``left`` the largest cosine with ``right``; minus infinity if that is empty. See ``pairs_over``."""
    most = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    every = left.select(F.col("id").cast("long").alias("a"))
    left, right = _pairs(left), _pairs(right)
    sizes = vector_bytes(left), vector_bytes(right)

    def found_in(a, top):
        some = top > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(a[some], pa.int64()), pa.array(top[some])], ["a", "score"])

    if min(sizes[0][1], sizes[1][1]) > most:

        def cell(a, x, b, y, same):
            top = np.full(len(a), -np.inf)
            _raised(top, Tiles(x, y))
            yield found_in(a, top)

        found = _grid(left, right, sizes, cell, "a long, score double", strip_rows)
    else:
        turned = sizes[0][1] < sizes[1][1]
        shared = every.sparkSession.sparkContext.broadcast(_gathered(left if turned else right))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            top = np.full(len(ids), -np.inf)
            length = _longest(vectors)
            for batch in batches:
                a, x = batch.column(0).to_numpy(), native(batch.column(1))
                if not len(a) or not len(ids):
                    continue
                lengths = _longest(x), length
                if turned:  # the best so far of each row that all tasks have
                    _raised(top, Tiles(vectors, x, lengths[::-1]))
                else:
                    own = np.full(len(a), -np.inf)
                    _raised(own, Tiles(x, vectors, lengths))
                    yield found_in(a, own)
            if turned:
                yield found_in(ids, top)

        found = (right if turned else left).mapInArrow(scan, "a long, score double")
    found = found.groupBy("a").agg(F.max("score").alias("score"))
    return every.join(found, "a", "left").select("a", F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def best_of_both(left: DataFrame, right: DataFrame, strip_rows: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """``(other, a, score)``: ``best_over`` of ``left`` with ``right`` and, as ``other``, of ``right`` with ``left``. In the grid each pair has
    one product for both."""
    ids = lambda df, other: df.select(F.lit(other).alias("other"), F.col("id").cast("long").alias("a"))
    every = ids(left, False).unionByName(ids(right, True))
    sides = _pairs(left), _pairs(right)
    sizes = vector_bytes(sides[0]), vector_bytes(sides[1])
    if min(sizes[0][1], sizes[1][1]) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        both = (best_over(x, y, strip_rows, broadcast_bytes).select(F.lit(other).alias("other"), "a", "score") for x, y, other in ((left, right, False), (right, left, True)))
        return next(both).unionByName(next(both))

    def cell(a, x, b, y, same):
        tops = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
        _raised(tops[0], Tiles(x, y), tops[1])
        for k, (own, top) in enumerate(zip((a, b), tops)):
            some = top > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), bool(k))), pa.array(own[some], pa.int64()), pa.array(top[some])], ["other", "a", "score"])

    found = _grid(*sides, sizes, cell, "other boolean, a long, score double", strip_rows)
    found = found.groupBy("other", "a").agg(F.max("score").alias("score"))
    return every.join(found, ["other", "a"], "left").select("other", "a", F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def _side(batches: list[pa.RecordBatch], at: int) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers and the vectors after it."""
    if not batches:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return np.concatenate([b.column(at).to_numpy() for b in batches]), np.concatenate([native(b.column(at + 1)) for b in batches])


def _by_cell(rows: DataFrame, cells: int, run, schema: str) -> DataFrame:
    """Each ``cell`` of ``rows`` in a task of its own: two of them in one would keep others waiting."""
    return rows.repartitionById(cells, F.col("cell")).drop("cell").mapInArrow(run, schema)


def _grid(left: DataFrame, right: DataFrame | None, sizes: tuple[tuple[int, int], tuple[int, int]], cell, schema: str, strip_rows: int | None) -> DataFrame:
    n, m = _cut(sizes, right is None, strip_rows)
    strip, other = (strips(s, "id", strip_rows, k)[1] for s, k in zip(sizes, (n, m)))
    if right is None:
        rows = left.withColumn("s", strip).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = rows.select("id", "vector", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), (F.col("s") > F.col("t")).alias("side"))
        rows = rows.select("id", "vector", "side", (F.col("i") == F.col("j")).alias("same"), F.expr(f"cast(i * {n} - (i * (i - 1)) div 2 + j - i as int)").alias("cell"))
        cells = n * (n + 1) // 2
    else:
        if left.schema["vector"].dataType != right.schema["vector"].dataType:
            left, right = (x.withColumn("vector", F.col("vector").cast("array<double>")) for x in (left, right))
        rows = left.select("id", "vector", F.lit(False).alias("side"), strip.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
        rows = rows.unionByName(right.select("id", "vector", F.lit(True).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), other.alias("j")))
        rows = rows.select("id", "vector", "side", F.lit(False).alias("same"), (F.col("i") * m + F.col("j")).cast("int").alias("cell"))
        cells = n * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, same = ([], []), False
        for batch in batches:
            if batch.num_rows:
                same = batch.column(3)[0].as_py()
                for k, own in enumerate(sides):
                    part = batch.filter(batch.column(2) if k else pc.invert(batch.column(2)))
                    if part.num_rows:
                        own.append(part)
        parts = []
        for own in sides:
            parts += _side(own, 0)
            own.clear()
        if len(parts[0]) and (same or len(parts[2])):
            yield from cell(*parts, same)

    return _by_cell(rows, cells, run, schema)


def best_of(passages: DataFrame, queries: DataFrame, k: int, dedup: bool, vector: str = "vector", broadcast_bytes: int | None = None) -> DataFrame:
    """``(query_id, rank, passage_idx, score)``: each query's ``k`` passages of largest cosine.

    Ties go to the lower ``passage_idx``. With ``dedup`` the best passage stands for those of one ``(source_file, char_offset)``.
    Queries (``query_id``, ``vector``) whose vectors are checked to be small go to every task; a task keeps only what may be among
    the best, and the passages are not shuffled. More of them meet the passages in a grid of strips, where passages of one vector are
    scored once. ``k`` of 0 or less gives no rows; passages without a vector are not found."""
    spark = passages.sparkSession
    keys = ["source_file", "char_offset"] if dedup else []
    if k <= 0:
        return spark.createDataFrame([], "query_id long, rank int, passage_idx long, score double")
    rows = passages.where(F.col(vector).isNotNull()).select(F.col("passage_idx").cast("long").alias("passage_idx"), F.col(vector).alias("vector"), *keys)
    asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector")
    counted = vector_bytes(asked)
    if counted[1] > (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return _best_by_grid(rows, asked, counted, k, dedup)
    table = asked.toArrow().combine_chunks()
    ids = table["query_id"].to_numpy()
    shared = spark.sparkContext.broadcast((ids, native(table["vector"].combine_chunks()) if len(ids) else np.zeros((0, 0))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Leaders(*shared.value, k, dedup)
        for batch in batches:
            if batch.num_rows and len(top.ids):
                top.see(batch)
        yield from top.batches()

    return ranked(rows.mapInArrow(scan, _found(dedup)), k, dedup)


def _found(dedup: bool) -> str:
    return "query_id long, passage_idx long, score double" + (", source_file string, char_offset long" if dedup else "")


def _bits(column: pa.Array) -> pa.Array:
    """The bytes of each row of a list column of floats; a null among these is not a number."""
    flat = column.flatten()
    flat = np.ascontiguousarray((pc.fill_null(flat, np.nan) if flat.null_count else flat).to_numpy(zero_copy_only=False))
    ends = column.offsets.to_numpy()
    ends = ((ends - ends[0]) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _unbits(column: pa.Array, kind: type) -> pa.Array:
    """Lists of floats from their bytes."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(kind)
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // flat.itemsize), pa.array(flat))


def keyed(rows: DataFrame) -> DataFrame:
    """``(passage_idx, key)``: each vector as its bytes. Spark sorts and groups by these as they are; of arrays of floats it would go
    through all numbers, for the sake of zeros with a sign, each time that it compares two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _bits(batch.column(1))], ["passage_idx", "key"])

    vector = "vector" if rows.schema["vector"].dataType.simpleString() in ("array<float>", "array<double>") else F.col("vector").cast("array<double>").alias("vector")
    return rows.select("passage_idx", vector).mapInArrow(run, "passage_idx long, key binary")


def unkeyed(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """``(passage_idx, vector, own_)`` of ``keyed`` vectors of a type."""
    single = kind.simpleString() == "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _unbits(batch.column(1), np.float32 if single else np.float64), batch.column(2)], ["passage_idx", "vector", "own_"])

    return rows.mapInArrow(run, f"passage_idx long, vector array<{'float' if single else 'double'}>, own_ array<long>")


def _best_by_grid(rows: DataFrame, asked: DataFrame, counted: tuple[int, int], k: int, dedup: bool) -> DataFrame:
    from sextant.scratch import written

    keys = ["source_file", "char_offset"] if dedup else []
    rows = written(rows, "passages")
    sizes = counted, vector_bytes(rows)
    if dedup and rows.select(*keys).distinct().count() == sizes[1][0]:
        dedup, keys, rows = False, [], rows.select("passage_idx", "vector")  # no place has two
    if not dedup and sizes[1][1] > LEAST_STRIP:
        # k passages of other vectors come before any of a vector that k other vectors come before, so each needs k passages at most
        nth = F.row_number().over(Window.partitionBy("key").orderBy("passage_idx"))
        alike = keyed(rows).withColumn("nth_", nth).where(F.col("nth_") <= k).groupBy("key").agg(F.array_sort(F.collect_list("passage_idx")).alias("own_"))
        alike = written(unkeyed(alike.select(F.get("own_", F.lit(0)).alias("passage_idx"), "key", "own_"), rows.schema["vector"].dataType), "alike")
        met, kept = alike.agg(F.count("*"), F.sum(F.size("own_").cast("long"))).first()
        if met < 0.7 * sizes[1][0]:
            sizes = counted, vector_bytes(alike)
            first = _meet(alike.select("passage_idx", "vector"), asked, sizes, k, False)
            own = alike.select(F.col("passage_idx").alias("first_"), "own_")
            every = first.join(own, F.col("passage_idx") == F.col("first_")).select("query_id", F.explode("own_").alias("passage_idx"), "score")
            return ranked(every, k, False, counted[0] * k * kept // met)
    return _meet(rows, asked, sizes, k, dedup)


def _meet(rows: DataFrame, asked: DataFrame, sizes: tuple[tuple[int, int], tuple[int, int]], k: int, dedup: bool) -> DataFrame:
    n, m = _cut(sizes, False, None)
    if rows.schema["vector"].dataType != asked.schema["vector"].dataType:
        rows, asked = (x.withColumn("vector", F.col("vector").cast("array<double>")) for x in (rows, asked))
    every = rows.select("*", F.lit(None).cast("long").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), strips(sizes[1], "passage_idx", count=m)[1].alias("j"))
    every = every.unionByName(asked.select("query_id", "vector", strips(sizes[0], "query_id", count=n)[1].alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j")), allowMissingColumns=True)
    keys = ["source_file", "char_offset"] if dedup else []
    every = every.select("query_id", "passage_idx", "vector", *keys, (F.col("i") * m + F.col("j")).cast("int").alias("cell"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, found = [], []
        for batch in batches:
            asks = batch.column(0).is_valid()
            q, p = batch.filter(asks), batch.filter(pc.invert(asks))
            if q.num_rows:
                questions.append(pa.RecordBatch.from_arrays([q.column(0), q.column(2)], ["query_id", "vector"]))
            if p.num_rows:
                found.append(p.select(range(1, p.num_columns)))
        if questions and found:
            top = Leaders(*_side(questions, 0), k, dedup)
            questions.clear()
            top.see(pa.Table.from_batches(found).combine_chunks().to_batches()[0])
            yield from top.batches()

    return ranked(_by_cell(every, n * m, meet, _found(dedup)), k, dedup, sizes[0][0] * min(k * m, sizes[1][0]))


def ranked(found: DataFrame, k: int, dedup: bool, count: int = 0) -> DataFrame:
    """The best ``k`` of what tasks found, with ``dedup`` each place once. About ``count`` rows are dealt to as many tasks as these need."""
    if count > RANKED_ROWS:
        found = found.repartition(-(-count // RANKED_ROWS), "query_id")
    if dedup:
        best = Window.partitionBy("query_id", "source_file", "char_offset").orderBy(F.desc("score"), "passage_idx")
        found = found.withColumn("at", F.row_number().over(best)).where("at = 1")
    rows = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_idx")))
    return rows.where(F.col("rank") <= k).select("query_id", "rank", "passage_idx", "score")


class Leaders:
    """The best ``k`` passages so far of each query, with ``dedup`` one of each place. ``floor`` is what a score needs to be among them."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, dedup: bool, floor: np.ndarray | None = None):
        self.ids, self.q, self.k, self.dedup = ids, q, k, dedup
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.parts = list(_steps(len(ids), TILE[0]))
        self.kept: list[list[tuple]] = [[] for _ in self.parts]
        self.length, self.places = _longest(q), {}

    def see(self, batch: pa.RecordBatch) -> None:
        """Scores ``(passage_idx, vector)`` and with ``dedup`` ``source_file, char_offset``. Until the end of the batch products in single
        precision do; what is left of them is scored."""
        p, v = batch.column(0).to_numpy(), native(batch.column(1))
        place = None
        if self.dedup:
            known = self.places
            place = np.array([known.setdefault(x, len(known)) for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])
        tiles = Tiles(self.q, v, (self.length, _longest(v)))
        for at, rows in enumerate(self.parts):
            own, n = [], 0
            for columns in _steps(len(p), TILE[1]):
                s = tiles.multiplied(rows, columns)
                if np.isneginf(self.floor[rows]).any():
                    self._first(rows, s, tiles.slack, None if place is None else place[columns])
                r, c, score = tiles.near(rows, columns, self.floor[rows], s)
                if len(r):
                    own.append((r, c + columns.start, score))
                    n += len(r)
                    if n > 4 * self.k * (rows.stop - rows.start):
                        own = [self._left(rows, own, tiles.slack, place)]
                        n = len(own[0][0])
            if own:
                r, c, _ = self._left(rows, own, tiles.slack, place)
                self.kept[at].append((r, tiles.exact(r + rows.start, c), p[c], place[c] if self.dedup else None))
                self._best(at)

    def _left(self, rows: slice, own: list[tuple], slack: float, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What may still be among the best, with the floor that the ``k``-th best so far gives."""
        r, c, s = (np.concatenate(x) for x in zip(*own))
        floor = self.floor[rows]
        if self.dedup:
            order = np.lexsort((-s, place[c], r))
            row, of, score = r[order], place[c][order], s[order]
            first = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(of) != 0)])
            row, score = row[first], score[first]
        else:
            row, score = r, s
        order = np.lexsort((-score, row)) if self.dedup or not np.isfinite(score).all() else np.argsort(row * (4.0 * np.abs(score).max() + 1) - score)
        row, score = row[order], score[order]
        full = _nth(row) == self.k - 1
        floor[row[full]] = np.maximum(floor[row[full]], score[full] - slack)
        keep = s >= floor[r] - slack
        return r[keep], c[keep], s[keep]

    def _first(self, rows: slice, s: np.ndarray, slack: float, place: np.ndarray | None) -> None:
        """A floor for queries that have none: the ``k``-th best of a tile."""
        if place is not None:
            order = np.argsort(place, kind="stable")
            s = np.maximum.reduceat(s[:, order], np.flatnonzero(np.concatenate([[True], np.diff(place[order]) > 0])), axis=1)
        if s.shape[1] >= self.k:
            kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - slack
            self.floor[rows] = np.maximum(self.floor[rows], np.where(np.isfinite(kth), kth, -np.inf))

    def _best(self, at: int) -> None:
        own = self.kept[at]
        r, v, p = (np.concatenate([x[i] for x in own]) for i in range(3))
        place = np.concatenate([x[3] for x in own]) if self.dedup else None
        if self.dedup:
            order = np.lexsort((p, -v, place, r))
            r, v, p, place = r[order], v[order], p[order], place[order]
            first = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(place) != 0)])
            r, v, p, place = r[first], v[first], p[first], place[first]
        order = np.lexsort((p, -v, r))
        r, v, p = r[order], v[order], p[order]
        nth = _nth(r)
        full = nth == self.k - 1
        floor = self.floor[self.parts[at]]
        floor[r[full]] = np.maximum(floor[r[full]], v[full])
        keep = nth < self.k
        self.kept[at] = [(r[keep], v[keep], p[keep], place[order][keep] if self.dedup else None)]

    def batches(self) -> Iterator[pa.RecordBatch]:
        files, offsets = zip(*self.places) if self.places else ((), ())
        files, offsets = pa.array(files, pa.string()), pa.array(offsets, pa.int64())
        for at, rows in enumerate(self.parts):
            if self.kept[at]:
                self._best(at)
                r, v, p, place = self.kept[at][0]
                columns, names = [pa.array(self.ids[rows][r]), pa.array(p), pa.array(v)], ["query_id", "passage_idx", "score"]
                if self.dedup:
                    columns += [files.take(pa.array(place)), offsets.take(pa.array(place))]
                    names += ["source_file", "char_offset"]
                yield pa.RecordBatch.from_arrays(columns, names)
                self.kept[at] = []


def _nth(rows: np.ndarray) -> np.ndarray:
    """Of sorted numbers, how many equal ones are before each."""
    starts = np.flatnonzero(np.concatenate([[True], np.diff(rows) != 0]))
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))


def _leading(batch: pa.RecordBatch, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, dedup: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the batch that may be among the best ``k`` of a query; ``floor`` has the k-th best so far and is raised."""
    top = Leaders(ids, q, k, dedup, floor)
    top.see(batch)
    yield from top.batches()
