"""Arithmetic on array columns, one row at a time, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; null if the lengths differ."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Of unit vectors, to six places: the score that thresholds and ranks go by."""
    return F.round(dot(a, b), 6)


def normalized(v: Column | str) -> Column:
    """To length one; a zero vector stays."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(EPSILON))
    return F.transform(_col(v), lambda x: x.cast("double") / norm)


def zero(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def merge(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))


def diff(a: Column | str, b: Column | str) -> Column:
    """``a - b`` where positive, else 0."""
    return F.zip_with(_col(a), _col(b), lambda x, y: F.greatest(x.cast("double") - y.cast("double"), F.lit(0.0)))


def intersect(a: Column | str, b: Column | str) -> Column:
    """The smaller magnitude where the signs agree, else 0."""
    return F.zip_with(_col(a), _col(b), lambda x, y: F.when(F.signum(x) == F.signum(y), F.signum(x).cast("double") * F.least(F.abs(x.cast("double")), F.abs(y.cast("double")))).otherwise(0.0))


def prefix(v: Column | str, size: int) -> Column:
    """The first ``size`` entries at length one."""
    return normalized(F.slice(_col(v), 1, size))


def projected(v: Column | str, weights: Column | str) -> Column:
    """``weights`` (rows of an array column) times ``v``, at length one."""
    v = _col(v)
    return normalized(F.transform(_col(weights), lambda w: dot(w, v)))
