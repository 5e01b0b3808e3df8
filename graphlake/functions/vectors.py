"""Vector metrics as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlake import errors


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _double(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either vector has no length."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def l1(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """The number of places that differ."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x != y).cast("double")))


METRICS = {
    "cosine": (cosine, lambda a, b: 1 - cosine(a, b)),
    "euclidean": (lambda a, b: 1 / (1 + l2(a, b)), l2),
    "manhattan": (lambda a, b: 1 / (1 + l1(a, b)), l1),
    "dot": (dot, lambda a, b: -dot(a, b)),
    "hamming": (lambda a, b: 1 / (1 + hamming(a, b)), hamming),
}


def similarity(metric: str, a: Column | str, b: Column | str) -> Column:
    if metric not in METRICS:
        raise errors.UnsupportedVectorType(metric)
    return METRICS[metric][0](a, b)


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    if metric not in METRICS:
        raise errors.UnsupportedVectorType(metric)
    return METRICS[metric][1](a, b)
