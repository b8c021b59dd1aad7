"""Distances as Spark columns, for joins that stay in generated code.

The Euclidean one adds squares in the order of NumPy's pairwise summation (eight running sums in
blocks of at most 128), so that it equals ``numpy.linalg.norm`` bit for bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairwise_sum(terms: list[Column]) -> Column:
    n = len(terms)
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    if n == 0:
        return F.lit(0.0)
    if n < 8:
        return add(terms)
    if n <= 128:
        whole = n - n % 8
        r = [add(terms[k:whole:8]) for k in range(8)]
        return add([((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7])), *terms[whole:]])
    half = n // 2
    half -= half % 8
    return pairwise_sum(terms[:half]) + pairwise_sum(terms[half:])


def _differences(a: Column, b: Column, dim: int) -> list[Column]:
    return [a[i] - b[i] for i in range(dim)]


def distance(a: Column, b: Column, dim: int, metric: str = "euclidean", p: float = 2.0) -> Column:
    """Distance of two array columns of ``dim`` doubles."""
    diff = _differences(a, b, dim)
    if metric == "euclidean":
        return F.sqrt(pairwise_sum([d * d for d in diff]))
    if metric == "manhattan":
        return pairwise_sum([F.abs(d) for d in diff])
    if metric == "chebyshev":
        return reduce(lambda x, y: F.greatest(x, y), [F.abs(d) for d in diff], F.lit(0.0)) if diff else F.lit(0.0)
    if metric == "minkowski":
        return F.pow(pairwise_sum([F.pow(F.abs(d), F.lit(p)) for d in diff]), F.lit(1.0 / p))
    if metric == "cosine":
        dot = pairwise_sum([a[i] * b[i] for i in range(dim)])
        return F.greatest(1 - dot / (norm(a, dim) * norm(b, dim)), F.lit(0.0))
    raise ValueError(f"no column form of metric {metric!r}")


def norm(a: Column, dim: int) -> Column:
    return F.sqrt(pairwise_sum([a[i] * a[i] for i in range(dim)]))
