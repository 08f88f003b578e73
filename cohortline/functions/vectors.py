"""Pairwise functions of two array columns.

For one row against many centres use ``operators.vectors``: there the centres are a fixed matrix and
an Arrow batch costs about a tenth of evaluating these lambdas per centre.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def vec_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_dot(gap, gap))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector is returned unchanged."""
    norm = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
