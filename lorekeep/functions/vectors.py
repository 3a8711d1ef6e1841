"""Distances between vectors, in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def distance(metric: str):
    try:
        return {"l2": squared_l2, "cosine": cosine_distance, "dot": lambda a, b: -dot(a, b)}[metric]
    except KeyError:
        raise ValueError(f"Unknown metric: {metric}") from None
