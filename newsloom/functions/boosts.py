"""Ranking factors as column expressions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(3.6e9)


def decay(ts: Column, target: Column, offset: float, rate: float, scale: float) -> Column:
    """Exponential decay: 1 within ``offset`` hours of the target, ``rate`` after ``scale`` more.

    A missing date gives 0.
    """
    late = F.greatest(F.lit(0.0), F.abs(hours_between(target, ts)) - F.lit(float(offset)))
    boost = F.exp(F.lit(log(rate)) / F.lit(float(scale)) * late)
    return F.when(ts.isNotNull(), boost).otherwise(0.0)


def factor(boost: Column, const: float, weight: float, low: float, high: float) -> Column:
    raw = F.lit(float(const)) + F.lit(float(weight)) * boost
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), raw))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null or zero vectors compare as 0."""
    lengths = norm(a) * norm(b)
    return F.coalesce(F.when(lengths > 0, dot(a, b) / lengths), F.lit(0.0))


def has_any(tags: Column, wanted: list[str], at_least: int = 1) -> Column:
    """True when at least ``at_least`` of the wanted values occur."""
    names = F.array(*[F.lit(w) for w in wanted])
    if at_least == 1:
        found = F.arrays_overlap(tags, names)
    else:
        found = F.size(F.array_intersect(tags, names)) >= at_least
    return F.coalesce(found, F.lit(False))
