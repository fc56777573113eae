"""Vectors as ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memtide.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(a, lambda x: x.cast("double") * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(a, lambda v: let(1 / F.greatest(norm(v), F.lit(1e-12)), lambda k: scale(v, k)))


def cosine(a: Column, b: Column, zero: str = "nan") -> Column:
    """Cosine with a policy for zero vectors: ``nan`` (as divided), ``zero``, or ``eps`` (norms of at least 1e-8)."""
    na, nb = norm(a), norm(b)
    if zero == "eps":
        return dot(a, b) / (F.greatest(na, F.lit(1e-8)) * F.greatest(nb, F.lit(1e-8)))
    missing = F.lit(float("nan")) if zero == "nan" else F.lit(0.0)
    return F.when((na == 0) | (nb == 0), missing).otherwise(dot(a, b) / (na * nb))
