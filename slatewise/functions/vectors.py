"""Dense-vector expressions on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewise.functions.lists import _c

EPSILON = 2.220446049250313e-16  # double machine epsilon, the norm given to unknown users


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column | str) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    c = _c(a)
    # the one-element array holds the norm, so it is computed once and not per element
    scaled = F.transform(
        F.array(norm(c)),
        lambda size: F.transform(c, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0))))
    return F.element_at(scaled, 1)


def distance(kind: str | Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """Pairwise distance by name (``cosine``, ``euclidean`` or ``manhattan``) or by a function of two columns."""
    if callable(kind):
        return kind(a, b)
    if kind == "cosine":
        return 1 - F.coalesce(cosine(a, b), F.lit(0.0))
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if kind == "euclidean":
        return norm(gaps)
    if kind == "manhattan":
        return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    raise ValueError(f"unknown distance {kind!r}")
