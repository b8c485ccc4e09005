"""Functions of array columns that are vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column, floor: float = 1e-8) -> Column:
    """v over its length plus floor."""
    return bound(norm(v) + F.lit(floor), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def scale(v: Column) -> Column:
    """The largest absolute component, 1e-8 at least."""
    return F.greatest(F.lit(1e-8), F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))))


def to_int8(v: Column) -> Column:
    """127 x / scale, rounded half to even."""
    one = lambda x, s: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") / s * 127).cast("int"))).cast("tinyint")
    return bound(scale(v), lambda s: F.transform(v, lambda x: one(x, s)))


def from_int8(q: Column, s: Column) -> Column:
    return bound(s, lambda t: F.transform(q, lambda x: t * x / F.lit(127.0)))


def blend(parts: list[tuple[float, Column]]) -> Column:
    """Vectors one after the other, each times the square root of its share."""
    def times(share: float):
        return lambda x: x.cast("double") * F.lit(share**0.5)

    return F.concat(*[F.transform(v, times(w)) for w, v in parts])
