"""Functions on ARRAY columns holding vectors; arithmetic in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row. Without it an
    expression used inside a lambda is computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + _d(x))


def elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: op(_d(x), _d(y)))


def add(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x * y)


def scale(v: Column, factor: Column | float) -> Column:
    if not isinstance(factor, Column):
        return F.transform(v, lambda x: _d(x) * F.lit(float(factor)))
    return let(factor, lambda f: F.transform(v, lambda x: _d(x) * f))


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + _d(x) * _d(x))


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0.0, F.lit(0.0)).otherwise(dot(a, b) / n))


def angle(a: Column, b: Column) -> Column:
    """Angle in radians, -1 if either vector has no length."""

    def of(n: Column) -> Column:
        c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))
        return F.when(n == 0.0, F.lit(-1.0)).otherwise(F.acos(c))

    return let(norm(a) * norm(b), of)


def set_length(v: Column, length: Column | float) -> Column:
    """Rescale to exactly `length`; a vector without length stays as it is."""
    target = length if isinstance(length, Column) else F.lit(float(length))
    return scale(v, let(norm(v), lambda n: F.when(n == 0.0, F.lit(1.0)).otherwise(target / n)))


def normalize(v: Column) -> Column:
    return set_length(v, 1.0)


def limit_length(v: Column, length: Column | float) -> Column:
    """Rescale to `length` only if longer."""
    bound = length if isinstance(length, Column) else F.lit(float(length))
    return scale(v, let(norm(v), lambda n: F.when(n > bound, bound / n).otherwise(F.lit(1.0))))


def between(a: Column, b: Column, share: Column | float) -> Column:
    """The point `share` of the way from a to b."""
    t = share if isinstance(share, Column) else F.lit(float(share))
    return elementwise(a, b, lambda x, y: x + (y - x) * t)
