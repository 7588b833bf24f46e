"""Repeatable randomness: every draw is a hash of what it is for.

The value depends on the key alone, so a task that runs again, on any number of
partitions, draws the same number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13  # hex digits per draw: 52 bits, exact in a double
SCALE = float(16**DIGITS)


def _keys(keys) -> list[Column]:
    return [k if isinstance(k, Column) else F.lit(k) for k in keys]


def digest(*keys) -> Column:
    """md5 of the keys joined by `|`; plain values are literals."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in _keys(keys)]))


def from_digest(hexes: Column, start=1) -> Column:
    part = F.substr(hexes, F.lit(start) if isinstance(start, int) else start, F.lit(DIGITS))
    return F.conv(part, 16, 10).cast("bigint") / F.lit(SCALE)


def uniform(*keys) -> Column:
    """A number in [0, 1) that depends only on the keys."""
    return from_digest(digest(*keys))


# Modulus and factors of the draws by counter.
PRIME = (1 << 31) - 1
PER_PLACE, PER_DRAW, FACTOR = 1664525, 1013904223, 48271


def series_keys(*keys) -> tuple[Column, Column]:
    """Two 28-bit numbers from one digest, for a whole series of draws."""
    hexes = digest(*keys)
    part = lambda start: F.conv(F.substring(hexes, start, 7), 16, 10).cast("bigint")
    return part(1), part(8)


def _fifth(x):
    """x^5 modulo the prime, which permutes the numbers below it."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def counter_draw(first, second, place, j):
    """Draw j at a place of the series, in [0, 1), by arithmetic in 64-bit integers: of columns
    or of NumPy arrays alike."""
    y = _fifth((first + place * PER_PLACE + j * PER_DRAW) % PRIME)
    return _fifth((y * FACTOR + second + place) % PRIME) / float(PRIME)
