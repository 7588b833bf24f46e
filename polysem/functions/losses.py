"""Loss functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polysem.functions.vectors import let


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def minus_log_sigmoid(x: Column) -> Column:
    """-log(sigmoid(x)), finite for every x."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))


def log_sum_exp(xs: Column) -> Column:

    def of(top: Column) -> Column:
        return top + F.log(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))

    return let(F.array_max(xs), of)


def log_softmax(x: Column, others: Column) -> Column:
    """log of the share of x among x and the array `others`."""
    return x - log_sum_exp(F.concat(F.array(x), others))


def softmax_slope(x: Column, others: Column) -> Column:
    """Derivative of -log_softmax with respect to x."""
    return F.exp(log_softmax(x, others)) - F.lit(1.0)


def softmax_slopes_of_others(x: Column, others: Column) -> Column:
    """Derivatives of -log_softmax with respect to each element of `others`."""
    everything = log_sum_exp(F.concat(F.array(x), others))
    return let(everything, lambda lse: F.transform(others, lambda y: F.exp(y - lse)))
