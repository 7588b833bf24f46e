"""Ranks and running totals over a whole table without a one-task window.

A window without a partition key runs in one task. Here the table is sorted by
range, every partition works on its own rows, and only one number per
partition is needed to turn local results into global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysem.session import cut

# Layout of monotonically_increasing_id: partition above, row in partition below.
PARTITION_SHIFT = 33
ROW_MASK = (1 << PARTITION_SHIFT) - 1


def _starts(totals: dict[int, float], zero) -> list:
    starts, running = [], zero
    for part in range(max(totals, default=-1) + 1):
        starts.append(running)
        running = running + totals.get(part, zero)
    return [*starts, running]


def pick(values: list, index: Column) -> Column:
    """Element `index` of a list of numbers held in the plan."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def number_rows(df: DataFrame, *order, column: str = "row_no") -> tuple[DataFrame, int]:
    """Add the dense 0-based rank in the given total order. Returns the
    (materialised) table and its number of rows."""
    staged = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", PARTITION_SHIFT)
    counts = {r["p"]: r["n"] for r in staged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = _starts(counts, 0)
    row_no = pick(starts, part) + F.col("_mid").bitwiseAND(F.lit(ROW_MASK))
    numbered = staged.withColumn(column, row_no.cast("bigint")).drop("_mid")
    return numbered, starts[-1]


def running_total(df: DataFrame, order: list, value: str, column: str) -> DataFrame:
    """Add the sum of the BIGINT `value` over this and all earlier rows of the
    given total order."""
    staged = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    staged = staged.withColumn("_part", F.shiftright("_mid", PARTITION_SHIFT))
    sums = {r["_part"]: r["s"] for r in staged.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    here = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(here) + pick(_starts(sums, 0), F.col("_part"))
    return staged.withColumn(column, total.cast("bigint")).drop("_mid", "_part")


def running_share(df: DataFrame, index: str, weight: Column, block: int) -> DataFrame:
    """For a table with a dense 0-based `index`, add `p` (weight over the total
    weight) and `hi` (sum of the p of this and all earlier rows). Windows hold
    at most `block` rows; the driver sees one number per block."""
    weighted = df.withColumn("_w", weight).withColumn("_b", F.expr(f"{index} div {block}"))
    sums = {r["_b"]: r["s"] for r in weighted.groupBy("_b").agg(F.sum("_w").alias("s")).collect()}
    starts = _starts(sums, 0.0)
    here = Window.partitionBy("_b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    everything = F.lit(starts[-1])
    hi = (F.sum("_w").over(here) + pick(starts, F.col("_b"))) / everything
    return weighted.withColumn("hi", hi).withColumn("p", F.col("_w") / everything).drop("_w", "_b")
