"""A set of hashes as a bit table of fixed size that scans can test.

Texts that matter to a later step are few, but a join would shuffle all of
them. The table says of nearly every other text that it does not matter, and
is small enough to broadcast whatever the size of the set; where it fills up,
more texts pass, and the exact step after it still decides.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most 2^21 words of 64 bits are broadcast.
BITS = 27


def _word(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BITS + 6)


def _bit(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BITS).bitwiseAND(F.lit(63)).cast("int")


def maybe_in(df: DataFrame, value: Column, keys: DataFrame) -> DataFrame:
    """`df` with `_maybe`: true for every row whose `value` (a BIGINT hash of all 64
    bits, or null) is in the first column of `keys`, and for few others."""
    key = F.col(keys.columns[0])
    words = (
        keys.where(key.isNotNull())
        .groupBy(_word(key).alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(key))).alias("_bits"))
    )
    met = df.withColumn("_value", value).withColumn("_word", _word(F.col("_value"))).join(F.broadcast(words), "_word", "left")
    hit = F.call_function("shiftright", F.col("_bits"), _bit(F.col("_value"))).bitwiseAND(F.lit(1)) == 1
    return met.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_word", "_bits", "_value")


def bit_table(keys: DataFrame) -> Broadcast:
    """The broadcast bit table of the BIGINT hashes in the first column of `keys`, for tasks in Python:
    about 16 bits for each, at most 2^`BITS` in all, set by Spark."""
    key = F.col(keys.columns[0])
    some = keys.where(key.isNotNull())
    bits = min(BITS, max(12, int(16 * some.count()).bit_length()))
    word = F.shiftrightunsigned(key, 64 - bits + 6)
    bit = F.shiftrightunsigned(key, 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    found = some.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def maybe_at(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the hashes (uint64) that the bit table does not rule out."""
    at = values >> np.uint64(64 - int(len(table)).bit_length() + 1 - 6)
    return np.flatnonzero(table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
