"""Look-up joins that neither broadcast blindly nor pile up on a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysem.session import fits


def lookup_join(
    facts: DataFrame, table: DataFrame, on: list[str], table_rows: int, row_bytes: int, how: str = "inner"
) -> DataFrame:
    """Join facts with a table that is unique on `on`. Small tables are
    broadcast. Otherwise both sides are shuffled, and since one word may own a
    third of all tokens, Spark splits the facts of a large partition over tasks
    of bounded size (adaptive skew join). For that the table should be
    materialised: next to an aggregate a join is not split."""
    if fits(table_rows, row_bytes):
        return facts.join(F.broadcast(table), on, how)
    return facts.join(table, on, how)
