"""Contiguous sharding with the smallest largest shard.

Rows are ordered so that equal texts stand together: by the smallest id among
them, then by id. A group of equal texts is never divided. The smallest
capacity with which a greedy pass fills no more than the wanted shards is
found by binary search, and the cuts are those of that pass.

The order is a range sort; one number per partition turns places and sums
within partitions into global ones. The search runs on the driver over ends of
groups, of which it first sees some thousand cells (smallest end, largest end,
number). A greedy pass over cells is exact but where a cut falls inside a
cell, and gives bounds there; only cells in which a cut can still fall are
looked at again, 256 times finer, until the cuts are exact. So the driver
holds a bounded number of cells however many groups there are.

A null text has no bytes and forms a group with the empty texts. Null ids come
last. Repeated rows are rows of their own, with slots of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysem.session import stored

FIRST_CELLS = 1 << 13
FINER = 256


class Cells:
    """What the driver knows about the ends of groups, in ascending order."""

    def __init__(self, rows: list[tuple[int, int, int]]) -> None:
        rows = sorted(rows)
        self.low = [r[0] for r in rows]
        self.high = [r[1] for r in rows]
        self.count = [r[2] for r in rows]

    def last_end(self, target: int) -> tuple[int, int]:
        """Bounds of the largest end that is not above `target`."""
        i = bisect_left(self.low, target + 1) - 1
        if i < 0:
            return 0, 0
        if target >= self.high[i]:
            return self.high[i], self.high[i]
        if self.count[i] <= 2:
            return self.low[i], self.low[i]
        return self.low[i], target

    def refined(self, spans: list[tuple[int, int]], finer: list[tuple[int, int, int]]) -> Cells:
        kept = [
            (a, b, n)
            for a, b, n in zip(self.low, self.high, self.count, strict=True)
            if not any(s <= a and b <= e for s, e in spans)
        ]
        return Cells(kept + finer)

    def open_spans(self, targets: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The cells with unseen ends that meet one of the ranges of targets."""
        return [
            (a, b)
            for a, b, n in zip(self.low, self.high, self.count, strict=True)
            if n > 2 and any(a <= e and s < b for s, e in targets)
        ]


def greedy(cells: Cells, capacity: int, shards: int) -> list[tuple[int, int, int, int]]:
    """For each shard the bounds of its target (start plus capacity) and end."""
    low = high = 0
    passes = []
    for _ in range(shards):
        targets = low + capacity, high + capacity
        low, high = cells.last_end(targets[0])[0], cells.last_end(targets[1])[1]
        passes.append((*targets, low, high))
    return passes


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """The ends of the shards. `ends` has one BIGINT column `upto`: the sum of
    sizes up to and with each group; sizes are 1 or more."""
    if not total:
        return [0] * shards

    def cells_of(df: DataFrame, width: int) -> list[tuple[int, int, int]]:
        cell = F.floor((F.col("upto") - 1) / width) if width > 1 else F.col("upto")
        found = df.groupBy(cell.alias("cell")).agg(F.min("upto"), F.max("upto"), F.count("*"))
        return [tuple(r)[1:] for r in found.collect()]

    width = max(1, total // FIRST_CELLS)
    cells = Cells(cells_of(ends, width))
    while True:
        # Below `low` no capacity is enough; `high` is enough.
        low = max(-(-total // shards), largest)
        high = -(-total // shards) + largest
        a, b = low, high
        while a < b:
            mid = (a + b) // 2
            a, b = (a, mid) if greedy(cells, mid, shards)[-1][3] >= total else (mid + 1, b)
        first_maybe = a
        a, b = first_maybe, high
        while a < b:
            mid = (a + b) // 2
            a, b = (a, mid) if greedy(cells, mid, shards)[-1][2] >= total else (mid + 1, b)
        first_sure = a
        least, most = greedy(cells, first_maybe, shards), greedy(cells, first_sure, shards)
        if first_maybe == first_sure and all(lo == hi for _, _, lo, hi in most):
            return [end for _, _, _, end in most]
        spans = cells.open_spans([(x[0], y[1]) for x, y in zip(least, most, strict=True)])
        width = max(1, width // FINER)
        near = reduce(lambda p, q: p | q, [F.col("upto").between(s, e) for s, e in spans])
        cells = cells.refined(spans, cells_of(ends.where(near), width))


def in_order(rows: DataFrame, *order) -> tuple[DataFrame, int, int]:
    """`rows` (with a column size) sorted and written, with `row_no` from 0 and
    `upto`, the sum of sizes of this and all earlier rows; rows and sum."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = np.cumsum(batch.column(batch.schema.get_field_index("size")).to_numpy()) + total
            places = np.arange(row, row + batch.num_rows)
            row, total = row + batch.num_rows, int(sizes[-1]) if len(sizes) else total
            new = [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(places), pa.array(sizes)]
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, *new], names=[*batch.schema.names, "part", "in_part", "sum_part"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    local = stored(
        rows.orderBy(*order).mapInArrow(work, f"{kinds}, part int, in_part bigint, sum_part bigint"), "ordered"
    )
    starts, n, total = [], 0, 0
    for r in local.groupBy("part").agg(F.count("*").alias("n"), F.max("sum_part").alias("s")).orderBy("part").collect():
        starts.append((r["part"], n, total))
        n, total = n + r["n"], total + r["s"]
    # One row for each partition of the sort.
    at = rows.sparkSession.createDataFrame(starts, "part int, row_start bigint, sum_start bigint")
    placed = local.join(F.broadcast(at), "part").withColumn("row_no", F.col("in_part") + F.col("row_start"))
    placed = placed.withColumn("upto", F.col("sum_part") + F.col("sum_start"))
    return placed.drop("part", "in_part", "sum_part", "row_start", "sum_start"), n, total


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text plus 1),
    text_crc32, law, shard, slot, grown_shard (null: shards follow the bytes)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = stored(
        docs.select(
            docs[id_col].cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("text_id"),
        ),
        "sizes",
    )
    # Written, so that a hot group on the other side of the join can be split.
    groups = stored(
        rows.groupBy("text_id").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("group_size")), "groups"
    )
    last = lambda c: [F.col(c).isNull(), F.col(c)]
    ordered, _, total = in_order(rows.join(groups, "text_id"), *last("first_id"), "text_id", *last("doc_id"))
    ends = stored(ordered.groupBy("text_id").agg(F.max("upto").alias("upto"), F.max("group_size").alias("size")), "ends")
    largest = ends.agg(F.max("size")).first()[0] or 0
    cuts = minimax_cuts(ends.select("upto"), total, largest, shards)
    number = sum(((F.col("upto") > c).cast("int") for c in cuts[:-1]), F.lit(0))
    placed = ordered.withColumn("shard", number)
    starts = dict(placed.groupBy("shard").agg(F.min("row_no")).collect())
    start = F.coalesce(*[F.when(F.col("shard") == s, F.lit(n)) for s, n in starts.items()], F.lit(0))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row_no") - start).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
