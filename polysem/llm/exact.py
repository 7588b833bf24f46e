"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every source (a run of rows of one task) sorts the 64-bit fingerprints of
   its texts and sends each owner (a range of fingerprints) the distinct ones
   of its range, as Golomb-coded differences.
2. An owner decodes what it got from all sources and answers each of them with
   a bitmap: which of the fingerprints it sent occur elsewhere too.
3. A row whose fingerprint is so marked, or occurs twice in its own source, is
   suspect. Only the texts of suspects are shuffled, by their bytes.

What a source sends, and what it keeps of its rows (id, SHA-256), is written to
the shared folder before it is used, so that a repeated task cannot number its
rows in another way. A source sends a fingerprint once however often it has
it, so copies that make up a third of all rows do not fill one owner.

Texts are equal when identical after replacing each run of ASCII white space by
one space. Null is empty, and empty texts equal each other. Of equal texts the
smallest id stays; a null id comes after all others. Rows that repeat id and
text all count, and exactly one row of each class is marked as staying.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.llm.sketch import maybe_in
from polysem.session import stored

# Rows of one source; a task with more makes several.
SOURCE_ROWS = 1 << 17
# Fingerprints per owner, about.
OWNER_ROWS = 1 << 20
WHITE = r"[ \t-\r]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def golomb_encode(values: np.ndarray, low: int, span: int) -> tuple[int, bytes]:
    """Differences of sorted distinct unsigned `values` >= `low`, spread over
    `span`, as Golomb codes whose divisor is a power of two. Quotients in unary
    come first, then all remainders. Returns the bits of a remainder too."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(low))
    shift = max(0, int(0.69 * span / max(n, 1)).bit_length() - 1)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    places = np.arange(shift, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return shift, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(code: bytes, n: int, low: int, shift: int) -> np.ndarray:
    rest_bytes = (n * shift + 7) // 8
    raw = np.frombuffer(code, np.uint8)
    stops = np.flatnonzero(np.unpackbits(raw[: len(raw) - rest_bytes]))[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(raw[len(raw) - rest_bytes :], count=n * shift).reshape(n, shift)
    gaps = quotients.astype(np.uint64) << np.uint64(shift)
    if shift:
        gaps += (bits.astype(np.uint64) << np.arange(shift, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def owner_bounds(owners: int) -> list[int]:
    return [(i << 64) // owners for i in range(owners + 1)]


SENT = (
    "src bigint, owner int, n int, shift int, code binary, rows array<bigint>, "
    "ids array<bigint>, digests array<binary>, slots array<int>, twice array<boolean>"
)


def sources(rows: DataFrame, owners: int, fp_bits: int) -> DataFrame:
    """What each source sends (n, shift, code) and keeps (its rows: id, digest,
    slot of the row's fingerprint among those sent, whether it has it twice).
    `rows`: id, digest (SHA-256 in hex)."""
    bounds = owner_bounds(owners)
    cuts = np.array(bounds[1:-1], np.uint64)
    drop = np.uint64(64 - fp_bits)

    def one(src: int, ids: list, digests: list[bytes]) -> pa.RecordBatch:
        prints = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64) >> drop << drop
        order = np.argsort(prints, kind="stable")
        distinct, slot, count = np.unique(prints[order], return_inverse=True, return_counts=True)
        edges = [0, *np.searchsorted(distinct, cuts).tolist(), len(distinct)]
        row_edges = np.searchsorted(slot, edges).tolist()
        out: dict[str, list] = {k: [] for k in ("owner", "n", "shift", "code", "rows", "ids", "digests", "slots", "twice")}
        for o in range(owners):
            a, b, i, j = edges[o], edges[o + 1], row_edges[o], row_edges[o + 1]
            if a == b:
                continue
            shift, code = golomb_encode(distinct[a:b], bounds[o], bounds[o + 1] - bounds[o])
            here = order[i:j].tolist()
            for k, v in (
                ("owner", o), ("n", b - a), ("shift", shift), ("code", code),
                ("rows", range((src << 17) + i, (src << 17) + j)), ("ids", [ids[r] for r in here]), ("digests", [digests[r] for r in here]),
                ("slots", (slot[i:j] - a).tolist()), ("twice", (count[slot[i:j]] > 1).tolist()),
            ):
                out[k].append(v)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([src] * len(arrays[0]), pa.int64()), *arrays], names=["src", *out])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 20
        ids: list = []
        digests: list[bytes] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            digests += [bytes.fromhex(d) for d in batch.column(1).to_pylist()]
            while len(ids) >= SOURCE_ROWS:
                yield one(src, ids[:SOURCE_ROWS], digests[:SOURCE_ROWS])
                src, ids, digests = src + 1, ids[SOURCE_ROWS:], digests[SOURCE_ROWS:]
        if ids:
            yield one(src, ids, digests)

    return rows.mapInArrow(work, SENT)


def answers(sent: DataFrame, owners: int) -> DataFrame:
    """The owners' bitmaps: (src, owner, bitmap)."""
    bounds = owner_bounds(owners)

    def work(table: pa.Table) -> pa.Table:
        low = bounds[table["owner"][0].as_py()]
        codes, ns, shifts = (table[c].to_pylist() for c in ("code", "n", "shift"))
        lists = [golomb_decode(c, n, low, s) for c, n, s in zip(codes, ns, shifts, strict=True)]
        values, count = np.unique(np.concatenate(lists), return_counts=True)
        shared = values[count > 1]
        maps = []
        for x in lists:
            at = np.minimum(np.searchsorted(shared, x), max(len(shared) - 1, 0))
            maps.append(np.packbits(shared[at] == x if len(shared) else np.zeros(len(x), bool)).tobytes())
        return pa.table({"src": table["src"], "owner": table["owner"], "bitmap": pa.array(maps, pa.binary())})

    some = sent.select("src", "owner", "n", "shift", "code")
    return some.groupBy("owner").applyInArrow(work, "src bigint, owner int, bitmap binary")


def exchange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_bits: int = 64) -> DataFrame:
    """One row per document: row_no (unique), id, digest, suspect."""
    spark = docs.sparkSession
    rows = docs.select(
        docs[id_col].cast("bigint").alias("id"), F.sha2(normalised(docs[text_col]), 256).alias("digest")
    )
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(least, -(-docs.count() // OWNER_ROWS))
    sent = stored(sources(rows, owners, fp_bits), "fingerprints")
    # Both sides are keyed by message, so no key is hot; an answer has one bit
    # for each fingerprint.
    kept = sent.select("src", "owner", "rows", "ids", "digests", "slots", "twice")
    return kept.join(answers(sent, owners), ["src", "owner"]).mapInArrow(
        _flat, "row_no bigint, id bigint, digest binary, suspect boolean"
    )


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of messages whose answer is there. The number of a row is that of
    its source and its place in what the source kept for all owners."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = {n: batch.column(n)[i] for n in batch.schema.names}
            slots = part["slots"].values.to_numpy()
            marked = np.unpackbits(np.frombuffer(part["bitmap"].as_py(), np.uint8))[slots].astype(bool)
            suspect = marked | np.asarray(part["twice"].values.to_pylist(), bool)
            yield pa.RecordBatch.from_arrays(
                [part["rows"].values, part["ids"].values, part["digests"].values, pa.array(suspect)],
                names=["row_no", "id", "digest", "suspect"],
            )


def with_suspicion(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """Add `_norm` (normalised text), `_digest` and `_maybe`, which is true for
    every suspect of `found` and for few other rows."""
    norm = docs.withColumn("_norm", normalised(docs[text_col])).withColumn("_digest", F.sha2("_norm", 256))
    suspects = found.where("suspect").select(F.xxhash64(F.lower(F.hex("digest"))))
    return maybe_in(norm, F.xxhash64("_digest"), suspects)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    found = stored(exchange(rows, "id", "text", fp_bits), "suspects")
    # Texts are grouped by their bytes; equal ones meet within tasks first.
    classes = (
        with_suspicion(rows, found, "text")
        .where("_maybe")
        .groupBy("_norm")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.unhex(F.sha2("_norm", 256)).alias("digest"), "keep_id", "group_size")
        .where("group_size > 1")
    )
    suspects = found.where("suspect")
    first = suspects.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_no"))["row_no"].alias("first_row")
    )
    # Written, so that a hot class on the other side can be split.
    known = stored(classes.join(first, "digest"), "classes")
    groups = suspects.join(known, "digest", "left")
    named = lambda df, keep, size, kept: df.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), size.cast("bigint").alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    alone = F.col("group_size").isNull()
    return named(found.where("not suspect"), F.col("id"), F.lit(1), F.lit(True)).unionByName(
        named(
            groups,
            F.when(alone, F.col("id")).otherwise(F.col("keep_id")),
            F.coalesce("group_size", F.lit(1)),
            alone | (F.col("row_no") == F.col("first_row")),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_bits: int = 64) -> DataFrame:
    """`docs` with one row of each class of equal texts: the smallest id, of
    rows that share it the one with the smallest hash of all columns. Rows
    without suspicion never move."""
    found = stored(exchange(docs, id_col, text_col, fp_bits), "suspects")
    # Own columns stand beside a row as a whole, so that no names clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    flagged = with_suspicion(rows, found, "text")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.xxhash64("row"))
    ones = flagged.where("_maybe").groupBy("_norm").agg(F.min_by("row", order).alias("row"))
    return flagged.where("not _maybe").select("row.*").unionByName(ones.select("row.*"))
