"""Hard negatives from Hilbert-ordered blocks with zone maps.

Components x become floor(scale x); a score is the integer inner product with
the anchor; ties go to the smaller id. An anchor's positives are its first
`n_pos` other rows of the same label. For every positive of score P the negatives
are the first `n_neg` rows of another label with a score N in the window
low P <= 100 N <= high P.

Rows are sorted by range: by label, place on a Hilbert curve over the `CURVE_DIMS`
components of largest variance, and id. Every partition cuts its rows into
blocks of `BLOCK` rows, which become Parquet rows: zone map (least and largest value
of each component, least and largest label) beside ids, labels and vectors,
so that zone maps are read without the vectors. A block also tells the scores that its own anchors
find in it. Anchors lie in groups of at most `GROUP` neighbours of that order.

Interval arithmetic gives, for an anchor a and a block, the least and the largest
score that any row of it can have: the sums over components of min and max of
(a lo, a hi). An anchor reads a block

1. for positives, if its labels may hold the anchor's and its largest score reaches the
   anchor's `n_pos`-th score so far (that of its own block);
2. for negatives, if its labels are not all the anchor's and for some window its
   least score is not above the window's top, and its largest not below what the
   window's `n_neg`-th negative has so far. The first `PROBES` blocks by
   largest score are read first for that bound.

Skipped blocks hold no row of the result. Groups meet zone maps in chunks of
`CHUNK` blocks (anchors are the queries, blocks all rows), then only the wanted
(group, block) pairs are joined with vectors. `visited` counts them.

Nothing is broadcast but sums per component. A label that holds a third of all rows
is many blocks; a block that all groups want is one row per group. Per anchor and
block at most `n_pos` (`n_neg` per window) rows are handed on, limited again before the
shuffle of the last window.

Rows without id or label, without a vector, or with a component that is null or not finite
take no part. Vectors of unequal length are as if filled up with zeros. Scaled
components beyond 2^27 count as 2^27, so that scores of up to 512 components fit
64 bits. A repeated row is a row of its own (its copy is one of its positives), also as anchor.
Anchors without positives or negatives have no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysem.session import stored, spread

SCALE = 256
N_POS, N_NEG, LOW, HIGH = 5, 3, 50, 95
BLOCK, GROUP, CHUNK, PROBES = 512, 256, 256, 4
CURVE_DIMS, CURVE_BITS = 15, 4
LARGEST = 1 << 27
NONE = -(1 << 62)
#: Blocks or groups of one partition.
PART = 1 << 24

BLOCKS = (
    "block bigint, label_lo bigint, label_hi bigint, zone_lo binary, zone_hi binary, n int, ids binary, labels binary, "
    "vectors binary, anchors binary, so_far binary"
)
GROUPS = "grp bigint, rows binary, ids binary, labels binary, vectors binary, so_far binary"


def taking_part(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, anchor, q: the rows that take part, with scaled components."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(finite).select(
        "vec_id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), scaled.alias("q")
    )


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Lists as rows of int64, filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def spreads(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of components, and the leading ones by variance with their mean and deviation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 0))
        for batch in batches:
            dim = max(sums.shape[1], int(batch.column(0).value_lengths().to_numpy().max(initial=0)))
            sums = np.pad(sums, ((0, 0), (0, dim - sums.shape[1])))
            q = matrix(batch.column(0), dim).astype(float)
            sums += np.stack([np.full(dim, len(q)), q.sum(axis=0), (q**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.shape[1])), *map(pa.array, sums)], names=["d", "n", "s", "ss"])

    found = rows.select("q").mapInArrow(work, "d bigint, n double, s double, ss double").groupBy("d")
    table = found.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("d").toArrow()
    n, s, ss = (table[c].to_numpy() for c in ("n", "s", "ss"))
    total = n.max(initial=1)  # filled-up zeros count
    mean, variance = s / total, ss / total - (s / total) ** 2
    lead = np.argsort(-variance, kind="stable")[:CURVE_DIMS]
    return len(n), lead, mean[lead], np.sqrt(np.maximum(variance[lead], 1e-9))


def curve_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (components of `bits` bits): axes are
    exchanged or mirrored bit by bit, then the bits are Gray-decoded and interleaved."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def with_place(rows: DataFrame, dim: int, lead: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    """`rows` with `place`: components in cells of equal share under a bell curve about the mean."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (matrix(batch.column(3), dim)[:, lead] - mean) / deviation
            share = 1 / (1 + np.exp(np.clip(-1.702 * at, -50, 50)))
            cells = np.minimum((share * (1 << CURVE_BITS)).astype(np.int64), (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve_places(cells, CURVE_BITS) if len(lead) else np.zeros(len(at), np.int64))], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(work, "vec_id bigint, label bigint, anchor boolean, q array<bigint>, place bigint")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows, in floating point where that is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor x block: the least and the largest score by interval arithmetic."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def kth_largest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, `NONE` where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), NONE)
    return np.partition(scores, -k, axis=1)[:, -k]


def blocks_of(rows: DataFrame, dim: int, n_pos: int) -> DataFrame:
    """The sorted rows in blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * PART
        held, size, made = [], 0, 0

        def block(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            q = matrix(part.column(3), dim)
            anchors = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
            scores = products(q[anchors], q)
            scores[labels[anchors][:, None] != labels[None, :]] = NONE
            scores[np.arange(len(anchors)), anchors] = NONE
            values = [
                base + made, labels.min(), labels.max(), q.min(axis=0).tobytes(), q.max(axis=0).tobytes(), len(ids), ids.tobytes(),
                labels.tobytes(), q.astype(np.int32).tobytes(), anchors.tobytes(), kth_largest(scores, n_pos).tobytes(),
            ]
            types = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int32()] + [pa.binary()] * 5
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()
                whole = table[0]
                yield block(whole.slice(0, BLOCK))
                held, size, made = [whole.slice(BLOCK)], size - BLOCK, made + 1
        if size:
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    order = rows.orderBy("label", "place", "vec_id").select("vec_id", "label", "anchor", "q")
    return order.mapInArrow(work, BLOCKS)


def joined(parts: list[np.ndarray], like: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, like)


def groups_of(blocks: DataFrame, dim: int) -> DataFrame:
    """The anchors of neighbouring blocks in groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() * PART, 0
        held: list[tuple[np.ndarray, ...]] = []

        def group(part: list[np.ndarray]) -> pa.RecordBatch:
            values = [base + made, *(x.tobytes() for x in part)]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if i else pa.int64()) for i, v in enumerate(values)], names=[c.split()[0] for c in GROUPS.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, labels, vectors, anchors, so_far = (batch.column(c)[i].as_py() for c in range(6))
                at, ids, labels, so_far = (np.frombuffer(x, np.int64) for x in (anchors, ids, labels, so_far))
                vectors = np.frombuffer(vectors, np.int32).reshape(len(ids), dim)
                held.append((block * BLOCK + at, ids[at], labels[at], vectors[at], so_far))
                while sum(len(x[0]) for x in held) >= GROUP:
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield group([x[:GROUP] for x in whole])
                    held, made = [tuple(x[GROUP:] for x in whole)], made + 1
        if sum(len(x[0]) for x in held):
            yield group([np.concatenate(x) for x in zip(*held, strict=True)])

    some = blocks.where(F.octet_length("anchors") > 0)
    return some.select("block", "ids", "labels", "vectors", "anchors", "so_far").mapInArrow(work, GROUPS)


def zone_chunks(blocks: DataFrame) -> DataFrame:
    """Zone maps of up to `CHUNK` blocks in a row, with a number of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() * PART, 0
        held: list[pa.RecordBatch] = []
        names = ["chunk", "block", "label_lo", "label_hi", "zone_lo", "zone_hi"]

        def chunk(table: pa.Table) -> pa.RecordBatch:
            numbers = [table.column(i).to_numpy().tobytes() for i in range(3)]
            zones = [b"".join(table.column(i).to_pylist()) for i in (3, 4)]
            return pa.RecordBatch.from_arrays([pa.array([base + made]), *(pa.array([x], pa.binary()) for x in numbers + zones)], names=names)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= CHUNK:
                whole = pa.Table.from_batches(held)
                yield chunk(whole.slice(0, CHUNK))
                held, made = whole.slice(CHUNK).to_batches(), made + 1
        if sum(b.num_rows for b in held):
            yield chunk(pa.Table.from_batches(held))

    zones = blocks.select("block", "label_lo", "label_hi", "zone_lo", "zone_hi")
    return zones.mapInArrow(work, "chunk bigint, block binary, label_lo binary, label_hi binary, zone_lo binary, zone_hi binary")


PAIRS = "grp bigint, block bigint, at array<bigint>"


def met(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every group beside every chunk of zone maps: chunks are dealt to as many slots as
    there are chunks, groups are copied once per slot."""
    slots = max(1, chunks.count())
    copies = groups.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = chunks.withColumn("slot", F.pmod(F.xxhash64("chunk"), F.lit(slots)).cast("int")).drop("chunk")
    return copies.join(dealt, "slot").drop("slot")


def zones(batch: pa.RecordBatch, i: int, dim: int) -> tuple[np.ndarray, ...]:
    """Numbers, least and largest labels, least and largest components of a chunk's blocks."""
    cell = {c: np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("block", "label_lo", "label_hi", "zone_lo", "zone_hi")}
    return cell["block"], cell["label_lo"], cell["label_hi"], cell["zone_lo"].reshape(-1, dim), cell["zone_hi"].reshape(-1, dim)


def cells(batch: pa.RecordBatch, i: int, dim: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a group or block."""
    ids, labels = (np.frombuffer(batch.column(prefix + c)[i].as_py(), np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(batch.column(prefix + "vectors")[i].as_py(), np.int32).reshape(-1, dim).astype(np.int64)


def pairs(grp: int, block: np.ndarray, read: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each block that some anchor reads, which anchors do. `read`: anchor x block."""
    some = np.flatnonzero(read.any(axis=0))
    if len(some):
        at = pa.array([np.flatnonzero(read[:, b]) for b in some], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), grp)), pa.array(block[some]), at], names=["grp", "block", "at"])


def for_positives(groups: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """The (group, block) pairs to be read for positives."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, labels, q = cells(batch, i, dim)
                so_far = np.frombuffer(batch.column("so_far")[i].as_py(), np.int64)
                block, label_lo, label_hi, lo, hi = zones(batch, i, dim)
                read = (label_lo <= labels[:, None]) & (labels[:, None] <= label_hi) & (bounds(q, lo, hi)[1] >= so_far[:, None])
                yield from pairs(batch.column("grp")[i].as_py(), block, read)

    return met(groups.select("grp", "ids", "labels", "vectors", "so_far"), chunks).mapInArrow(work, PAIRS)


def probes(groups: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """For each anchor with positives the `PROBES` blocks with another label of the largest upper bounds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, labels, q = cells(batch, i, dim)
                some = np.unique(np.array([w["at"] for w in batch.column("windows")[i].as_py()], np.int64))
                block, label_lo, label_hi, lo, hi = zones(batch, i, dim)
                top = bounds(q[some], lo, hi)[1]
                top[(label_lo == labels[some, None]) & (label_hi == labels[some, None])] = NONE
                best = np.argsort(-top, axis=1, kind="stable")[:, :PROBES]
                most = np.take_along_axis(top, best, axis=1)
                row, col = np.nonzero(most > NONE)
                arrays = [np.full(len(row), batch.column("grp")[i].as_py()), some[row], block[best[row, col]], most[row, col]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["grp", "one", "block", "most"])

    found = met(groups.select("grp", "ids", "labels", "vectors", "windows"), chunks)
    rows = found.mapInArrow(work, "grp bigint, one bigint, block bigint, most bigint")
    order = Window.partitionBy("grp", "one").orderBy(F.desc("most"), "block")
    kept = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PROBES)
    return kept.groupBy("grp", "block").agg(F.sort_array(F.collect_list("one")).alias("at"))


def window_arrays(cell: list[dict], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, rank of the positive, least and largest score, and the bound so far of each window."""
    at, rank, so_far = (np.array([w[c] for w in cell], np.int64) for c in ("at", "rank", "so_far"))
    bottom = np.array([-((-low * w["score"]) // 100) for w in cell], np.int64)
    top = np.array([high * w["score"] // 100 for w in cell], np.int64)
    return at, rank, bottom, top, np.maximum(bottom, so_far)


def for_negatives(groups: DataFrame, chunks: DataFrame, dim: int, low: int, high: int) -> DataFrame:
    """The (group, block) pairs to be read for negatives."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, labels, q = cells(batch, i, dim)
                at, _, _, top, least = window_arrays(batch.column("windows")[i].as_py(), low, high)
                block, label_lo, label_hi, lo, hi = zones(batch, i, dim)
                lowest, highest = bounds(q, lo, hi)
                other = (label_lo != labels[:, None]) | (label_hi != labels[:, None])
                read = np.zeros(lowest.shape, bool)
                hit = (lowest[at] <= top[:, None]) & (highest[at] >= least[:, None]) & (least <= top)[:, None]
                np.logical_or.at(read, at, hit & other[at])
                yield from pairs(batch.column("grp")[i].as_py(), block, read)

    return met(groups.select("grp", "ids", "labels", "vectors", "windows"), chunks).mapInArrow(work, PAIRS)


def read_blocks(wanted: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """The wanted pairs with the vectors of both sides."""
    named = blocks.select("block", *(F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "vectors")))
    return wanted.join(groups, "grp").join(named, "block")


FOUND = "grp bigint, one bigint, rank int, anchor_id bigint, other_id bigint, score bigint"


def _found(grp: int, one: np.ndarray, rank: np.ndarray, anchors: np.ndarray, others: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    arrays = [np.full(len(one), grp), one, rank.astype(np.int32), anchors, others, scores]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[c.split()[0] for c in FOUND.split(", ")])


def positives(found: DataFrame, dim: int, n_pos: int) -> DataFrame:
    """The first `n_pos` other rows of the same label, of every pair and then of all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = np.array(batch.column("at")[i].as_py(), np.int64)
                ids, labels, q = cells(batch, i, dim)
                others, b_labels, b_q = cells(batch, i, dim, "b_")
                rows = np.frombuffer(batch.column("rows")[i].as_py(), np.int64)[at]
                order = np.argsort(others, kind="stable")
                own = batch.column("block")[i].as_py() * BLOCK + order
                scores = products(q[at], b_q[order])
                scores[(labels[at][:, None] != b_labels[order]) | (rows[:, None] == own)] = NONE
                best = np.argsort(-scores, axis=1, kind="stable")[:, :n_pos]
                most = np.take_along_axis(scores, best, axis=1)
                so_far = np.frombuffer(batch.column("so_far")[i].as_py(), np.int64)[at]
                row, col = np.nonzero((most > NONE) & (most >= so_far[:, None]))
                yield _found(batch.column("grp")[i].as_py(), at[row], col, ids[at[row]], others[order][best[row, col]], most[row, col])

    order = Window.partitionBy("grp", "one").orderBy(F.desc("score"), "other_id")
    return found.mapInArrow(work, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_pos)


def negatives(found: DataFrame, dim: int, n_neg: int, low: int, high: int) -> DataFrame:
    """The first `n_neg` rows of other labels in each window, of every pair and then of all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = np.array(batch.column("at")[i].as_py(), np.int64)
                ids, labels, q = cells(batch, i, dim)
                others, b_labels, b_q = cells(batch, i, dim, "b_")
                of, rank, _, top, least = window_arrays(batch.column("windows")[i].as_py(), low, high)
                mine = np.flatnonzero(np.isin(of, at))
                line = np.searchsorted(at, of[mine])
                order = np.argsort(others, kind="stable")
                scores = products(q[at], b_q[order])
                scores[labels[at][:, None] == b_labels[order]] = NONE
                sorting = np.argsort(-scores, axis=1, kind="stable")
                scores = np.take_along_axis(scores, sorting, axis=1)
                first = (scores[line] > top[mine, None]).sum(axis=1)
                place = first[:, None] + np.arange(n_neg)
                inside = place < scores.shape[1]
                place = np.where(inside, place, 0)
                got = scores[line[:, None], place]
                row, col = np.nonzero(inside & (got >= least[mine, None]) & (got > NONE))
                where = line[row]
                yield _found(
                    batch.column("grp")[i].as_py(), at[where], rank[mine][row], ids[at[where]],
                    others[order][sorting[where, place[row, col]]], got[row, col],
                )

    order = Window.partitionBy("grp", "one", "rank").orderBy(F.desc("score"), "other_id")
    return found.mapInArrow(work, FOUND).withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_neg)


def with_windows(groups: DataFrame, best: DataFrame, so_far: DataFrame | None = None) -> DataFrame:
    """Groups with their windows: at most `GROUP` x `n_pos` (anchor, rank, score, bound so far)."""
    rows = best if so_far is None else best.join(so_far, ["grp", "one", "rank"], "left")
    known = F.lit(NONE) if so_far is None else F.coalesce("so_far", F.lit(NONE))
    cell = F.struct(F.col("one").alias("at"), "rank", "score", known.cast("bigint").alias("so_far"))
    return groups.drop("so_far").join(rows.groupBy("grp").agg(F.sort_array(F.collect_list(cell)).alias("windows")), "grp")


def mine(
    vectors: DataFrame, anchor: Column, n_pos: int = N_POS, n_neg: int = N_NEG, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    visited: list | None = None,
) -> DataFrame:
    """One row per anchor, positive and rank: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. `vectors`: vec_id, embedding, label; `anchor`
    says which rows are anchors. `visited` is told (step, (anchor, block) pairs read, all pairs)."""
    columns = [F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding", anchor.alias("anchor")]
    rows = taking_part(spread(vectors.select(columns)), scale)
    dim, *curve = spreads(rows)
    dim = max(dim, 1)
    blocks = stored(blocks_of(with_place(rows, dim, *curve), dim, n_pos), "hard-blocks")
    groups = stored(groups_of(blocks, dim), "hard-groups")
    chunks = stored(zone_chunks(blocks), "hard-zones")

    def reading(wanted: DataFrame, step: str) -> DataFrame:
        if visited is not None:
            wanted = stored(wanted, "hard-pairs")
            of = groups.agg(F.sum(F.octet_length("ids") / 8).alias("n")).first()["n"] or 0
            visited.append((step, wanted.agg(F.sum(F.size("at")).alias("n")).first()["n"] or 0, of * blocks.count()))
        return wanted

    best = stored(positives(read_blocks(reading(for_positives(groups, chunks, dim), "positives"), groups, blocks), dim, n_pos), "hard-positives")
    probing = stored(with_windows(groups, best), "hard-windows")
    bound = negatives(read_blocks(probes(probing, chunks, dim), probing, blocks), dim, n_neg, low, high).where(F.col("r") == n_neg)
    searching = stored(with_windows(groups, best, bound.select("grp", "one", "rank", F.col("score").alias("so_far"))), "hard-windows")
    found = negatives(read_blocks(reading(for_negatives(searching, chunks, dim, low, high), "negatives"), searching, blocks), dim, n_neg, low, high)
    p = best.select("grp", "one", "rank", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(p, ["grp", "one", "rank"]).select(
        "anchor_id", "positive_id", F.col("r").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
