"""Near copies by DartMinHash signatures.

A document is the set of its five-word shingles (a text with fewer words is one
shingle; words are folded runs of letters and digits). Each element owns the
region [0, weight) x [0, infinity) and darts are thrown into its unit squares by
a Poisson process whose points are hashes of element, unit and number: every
dart has a height (rank), a place along the weight and one of `SIZE` coordinates.
Of the darts inside the regions of a document the lowest per coordinate is its
signature; two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Only darts below a rank that suffices for all
coordinates are ever made, so the work is that of reading the elements plus
SIZE log SIZE. The queries use weight 1, for which this is plain Jaccard.

1. Documents with equal sets (by a 64-bit key of them) are one from here on.
2. `BANDS` bands of `ROWS` coordinates are joined: in each bucket every member
   is tied to two members that a hash picks, so a bucket of n makes 2n ties.
   Ties whose signatures agree in less than half of all coordinates go. Where
   members of a bucket are in different clusters after that, all of its members
   are compared, in pairs of blocks of bounded size, and tied where they agree
   in half: every pair that shares a bucket is in one cluster or was compared.
   At similarity 0.8 two documents share no bucket with probability 5e-8.
3. Connected ties are clusters. Within each cluster all pairs of its documents
   are verified on whole sets, in pairs of blocks of bounded size, so a large
   cluster is spread over tasks; a task returns a link only where it joins two
   so far unjoined documents.
4. Classes are the connected documents of the links.

A null or empty text, and one without words, is alone. Null ids come last.
Rows that repeat id and text stay or go together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.llm import chars
from polysem.llm.chars import small
from polysem.llm.sketch import maybe_in
from polysem.session import stored

SHINGLE = 5
SIZE, BANDS, ROWS = 128, 32, 4
SIMILAR = 0.8
TIE = 0.5
# Elements and sets of a block; a task verifies two blocks.
BLOCK_ELEMENTS, BLOCK_SETS = 100_000, 4096
# Members of a block of a bucket; a task compares two blocks.
BLOCK_MEMBERS = 1024


def shingles(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, element and multiplicity of the distinct shingles, sorted."""
    points, starts = chars.code_points(texts)
    owner, _, _, word = chars.words(points, starts)
    if not len(word):
        return owner, word, owner
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    size = np.diff(np.append(first, len(owner)))
    # A short text has one shingle, of all its words.
    left = np.repeat(first + size, size) - np.arange(len(word))
    short = np.repeat(size, size) < n
    head = np.zeros(len(word), bool)
    head[first] = True
    begin = np.flatnonzero((left >= n) | (short & head))
    padded = np.concatenate([word, np.zeros(n, np.uint64)])
    value = np.zeros(len(begin), np.uint64)
    for k in range(n):
        inside = left[begin] > k
        value = value * np.uint64(chars.BASE) + np.where(inside, padded[begin + k], np.uint64(k + 1))
    value, text = chars.mixed(value), owner[begin]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(value)))


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def dart_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, size: int = SIZE) -> np.ndarray:
    """Signatures (text x coordinate, uint64) of weighted sets; 0 for empty ones."""
    out = np.zeros((n_texts, size), np.uint64)
    positive = weight > 0
    text, element, weight = text[positive], element[positive], weight[positive].astype(float)
    if not len(text):
        return out
    # One square for each begun unit of weight.
    units = np.ceil(weight).astype(np.int64)
    square = np.repeat(np.arange(len(text)), units)
    unit = np.arange(len(square)) - np.repeat(np.cumsum(units) - units, units)
    seed = chars.mixed(element[square] + unit.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner, room = text[square], weight[square] - unit
    total = np.bincount(text, weight, minlength=n_texts)
    limit = (np.log(size) + 3) / np.maximum(total, 1e-300)
    lowest = np.full((n_texts, size), np.inf)
    step = np.uint64(0x9FB21C651E98DF25)

    number = np.ones(len(seed), np.uint64)
    rank = -np.log(uniform(chars.mixed(seed + step))) / size
    live = np.arange(len(seed))
    while len(live):
        live = live[rank[live] <= limit[owner[live]]]
        while len(live):
            dart = chars.mixed(seed[live] ^ (number[live] * np.uint64(0xA0761D6478BD642F)))
            inside = uniform(chars.mixed(dart + np.uint64(1))) <= room[live]
            who, dart_in, height = owner[live][inside], dart[inside], rank[live][inside]
            cell = who * size + (dart_in % np.uint64(size)).astype(np.int64)
            order = np.lexsort((height, cell))
            first = order[np.flatnonzero(np.diff(cell[order], prepend=-1))]
            low, sig = lowest.reshape(-1), out.reshape(-1)
            better = first[height[first] < low[cell[first]]]
            low[cell[better]], sig[cell[better]] = height[better], dart_in[better]
            number[live] += np.uint64(1)
            rank[live] -= np.log(uniform(chars.mixed(seed[live] + number[live] * step))) / size
            live = live[rank[live] <= limit[owner[live]]]
        # Where a coordinate is still without a dart, look twice as high.
        open_ = np.isinf(lowest).any(axis=1) & (total > 0)
        limit[open_] *= 2
        live = np.flatnonzero(open_[owner])
    return out


SIGNED = "row_key bigint, doc_id bigint, set_id bigint, n int, signature binary"


def _coordinates(found: np.ndarray) -> pa.Array:
    """Signatures as bytes, 16 bits per coordinate, so that a band is 8 bytes."""
    return pa.array([s.tobytes() for s in (found >> np.uint64(48)).astype("<u2")], pa.binary())


def signatures(rows: DataFrame) -> DataFrame:
    """`rows` (row_key, doc_id, text) with a 64-bit key of the set (null without
    words), its size and its signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for start, some in chars.text_slices([t or "" for t in batch.column(2).to_pylist()]):
                text, element, _ = shingles(some)
                found = dart_minhash(text, element, np.ones(len(text)), len(some))
                size = np.bincount(text, minlength=len(some))
                keys = [
                    int.from_bytes(hashlib.blake2b(element[e - n : e].tobytes(), digest_size=8).digest(), "little", signed=True)
                    if n else None
                    for e, n in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)
                ]
                part = batch.slice(start, len(some))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.int64()), pa.array(size, pa.int32()), _coordinates(found)],
                    names=["row_key", "doc_id", "set_id", "n", "signature"],
                )

    return rows.select("row_key", "doc_id", "text").mapInArrow(work, SIGNED)


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of the edges (a, b): a vertex that stands for all
    that it is connected with. In each round a vertex takes the smallest of
    itself and its neighbours, then what that one took; edges are then drawn
    between what their ends took, so they get fewer and fewer."""
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stored(ordered(edges), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("low")), "low")
        took = low.join(low.toDF("low", "lower"), "low").select(F.col("a").alias("v"), F.col("lower").alias("label"))
        rounds.append(stored(took, "labels"))
        ends = left.join(rounds[-1].toDF("a", "la"), "a").select("b", "la").join(rounds[-1].toDF("b", "lb"), "b")
        left = stored(ordered(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))), "edges")
    if not rounds:
        return left.select(F.col("a").alias("v"), F.col("b").alias("label"))
    labels = rounds[0]
    for later in rounds[1:]:
        met = labels.join(later.toDF("label", "next"), "label", "left")
        labels = met.select("v", F.coalesce("next", "label").alias("label"))
    return stored(labels, "components")


def agreement(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def share(x, y):  # noqa: ANN001
        import pandas as pd

        left = np.frombuffer(b"".join(x), np.uint16).reshape(-1, SIZE)
        right = np.frombuffer(b"".join(y), np.uint16).reshape(-1, SIZE)
        return pd.Series((left == right).mean(axis=1))

    return share(a, b)


def in_buckets(reps: DataFrame, *columns: str) -> DataFrame:
    """The columns and bucket of every document of `reps` in every band."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bucket = F.xxhash64("band", F.expr(f"substring(signature, band * {2 * ROWS} + 1, {2 * ROWS})"))
    return reps.select(*columns, "signature", band).select(*columns, bucket.alias("bucket"))


def ties(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of a document and one of two that are picked in a bucket.
    `reps`: rep, signature."""
    members = in_buckets(reps, "rep")
    # The same few documents are picked in all buckets in which they are.
    pick = F.xxhash64("rep")
    heads = members.groupBy("bucket").agg(F.min_by("rep", pick).alias("low"), F.max_by("rep", pick).alias("high"))
    heads = stored(heads.where("low <> high"), "heads")
    met = members.join(heads, "bucket").select("rep", F.explode(F.array("low", "high")).alias("head")).where("rep <> head")
    pairs = met.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    signed = reps.select("rep", "signature")
    full = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b")
    return full.where(agreement("sa", "sb") >= TIE).select("a", "b")


def joining(codes: np.ndarray, root: np.ndarray, apart: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Pairs of rows of `codes` that agree in `TIE` of the coordinates and join
    what `root` has apart; with `apart`, only pairs in which it differs. Changes `root`."""
    for x in range(len(codes) - 1):
        other = root[x + 1 :] != root[x]
        if apart is not None:
            other &= apart[x + 1 :] != apart[x]
        rest = x + 1 + np.flatnonzero(other)
        if not len(rest):
            continue
        for y in rest[(codes[rest] == codes[x]).sum(axis=1) >= TIE * SIZE].tolist():
            if root[y] != root[x]:
                yield x, y
                root[root == root[y]] = root[x]


def more_ties(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of clusters that documents of a bucket tie. `reps`: rep,
    cluster, signature."""
    members = in_buckets(reps, "rep", "cluster")
    sizes = members.groupBy("bucket").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks")
    open_ = stored(sizes.where("low <> high").select("bucket", "n", blocks), "buckets")
    total = open_.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // BLOCK_MEMBERS))
    some = maybe_in(members, F.col("bucket"), open_.select("bucket")).where("_maybe").select("rep", "cluster", "bucket")
    met = some.join(open_, "bucket").join(reps.select("rep", "signature"), "rep")
    # Buckets of one block share bins; others have a group for each pair of blocks.
    large = F.col("blocks") > 1
    dealt = (
        met.withColumn("block", F.when(large, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).otherwise(0))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "rep", "cluster", "bucket", "signature", "block", large.alias("large"),
            F.when(large, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(bins))).alias("bin"),
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )

    def work(table: pa.Table) -> pa.Table:
        buckets, clusters, blocks = (table[c].to_numpy() for c in ("bucket", "cluster", "block"))
        codes = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(-1, SIZE)
        apart = table["large"][0].as_py() and table["i"][0].as_py() != table["j"][0].as_py()
        found: set[tuple[int, int]] = set()
        order = np.argsort(buckets, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], buckets[order][1:] != buckets[order][:-1], [True])))
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            rows = order[start:end]
            own = clusters[rows]
            for x, y in joining(codes[rows], own.copy(), blocks[rows] if apart else None):
                found.add((min(int(own[x]), int(own[y])), max(int(own[x]), int(own[y]))))
        left, right = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return dealt.groupBy("bin", "large", "i", "j").applyInArrow(work, "a bigint, b bigint")


def clustered(reps: DataFrame) -> DataFrame:
    """rep, row_key, cluster of the documents that are tied to others. `reps`: rep,
    row_key, signature."""
    first = components(ties(reps))
    cluster = F.coalesce("label", "rep").alias("cluster")
    met = reps.join(first, reps["rep"] == first["v"], "left")
    named = stored(met.select("rep", "row_key", "signature", cluster, F.col("label").isNotNull().alias("tied")), "tied")
    later = components(more_ties(named))
    both = named.drop("signature").join(later, F.col("cluster") == F.col("v"), "left")
    return both.where("tied or label is not null").select("rep", "row_key", F.coalesce("label", "cluster").alias("cluster"))


def similar_pairs(sets: list[np.ndarray], blocks: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Places of similar sets as far as they join what earlier pairs have not; with
    `blocks`, only pairs from different blocks. The elements of a set lead to all
    sets that share some, in memory linear in the elements."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    first = np.append(np.flatnonzero(new), len(flat))
    element = np.empty(len(flat), np.int64)
    element[order] = np.cumsum(new) - 1
    ends = np.cumsum(size)
    root = np.arange(n)
    for x in range(n - 1):
        open_ = root != root[x]
        open_[: x + 1] = False
        if blocks is not None:
            open_ &= blocks != blocks[x]
        if not open_.any():
            continue
        own = element[ends[x] - size[x] : ends[x]]
        start, count = first[own], first[own + 1] - first[own]
        place = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(holder[place], minlength=n)
        for y in np.flatnonzero(open_ & (both >= SIMILAR * (size + size[x] - both) - 1e-9)).tolist():
            if root[y] != root[x]:
                yield x, y
                root[root == root[y]] = root[x]


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the documents of each cluster as far as they are
    similar. `sets`: rep, cluster, elements."""
    sized = sets.select("rep", "cluster", F.size("elements").alias("n"))
    sizes = sized.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("sets"))
    blocks = F.ceil(F.greatest(F.col("total") / BLOCK_ELEMENTS, F.col("sets") / BLOCK_SETS)).cast("int")
    total = sizes.agg(F.sum("total")).first()[0] or 0
    bins = max(1, -(-total // BLOCK_ELEMENTS))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        sets.join(sizes.select("cluster", blocks.alias("blocks")), "cluster")
        .withColumn("block", F.when(F.col("blocks") > 1, mine).otherwise(0))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # Clusters of one block share bins; others have a group for each pair of blocks.
        .withColumn("bin", F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bins))))
        .select(
            "rep", "cluster", "elements", "block", "bin", (F.col("blocks") > 1).alias("large"),
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )

    def work(table: pa.Table) -> pa.Table:
        reps, clusters, blocks = (table[c].to_numpy() for c in ("rep", "cluster", "block"))
        elements = table["elements"].combine_chunks() if table["elements"].num_chunks != 1 else table["elements"].chunk(0)
        offsets, values = elements.offsets.to_numpy(), elements.values.to_numpy()
        apart = table["large"][0].as_py() and table["i"][0].as_py() != table["j"][0].as_py()
        left, right = [], []
        order = np.argsort(clusters, kind="stable")
        edges = np.flatnonzero(np.diff(clusters[order], prepend=clusters[order[0]] - 1, append=clusters[order[-1]] + 1))
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            rows = order[start:end]
            rows = rows[np.argsort(reps[rows], kind="stable")]
            sets = [values[offsets[r] : offsets[r + 1]] for r in rows]
            for x, y in similar_pairs(sets, blocks[rows] if apart else None):
                left.append(int(reps[rows[x]]))
                right.append(int(reps[rows[y]]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return dealt.groupBy("bin", "large", "i", "j").applyInArrow(work, "a bigint, b bigint")


def element_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, cluster, elements. `wanted`: row_key, rep, cluster."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for start, some in chars.text_slices([t or "" for t in batch.column(1).to_pylist()]):
                text, element, _ = shingles(some)
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(some)))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), lists], names=["row_key", "elements"])

    some = maybe_in(rows.select("row_key", "text"), F.col("row_key"), wanted.select("row_key")).where("_maybe")
    sets = some.select("row_key", "text").mapInArrow(work, "row_key bigint, elements array<bigint>")
    return sets.join(wanted, "row_key").dropDuplicates(["row_key"]).select("rep", "cluster", "elements")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64(docs[id_col].cast("bigint"), docs[text_col]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_key (hash of id and text), doc_id, class_id (the
    smallest id of the class), class_size, kept (one document of each class),
    n_shingles."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = keyed(rows, "doc_id", "text")
    signed = stored(signatures(rows), "signatures")
    reps = stored(
        signed.where("set_id is not null").groupBy(F.col("set_id").alias("rep"))
        .agg(F.first("signature").alias("signature"), F.min("row_key").alias("row_key")), "sets",
    )
    sets = stored(element_sets(rows, stored(clustered(reps), "wanted")), "elements")
    classes = components(links(sets))
    group = F.coalesce("label", "set_id").alias("group")
    named = stored(
        signed.drop("signature").join(classes, F.col("set_id") == F.col("v"), "left").select("row_key", "doc_id", "n", group), "named"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    # Written, so that a hot class on the other side can be split.
    heads = stored(named.where("group is not null").groupBy("group").agg(first, F.count("*").alias("size")), "classes")
    met = named.join(heads, "group", "left")
    alone = F.col("group").isNull()
    return met.select(
        "row_key", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("class_size"),
        (alone | (F.col("row_key") == F.col("first.row_key"))).alias("kept"), F.col("n").alias("n_shingles"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each class. Only rows that a bit table of the
    others does not clear are joined."""
    gone = stored(find(docs, id_col, text_col).where("not kept").select(F.col("row_key").alias("_gone")).distinct(), "dropped")
    # Own columns stand beside a row as a whole, so that no names clash.
    key = F.xxhash64(docs[id_col].cast("bigint"), docs[text_col])
    tested = maybe_in(docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")), F.col("key"), gone)
    doubtful = tested.where("_maybe").join(gone, F.col("key") == F.col("_gone"), "left_anti")
    return tested.where("not _maybe").select("row.*").unionByName(doubtful.select("row.*"))
