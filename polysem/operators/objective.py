"""Losses, sense assignment, gradients and SGD over the corpus.

Three shapes are used. Where the model fits in memory (`session.fits`), every worker
holds it, sentences stream past it and nothing is shuffled for a token. Beyond
that, what needs whole sentences runs per bucket: sentences are hashed into
buckets of bounded size, the model rows that a group of buckets touches are
joined to it, and a NumPy kernel works on the two; a sum over pairs at fixed
parameters is a join and aggregate, equal pairs counted before the shuffle.
SGD always runs per bucket, the buckets of a group side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from polysem.functions import losses as fl
from polysem.functions import vectors as fv
from polysem.functions.hashing import uniform
from polysem.operators import kernels as K
from polysem.operators.corpus import ENCODE, PIECE, pack, pieces, sense_number, sense_of, word_of
from polysem.operators.joins import lookup_join
from polysem.operators.pairs import context_windows
from polysem.session import fits, stored

INPUT, OUTPUT, SUMMARY = 0, 1, -1
# Buckets that one task works on side by side, at most.
GROUP, LEAST_GROUP = 64, 8
# Rows of a table that leaves a task at a time.
SENT_ROWS = 1 << 16
# Tokens of a piece that is swept: position by position, for all sentences at once.
SWEPT = 1 << 20


def bucket_of(n_buckets: int, seed: int) -> Column:
    u = uniform(seed, "bucket", F.col("doc_id"), F.col("line"))
    return F.floor(u * n_buckets).cast("int")


def with_codes(model: DataFrame) -> DataFrame:
    return model.select("mat", pack(F.col("word_id"), F.col("sense")).alias("code"), "vec")


def output_code(code: Column, objective: K.Objective) -> Column:
    return F.floor(code / ENCODE) * ENCODE if objective.one_sense_output else code


def _all_senses(codes: Column, objective: K.Objective) -> Column:
    def of_word(code: Column) -> Column:
        word = word_of(code)
        senses = F.sequence(F.lit(0), sense_number(word, list(objective.cuts)) - 1)
        return F.transform(senses, lambda s: pack(word, s))

    return F.flatten(F.transform(codes, of_word))


def touched_rows(bucketed: DataFrame, objective: K.Objective, all_senses: bool) -> DataFrame:
    """(bucket, mat, code): the model rows a bucket reads."""
    codes = F.col("codes")
    every = _all_senses(codes, objective) if all_senses else codes
    outputs = every if all_senses and not objective.one_sense_output else codes
    outputs = F.transform(outputs, lambda c: output_code(c, objective).cast("bigint"))
    outputs = F.array_distinct(F.concat(outputs, F.flatten("negs")))
    inputs = F.array_distinct(every)
    rows = F.concat(
        F.transform(inputs, lambda c: F.struct(F.lit(INPUT).alias("mat"), c.alias("code"))),
        F.transform(outputs, lambda c: F.struct(F.lit(OUTPUT).alias("mat"), c.alias("code"))),
    )
    return bucketed.select("bucket", F.explode(rows).alias("r")).select("bucket", "r.*").distinct()


def fits_in_memory(model_rows: int, dim: int, model: DataFrame) -> bool:
    """Whether a worker may hold a model: a code, the place of its word and a vector, FLOAT
    or DOUBLE as it is stored, for every row. Gradients take 8 bytes per dimension beside it."""
    width = 4 if isinstance(model.schema["vec"].dataType.elementType, FloatType) else 8
    return fits(model_rows, width * dim + 12)


def held(model: DataFrame) -> Broadcast:
    """Input rows and output rows for every worker, of a model that fits in memory."""
    table = with_codes(model).toArrow()
    return model.sparkSession.sparkContext.broadcast((K.rows_of(table, INPUT, None), K.rows_of(table, OUTPUT, None)))


def held_if_fits(model: DataFrame) -> Broadcast | None:
    first = model.select(F.size("vec").alias("dim")).first()
    return held(model) if fits_in_memory(model.count(), first["dim"] if first else 1, model) else None


def per_piece(coded: DataFrame, rows: Broadcast, objective: K.Objective, kernel: Callable, schema: str, tokens: int = PIECE) -> DataFrame:
    """Run `kernel(pieces as buckets, input rows, output rows)`, which yields tables, over
    the sentences (doc_id, line, codes, negs) of every partition; `rows` as `held`."""

    def run(batches):
        inputs, outputs = rows.value
        for table in kernel((K.Bucket(t, objective) for t in pieces(batches, "codes", tokens)), inputs, outputs):
            yield from table.to_batches()

    return coded.select("doc_id", "line", "codes", "negs").mapInArrow(run, schema)


def each(kernel: Callable[[K.Bucket, K.Rows, K.Rows], pa.Table]) -> Callable:
    """A kernel of one bucket, for `per_piece`."""
    return lambda buckets, inputs, outputs: (kernel(b, inputs, outputs) for b in buckets)


def group_count(n_buckets: int, cores: int) -> int:
    """Groups of at most GROUP buckets; a few buckets are faster side by side than apart."""
    width = min(max(n_buckets // cores, LEAST_GROUP), GROUP)
    return -(-n_buckets // width)


def per_bucket(
    coded: DataFrame, model: DataFrame, objective: K.Objective, n_buckets: int, seed: int,
    kernel: Callable[[K.Bucket, K.Rows, K.Rows], pa.Table], schema: str, all_senses: bool = False, apart: bool = False,
    draw: Callable[[DataFrame], DataFrame] | None = None, summed: Callable | None = None,
) -> DataFrame:
    """Run `kernel(sentences, input rows, output rows)` for every group of buckets, or,
    where the model fits in memory and buckets need not be kept `apart`, for every piece
    of the sentences. `coded` is (doc_id, line, codes, negs). A kernel that keeps
    buckets apart finds them in `bucket.parts`. With `draw`, which adds negs to rows, `coded`
    has none yet: where the model fits in memory they are drawn after the shuffle. There a task
    takes several groups one after another, and `summed(groups, input rows, output rows)`, which yields
    tables, can add up what `kernel` returns of each."""
    rows = held_if_fits(model)
    if draw is not None and (rows is None or not apart):
        coded, draw = draw(coded), None
    if rows is not None and not apart:
        return per_piece(coded, rows, objective, each(kernel), schema, SWEPT if all_senses else PIECE)
    n_groups = group_count(n_buckets, coded.sparkSession.sparkContext.defaultParallelism)
    group = F.floor(F.col("bucket").cast("bigint") * n_groups / n_buckets).cast("int")
    drawn = [] if draw is not None else ["negs"]
    bucketed = coded.select(bucket_of(n_buckets, seed).alias("bucket"), "doc_id", "line", "codes", *drawn)
    bucketed = bucketed.withColumn("group", group)

    if rows is not None:
        # a model that fits in memory has twice the words of a distribution that does, so drawing shuffles nothing;
        # one group is one partition, so nothing is sorted to find it, and a task takes its groups one after another
        dealt = bucketed.repartitionById(n_groups, "group").coalesce(coded.sparkSession.sparkContext.defaultParallelism)
        dealt = draw(dealt) if draw is not None else dealt

        def run_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = (K.Bucket(sentences, objective) for sentences in _groups(batches))
            for table in (summed or each(kernel))(groups, *rows.value):
                yield from table.to_batches(max_chunksize=SENT_ROWS)

        return dealt.select("bucket", "group", "doc_id", "line", "codes", "negs").mapInArrow(run_held, schema)

    bucketed = stored(bucketed, "buckets")  # read twice
    touched = touched_rows(bucketed.withColumn("bucket", F.col("group")), objective, all_senses).join(with_codes(model), ["mat", "code"])

    def run(sentences: pa.Table, touched: pa.Table) -> pa.Table:
        return kernel(K.Bucket(sentences, objective), K.rows_of(touched, INPUT), K.rows_of(touched, OUTPUT))

    touched = touched.select(F.col("bucket").alias("of_group"), "mat", "code", "vec")
    # one group is one partition: no two groups meet in a task
    left = bucketed.repartitionById(n_groups, "group").groupBy("group")
    right = touched.repartitionById(n_groups, "of_group").groupBy("of_group")
    return left.cogroup(right).applyInArrow(run, schema)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sentences of each group, which stand together."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        ends = np.flatnonzero(np.diff(batch.column("group").to_numpy())) + 1
        for first, end in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            some = batch.slice(first, end - first)
            if kept and some.num_rows and kept[0].column("group")[0] != some.column("group")[0]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept += [some] if some.num_rows else []
    if kept:
        yield pa.Table.from_batches(kept)


# --- losses ---------------------------------------------------------------------


PAIR_LOSS = "doc_id bigint, line int, pos int, ctx_pos int, loss double, n_pred bigint, in_code bigint"


def pair_losses(bucket: K.Bucket, inputs: K.Rows, outputs: K.Rows) -> pa.Table:
    everything = np.arange(bucket.n)
    parts = list(K.pair_losses(bucket, inputs, outputs, everything, bucket.codes))
    i = np.concatenate([p[0] for p in parts]) if parts else everything[:0]
    j = np.concatenate([p[1] for p in parts]) if parts else everything[:0]
    loss = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0)
    pos, sentence = bucket.pos(), bucket.sentence[i]
    return pa.table({
        "doc_id": bucket.table["doc_id"].to_numpy()[sentence],
        "line": bucket.table["line"].to_numpy()[sentence],
        "pos": pos[i].astype(np.int32),
        "ctx_pos": pos[j].astype(np.int32),
        "loss": loss,
        "n_pred": np.full(len(i), bucket.predictions, dtype=np.int64),
        "in_code": bucket.codes[i],
    })


def pair_loss(coded: DataFrame, model: DataFrame, objective: K.Objective, n_buckets: int, seed: int) -> DataFrame:
    """Loss and number of predictions of every (pos, ctx_pos) pair."""
    return per_bucket(coded, model, objective, n_buckets, seed, pair_losses, PAIR_LOSS).drop("in_code")


SENTENCE_LOSS = "doc_id bigint, line int, loss double, n_pred bigint"


def sentence_losses(bucket: K.Bucket, inputs: K.Rows, outputs: K.Rows) -> pa.Table:
    loss, count = K.position_losses(bucket, inputs, outputs, np.arange(bucket.n), bucket.codes)
    n = len(bucket.starts) - 1
    return pa.table({
        "doc_id": bucket.table["doc_id"],
        "line": bucket.table["line"],
        "loss": np.bincount(bucket.sentence, loss, n),
        "n_pred": np.bincount(bucket.sentence, count, n).astype(np.int64),
    })


def sentence_loss(coded: DataFrame, model: DataFrame, objective: K.Objective, n_buckets: int, seed: int) -> DataFrame:
    return per_bucket(coded, model, objective, n_buckets, seed, sentence_losses, SENTENCE_LOSS)


def loss_per_prediction(losses: DataFrame) -> DataFrame:
    return losses.agg(
        (F.sum("loss") / F.sum("n_pred")).alias("loss_per_prediction"), F.sum("n_pred").alias("n_pred")
    )


# --- senses ---------------------------------------------------------------------


ASSIGNED = "doc_id bigint, line int, codes array<bigint>, n_adjust bigint"


def swept(bucket: K.Bucket, inputs: K.Rows, outputs: K.Rows) -> pa.Table:
    codes, sweeps = K.sweep_senses(bucket, inputs, outputs)
    return pa.table({
        "doc_id": bucket.table["doc_id"],
        "line": bucket.table["line"],
        "codes": bucket.lists(codes, pa.int64()),
        "n_adjust": sweeps,
    })


def assign_senses(coded: DataFrame, model: DataFrame, objective: K.Objective, n_buckets: int, seed: int) -> DataFrame:
    """Sentences with the codes of the best senses, repeated in place until
    nothing changes, and how many sweeps changed something (n_adjust)."""
    return per_bucket(coded, model, objective, n_buckets, seed, swept, ASSIGNED, all_senses=True)


def adjust_rate(assigned: DataFrame) -> DataFrame:
    return assigned.agg((F.sum("n_adjust") / F.count("*")).alias("adjust_rate"), F.count("*").alias("n_sentences"))


def token_sense_counts(coded: DataFrame) -> DataFrame:
    codes = coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return codes.select(word_of(F.col("code")).alias("word_id"), sense_of(F.col("code")).alias("sense"), "n")


# --- gradients ------------------------------------------------------------------


def target_counts(coded: DataFrame, objective: K.Objective) -> DataFrame:
    """How often input row and output row meet as a positive (label 1) or as a
    negative (label 0) pair. Counted before the shuffle, so the size is bounded
    by the distinct combinations, not by the corpus."""
    windows = context_windows(coded, objective.window, around="codes", negs="negs")
    k = F.col("pos") - F.col("first_pos")

    def without_centre(items: Column) -> Column:
        return F.concat(F.slice(items, 1, k), F.slice(items, k + 2, F.size(items)))

    positives = F.transform(
        without_centre(F.col("around")),
        lambda c: F.struct(output_code(c, objective).cast("bigint").alias("out_code"), F.lit(1).alias("label")),
    )
    negatives = F.transform(
        F.flatten(without_centre(F.col("negs"))), lambda c: F.struct(c.alias("out_code"), F.lit(0).alias("label"))
    )
    targets = windows.select(
        F.element_at("around", k + 1).alias("in_code"), F.explode(F.concat(positives, negatives)).alias("t")
    )
    return targets.groupBy("in_code", "t.out_code", "t.label").agg(F.count("*").alias("n"))


def side(model: DataFrame, mat: int, code: str, vec: str) -> DataFrame:
    return with_codes(model).where(F.col("mat") == mat).select(F.col("code").alias(code), F.col("vec").alias(vec))


def _scored(coded: DataFrame, model: DataFrame, objective: K.Objective, model_rows: int, dim: int) -> DataFrame:
    counts = target_counts(coded, objective)
    row_bytes = 8 * dim + 32
    both = lookup_join(counts, side(model, INPUT, "in_code", "v"), ["in_code"], model_rows, row_bytes)
    both = lookup_join(both, side(model, OUTPUT, "out_code", "u"), ["out_code"], model_rows, row_bytes)
    return both.withColumn("x", fv.dot(F.col("v"), F.col("u")))


def corpus_loss(coded: DataFrame, model: DataFrame, objective: K.Objective, model_rows: int, dim: int) -> DataFrame:
    """Sigmoid loss of the whole set: (loss, n_pred)."""
    if fits_in_memory(model_rows, dim, model):
        losses = per_piece(coded, held(model), objective, each(sentence_losses), SENTENCE_LOSS)
        return losses.agg(F.sum("loss").alias("loss"), F.sum("n_pred").alias("n_pred"))
    scored = _scored(coded, model, objective, model_rows, dim)
    signed = F.when(F.col("label") == 1, F.col("x")).otherwise(-F.col("x"))
    return scored.agg(F.sum(F.col("n") * fl.minus_log_sigmoid(signed)).alias("loss"), F.sum("n").alias("n_pred"))


def sum_vectors(df: DataFrame, keys: list[str], vec: str, dim: int, alias: str = "vec", agg=F.sum) -> DataFrame:
    """Element-wise sum per key: one hash aggregation over `dim` number columns,
    summed up before the shuffle. (A vector-valued aggregate would sort.)"""
    numbers = df.select(*keys, *[F.col(vec)[k].cast("double").alias(f"_{k}") for k in range(dim)])
    sums = numbers.groupBy(*keys).agg(*[agg(f"_{k}").alias(f"_{k}") for k in range(dim)])
    return sums.select(*keys, F.array(*[f"_{k}" for k in range(dim)]).alias(alias))


def sgns_gradient(coded: DataFrame, model: DataFrame, objective: K.Objective, model_rows: int, dim: int) -> DataFrame:
    """Gradient of the sigmoid loss at fixed parameters: (mat, code, vec)."""
    if fits_in_memory(model_rows, dim, model):
        parts = partial_gradients(coded, held(model), objective)
        return sum_vectors(parts.where(F.col("mat") != SUMMARY), ["mat", "code"], "vec", dim)
    scored = _scored(coded, model, objective, model_rows, dim)
    slope = F.col("n") * (fl.sigmoid(F.col("x")) - F.col("label"))
    parts = F.array(
        F.struct(F.lit(INPUT).alias("mat"), F.col("in_code").alias("code"), fv.scale(F.col("u"), slope).alias("g")),
        F.struct(F.lit(OUTPUT).alias("mat"), F.col("out_code").alias("code"), fv.scale(F.col("v"), slope).alias("g")),
    )
    return sum_vectors(scored.select(F.explode(parts).alias("p")).select("p.*"), ["mat", "code"], "g", dim)


def _row_table(mat: int, rows: K.Rows, values: np.ndarray, touched: np.ndarray | None = None) -> pa.Table:
    touched = np.flatnonzero(values.any(axis=1)) if touched is None else touched
    dim = values.shape[1]
    offsets = pa.array(np.arange(len(touched) + 1) * dim, pa.int32())
    return pa.table({
        "mat": pa.array(np.full(len(touched), mat), pa.int32()),
        "code": rows.codes[touched],
        "vec": pa.ListArray.from_arrays(offsets, pa.array(values[touched].ravel(), pa.float64())),
        "loss": np.zeros(len(touched)),
        "n_pred": np.zeros(len(touched), dtype=np.int64),
        "n_tokens": np.zeros(len(touched), dtype=np.int64),
    })


def _row_tables(mat: int, rows: K.Rows, values: np.ndarray) -> Iterator[pa.Table]:
    """The touched rows, some at a time: a copy of them all would be as large as the model."""
    for first in range(0, len(values), SENT_ROWS):
        yield _row_table(mat, rows, values, first + np.flatnonzero(values[first : first + SENT_ROWS].any(axis=1)))


def _summary(loss: float, n_pred: int, n_tokens: int) -> pa.Table:
    return pa.table({
        "mat": pa.array([SUMMARY], pa.int32()),
        "code": pa.array([0], pa.int64()),
        "vec": pa.array([[]], pa.list_(pa.float64())),
        "loss": [float(loss)],
        "n_pred": [int(n_pred)],
        "n_tokens": [int(n_tokens)],
    })


UPDATES = "mat int, code bigint, vec array<double>, loss double, n_pred bigint, n_tokens bigint"


def _added_gradients(buckets: Iterable[K.Bucket], inputs: K.Rows, outputs: K.Rows, add: Callable = K.add_gradients) -> Iterator[pa.Table]:
    """Gradients, or what else `add` finds, of all buckets added up, touched rows only, and one summary row."""
    loss, n, tokens = 0.0, 0, 0
    d_in, d_out = K.no_gradient(inputs), K.no_gradient(outputs)
    for bucket in buckets:
        more = add(bucket, inputs, outputs, d_in, d_out)
        loss, n, tokens = loss + more[0], n + more[1], tokens + bucket.n
    yield from _row_tables(INPUT, inputs, d_in)
    yield from _row_tables(OUTPUT, outputs, d_out)
    yield _summary(loss, n, tokens)


def partial_gradients(coded: DataFrame, rows: Broadcast, objective: K.Objective) -> DataFrame:
    """Gradients in no more parts than tasks run at a time: each has all the rows it
    touches, frequent words are in every one, and all of it is shuffled."""
    few = coded.coalesce(coded.sparkSession.sparkContext.defaultParallelism)
    return per_piece(few, rows, objective, _added_gradients, UPDATES)


def bucket_gradients(coded, model, objective: K.Objective, n_buckets: int, seed: int) -> DataFrame:
    """The gradient of either loss at fixed parameters in parts that add up: each is of
    the buckets that one task has, touched rows only, and has one summary row."""

    def kernel(bucket, inputs, outputs):
        return pa.concat_tables(_added_gradients([bucket], inputs, outputs))

    rows = held_if_fits(model)
    if rows is not None:
        return partial_gradients(coded, rows, objective)
    return per_bucket(coded, model, objective, n_buckets, seed, kernel, UPDATES)


def softmax_gradient(coded, model, objective: K.Objective, n_buckets: int, seed: int, dim: int) -> DataFrame:
    parts = bucket_gradients(coded, model, objective, n_buckets, seed).where(F.col("mat") != SUMMARY)
    return sum_vectors(parts, ["mat", "code"], "vec", dim)


# --- SGD ------------------------------------------------------------------------


def sgd_epoch(
    coded, model, objective: K.Objective, n_buckets: int, seed: int, alpha: float, batch: int = 1,
    draw: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One SGD pass, every bucket from the same base model: the changes of the touched
    rows, added up over the buckets of a task, plus one summary row (loss, predictions,
    tokens). batch=1 is plain sequential SGD; larger values use mini-batches. `draw` as in
    `per_bucket`."""

    def summed(buckets, inputs, outputs):
        return _added_gradients(buckets, inputs, outputs, partial(K.add_sgd, alpha=alpha, batch=batch))

    def kernel(bucket, inputs, outputs):
        return pa.concat_tables(summed([bucket], inputs, outputs))

    return per_bucket(coded, model, objective, n_buckets, seed, kernel, UPDATES, apart=True, draw=draw, summed=summed)
