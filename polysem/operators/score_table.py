"""Losses and senses at fixed parameters, whatever the size of the model.

Where the model fits in memory, sentences stream past it (`objective.per_piece`).
Beyond that they come from a table of scores.

A score, the product of an input and an output row, is needed wherever the two
meet. Each distinct pair is scored once; the table (input code, output code, x)
is then joined to the places where the pair stands. So no vector travels with a
token, and what is shuffled for a token does not depend on the dimension. All of
it are joins and aggregates; a pair of two frequent words is split by the
adaptive skew join, as both sides are stored.

Where outputs have senses of their own, positions depend on each other and
sentences are swept by `objective.assign_senses` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.functions import losses as fl
from polysem.functions import vectors as fv
from polysem.operators.corpus import pack, sense_number, word_of
from polysem.operators.joins import lookup_join
from polysem.operators.kernels import Objective
from polysem.operators import objective as ob
from polysem.operators.objective import INPUT, OUTPUT, output_code, side, sum_vectors
from polysem.operators.pairs import context_windows
from polysem.session import stored

PLACE = ["doc_id", "line", "pos"]
# Bytes of a score where the table is broadcast.
SCORE_BYTES = 96


def targets(coded: DataFrame, objective: Objective, candidates: bool = False) -> DataFrame:
    """(doc_id, line, pos, ctx_pos, in_code, out_code, label): every position with the
    output row of each context position (label 1) and of the negatives there (label
    0). With `candidates`, only positions of words with several senses, once for
    each sense."""
    windows = context_windows(coded, objective.window, around="codes", negs="negs")
    k = (F.col("pos") - F.col("first_pos")).alias("k")
    windows = windows.select(*PLACE, "first_pos", k, "around", "negs").withColumn("in_code", F.element_at("around", F.col("k") + 1))
    if candidates:
        word = word_of(F.col("in_code"))
        senses = sense_number(word, list(objective.cuts))
        every = F.transform(F.sequence(F.lit(0), senses - 1), lambda s: pack(word, s))
        windows = windows.where(senses > 1).withColumn("in_code", F.explode(every))

    def target(i: Column, code: Column, label: int) -> Column:
        ctx = (F.col("first_pos") + i).cast("int")
        return F.struct(ctx.alias("ctx_pos"), code.cast("bigint").alias("out_code"), F.lit(label).cast("tinyint").alias("label"))

    def at(code: Column, i: Column) -> Column:
        negatives = F.transform(F.element_at("negs", i + 1), lambda n: target(i, n, 0))
        return F.concat(F.array(target(i, output_code(code, objective), 1)), negatives)

    others = F.filter(F.transform("around", lambda c, i: F.when(i != F.col("k"), at(c, i))), lambda x: x.isNotNull())
    return windows.select(*PLACE, "in_code", F.explode(F.flatten(others)).alias("t")).select(*PLACE, "in_code", "t.*")


def scores(rows: DataFrame, model: DataFrame, model_rows: int, dim: int) -> DataFrame:
    """(in_code, out_code, x) of the distinct pairs of `rows`, stored."""
    pairs = rows.select("in_code", "out_code").distinct()
    row_bytes = 8 * dim + 32
    both = lookup_join(pairs, side(model, INPUT, "in_code", "v"), ["in_code"], model_rows, row_bytes)
    both = lookup_join(both, side(model, OUTPUT, "out_code", "u"), ["out_code"], model_rows, row_bytes)
    return stored(both.select("in_code", "out_code", fv.dot(F.col("v"), F.col("u")).alias("x")), "scores")


def scored(rows: DataFrame, model: DataFrame, model_rows: int, dim: int) -> DataFrame:
    """`rows` (with in_code, out_code) with their scores."""
    table = scores(rows, model, model_rows, dim)
    return lookup_join(rows, table, ["in_code", "out_code"], table.count(), SCORE_BYTES)


def _loss() -> Column:
    return fl.minus_log_sigmoid(F.when(F.col("label") == 1, F.col("x")).otherwise(-F.col("x")))


def _softmax_pairs(coded: DataFrame, model: DataFrame, objective: Objective, model_rows: int, dim: int) -> DataFrame:
    """Pairs with `own`, the score of the context word, and `found`, its at most 1 + n
    targets."""
    rows = scored(targets(coded, objective), model, model_rows, dim)
    own = F.max(F.when(F.col("label") == 1, F.col("x"))).alias("own")
    found = F.collect_list(F.struct("label", "out_code", "x")).alias("found")
    return rows.groupBy(*PLACE, "ctx_pos", "in_code").agg(own, found)


def _repeated_apart(coded: DataFrame, repeated: DataFrame | None, usual, merged) -> DataFrame:
    """`usual` of the sentences of documents that occur once and `merged` of the others:
    the joins below take sentences of one key for one sentence."""
    if repeated is None:
        return usual(coded)
    return usual(coded.join(repeated, "doc_id", "left_anti")).unionByName(merged(coded.join(repeated, "doc_id", "left_semi")))


def pair_loss(
    coded: DataFrame, model: DataFrame, objective: Objective, model_rows: int, dim: int, repeated: DataFrame | None = None
) -> DataFrame:
    """Loss and number of predictions of every (pos, ctx_pos) pair, with its input code.
    `repeated` has the doc_id of documents that occur several times, if there are any."""
    if not ob.fits_in_memory(model_rows, dim, model):
        return _joined_pair_loss(coded, model, objective, model_rows, dim)
    return _repeated_apart(
        coded, repeated,
        lambda c: ob.per_piece(c, ob.held(model), objective, ob.each(ob.pair_losses), ob.PAIR_LOSS),
        lambda c: _joined_pair_loss(c, model, objective, model_rows, dim),
    )


def _joined_pair_loss(coded: DataFrame, model: DataFrame, objective: Objective, model_rows: int, dim: int) -> DataFrame:
    if objective.softmax:
        pairs = _softmax_pairs(coded, model, objective, model_rows, dim)
        loss = fl.log_sum_exp(F.transform("found", lambda t: t["x"])) - F.col("own")
        return pairs.select(*PLACE, "ctx_pos", "in_code", loss.alias("loss"), F.lit(1).cast("bigint").alias("n_pred"))
    rows = scored(targets(coded, objective), model, model_rows, dim)
    return rows.groupBy(*PLACE, "ctx_pos", "in_code").agg(F.sum(_loss()).alias("loss"), F.count("*").alias("n_pred"))


def sentence_loss(coded: DataFrame, model: DataFrame, objective: Objective, model_rows: int, dim: int) -> DataFrame:
    """Loss and number of predictions of every sentence; 0 of one without pairs."""
    if ob.fits_in_memory(model_rows, dim, model):
        parts = ob.per_piece(coded, ob.held(model), objective, ob.each(ob.sentence_losses), ob.SENTENCE_LOSS)
        return parts.groupBy("doc_id", "line").agg(F.sum("loss").alias("loss"), F.sum("n_pred").alias("n_pred"))
    if objective.softmax:
        parts = pair_loss(coded, model, objective, model_rows, dim).select("doc_id", "line", "loss", "n_pred")
    else:
        rows = scored(targets(coded, objective), model, model_rows, dim)
        parts = rows.select("doc_id", "line", _loss().alias("loss"), F.lit(1).cast("bigint").alias("n_pred"))
    none = coded.select("doc_id", "line", F.lit(0.0).alias("loss"), F.lit(0).cast("bigint").alias("n_pred"))
    return parts.unionByName(none).groupBy("doc_id", "line").agg(F.sum("loss").alias("loss"), F.sum("n_pred").alias("n_pred"))


def best_senses(coded: DataFrame, model: DataFrame, objective: Objective, model_rows: int, dim: int) -> DataFrame:
    """(doc_id, line, pos, in_code): the sense of the smallest loss (ties: the lowest) of
    every position of a word with several senses that has neighbours."""
    rows = scored(targets(coded, objective, candidates=True), model, model_rows, dim)
    losses = rows.groupBy(*PLACE, "in_code").agg(F.sum(_loss()).alias("loss"))
    best = F.min(F.struct("loss", "in_code")).alias("best")
    return losses.groupBy(*PLACE).agg(best).select(*PLACE, "best.in_code")


def assign_senses(coded: DataFrame, model: DataFrame, objective: Objective, model_rows: int, dim: int) -> DataFrame:
    """Sentences with the codes of the best senses, and whether that changed something
    (n_adjust), for objectives whose outputs have one sense: then one sweep is the
    fixed point. A word with several senses and no neighbours takes the first."""
    if not objective.one_sense_output or objective.softmax:
        raise ValueError("positions depend on each other: sweep the sentences")
    if ob.fits_in_memory(model_rows, dim, model):
        return ob.per_piece(coded, ob.held(model), objective, ob.each(ob.swept), ob.ASSIGNED)
    best = best_senses(coded, model, objective, model_rows, dim)
    # at most one entry per position of a line, which is one row of the corpus
    lists = best.groupBy("doc_id", "line").agg(F.map_from_entries(F.collect_list(F.struct("pos", "in_code"))).alias("best"))
    met = coded.select("doc_id", "line", "codes").join(lists, ["doc_id", "line"], "left")

    def sense(code: Column, pos: Column) -> Column:
        word = word_of(code)
        first = F.when(sense_number(word, list(objective.cuts)) > 1, pack(word, F.lit(0))).otherwise(code)
        return F.coalesce(F.try_element_at("best", pos), first)

    chosen = met.select("doc_id", "line", F.col("codes").alias("old"), F.transform("codes", sense).alias("codes"))
    return chosen.select("doc_id", "line", "codes", (F.col("codes") != F.col("old")).cast("bigint").alias("n_adjust"))


def softmax_gradient(
    coded: DataFrame, model: DataFrame, objective: Objective, model_rows: int, dim: int, repeated: DataFrame | None = None
) -> DataFrame:
    """Gradient of the softmax loss at fixed parameters: (mat, code, vec). `repeated` as in
    `pair_loss`."""
    if not ob.fits_in_memory(model_rows, dim, model):
        return _joined_gradient(coded, model, objective, model_rows, dim)
    parts = _repeated_apart(
        coded, repeated,
        lambda c: ob.bucket_gradients(c, model, objective, 1, 0).where(F.col("mat") != ob.SUMMARY).select("mat", "code", "vec"),
        lambda c: _joined_gradient(c, model, objective, model_rows, dim),
    )
    return sum_vectors(parts, ["mat", "code"], "vec", dim)


def _joined_gradient(coded: DataFrame, model: DataFrame, objective: Objective, model_rows: int, dim: int) -> DataFrame:
    """Slopes are summed for each (input row, output row) before vectors are joined."""
    pairs = _softmax_pairs(coded, model, objective, model_rows, dim)
    lse = fl.log_sum_exp(F.transform("found", lambda t: t["x"]))
    each = pairs.withColumn("lse", lse).select("in_code", "lse", F.explode("found").alias("t"))
    slope = F.exp(F.col("t.x") - F.col("lse")) - F.col("t.label")
    slopes = each.groupBy("in_code", F.col("t.out_code").alias("out_code")).agg(F.sum(slope).alias("g"))
    row_bytes = 8 * dim + 32
    both = lookup_join(slopes, side(model, INPUT, "in_code", "v"), ["in_code"], model_rows, row_bytes)
    both = lookup_join(both, side(model, OUTPUT, "out_code", "u"), ["out_code"], model_rows, row_bytes)
    parts = F.array(
        F.struct(F.lit(INPUT).alias("mat"), F.col("in_code").alias("code"), fv.scale(F.col("u"), F.col("g")).alias("g")),
        F.struct(F.lit(OUTPUT).alias("mat"), F.col("out_code").alias("code"), fv.scale(F.col("v"), F.col("g")).alias("g")),
    )
    return sum_vectors(both.select(F.explode(parts).alias("p")).select("p.*"), ["mat", "code"], "g", dim)
