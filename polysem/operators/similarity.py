"""Word-pair similarity, similarity in context, correlation with ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.functions import losses as fl
from polysem.functions import text as tx
from polysem.functions import vectors as fv
from polysem.operators.joins import lookup_join

# Fixed values.
CONTEXT_SCALE = 10


def senses_by_word(vectors: DataFrame) -> DataFrame:
    """One row per word with its (sense, vec) list, fewer than the packing
    constant of entries."""
    return vectors.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("sense", "vec"))).alias("senses"))


def _required(senses: Column, word: Column) -> Column:
    message = F.concat(F.lit("not in vocabulary: "), word)
    return F.when(senses.isNull(), F.raise_error(message).cast("array<struct<sense:int,vec:array<float>>>")).otherwise(senses)


def _row_bytes(dim: int) -> int:
    return 8 * dim + 64


def with_senses(pairs: DataFrame, vectors: DataFrame, n_vectors: int, dim: int) -> DataFrame:
    """Both words of every pair with their senses; unknown words are errors.
    `n_vectors`, the rows of `vectors` (or more), bounds what is broadcast."""
    words = senses_by_word(vectors)
    joined = pairs
    for side in ("1", "2"):
        table = words.select(F.col("word").alias("word" + side), F.col("senses").alias("senses" + side))
        joined = lookup_join(joined, table, ["word" + side], n_vectors, _row_bytes(dim), "left")
    return joined.select(
        *pairs.columns,
        _required(F.col("senses1"), F.col("word1")).alias("senses1"),
        _required(F.col("senses2"), F.col("word2")).alias("senses2"),
    )


def _cosines() -> Column:
    return F.flatten(
        F.transform("senses1", lambda a: F.transform("senses2", lambda b: fv.cosine(a["vec"], b["vec"])))
    )


def avg_sim(joined: DataFrame, *keep: str) -> DataFrame:
    """Mean cosine over all sense pairs of two words."""
    value = fv.total(_cosines()) / F.size("senses1") / F.size("senses2")
    return joined.select(*keep, "id", "word1", "word2", value.alias("score"))


def max_sim(joined: DataFrame, *keep: str) -> DataFrame:
    """Largest cosine over all sense pairs, at least -1."""
    value = F.greatest(F.array_max(_cosines()), F.lit(-1.0))
    return joined.select(*keep, "id", "word1", "word2", value.alias("score"))


def pair_similarity_job(pairs: DataFrame, vectors: DataFrame, n_vectors: int, dim: int, *keep: str) -> DataFrame:
    lower = pairs.withColumn("word1", F.lower("word1")).withColumn("word2", F.lower("word2"))
    return avg_sim(with_senses(lower, vectors, n_vectors, dim), *keep)


def disambiguate_in_context(
    occurrences: DataFrame, inputs: DataFrame, outputs: DataFrame, n_vectors: int, dim: int
) -> DataFrame:
    """(id, word, context) -> (id, word, sense): the sense under which the known
    context words are most probable, the lowest on ties. Occurrences of unknown
    words are left out. Context words are taken as they are."""
    base = occurrences.join(inputs.select("word").distinct(), "word", "left_semi")
    # equal context words of one occurrence are counted before the vectors come in
    context = base.select("id", "word", F.explode(tx.tokens(F.col("context"))).alias("ctx"))
    context = context.groupBy("id", "word", "ctx").agg(F.count("*").alias("n"))
    known = outputs.where("sense = 0").select(F.col("word").alias("ctx"), F.col("vec").alias("u"))
    context = lookup_join(context, known, ["ctx"], n_vectors, _row_bytes(dim))
    senses = senses_by_word(inputs)
    scored = lookup_join(context, senses, ["word"], n_vectors, _row_bytes(dim)).select(
        "id", "word", "n", "u", F.explode("senses").alias("s")
    )
    score = -F.col("n") * fl.minus_log_sigmoid(fv.dot(F.col("s.vec"), F.col("u")))
    scored = scored.select("id", "word", F.col("s.sense").alias("sense"), score.alias("score"))
    # every sense starts at probability one, so that no known context gives sense 0
    start = lookup_join(base.select("id", "word"), senses, ["word"], n_vectors, _row_bytes(dim))
    start = start.select("id", "word", F.explode("senses.sense").alias("sense"), F.lit(0.0).alias("score"))
    totals = scored.unionByName(start).groupBy("id", "word", "sense").agg(F.sum("score").alias("score"))
    best = F.max_by("sense", F.struct("score", -F.col("sense")))
    return totals.groupBy("id", "word").agg(best.alias("sense"))


def contextual_similarity(
    pairs: DataFrame, inputs: DataFrame, outputs: DataFrame, n_vectors: int, dim: int
) -> DataFrame:
    """(id, word1, word2, context1, context2) -> (id, word1, sense1, word2,
    sense2, score): 10 x cosine of the senses chosen in context. Pairs with an
    unknown word have no row."""
    sides = []
    for side in ("1", "2"):
        occurrence = pairs.select("id", F.lower("word" + side).alias("word"), F.col("context" + side).alias("context"))
        chosen = disambiguate_in_context(occurrence, inputs, outputs, n_vectors, dim)
        chosen = lookup_join(chosen, inputs.select("word", "sense", "vec"), ["word", "sense"], n_vectors, _row_bytes(dim))
        sides.append(chosen.select("id", *[F.col(c).alias(c + side) for c in ("word", "sense", "vec")]))
    score = CONTEXT_SCALE * fv.cosine(F.col("vec1"), F.col("vec2"))
    joined = sides[0].join(sides[1], "id")
    return joined.select("id", "word1", "sense1", "word2", "sense2", score.alias("score"))


def zip_series(x: DataFrame, y: DataFrame) -> DataFrame:
    """Two series (idx, x) and (idx, y) paired by position."""
    return x.select("idx", "x").join(y.select("idx", "y"), "idx")


def pearson_correlation(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return pairs.agg(F.corr(x, y).alias("r"))
