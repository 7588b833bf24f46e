"""Parameter tables: (mat, word_id, sense, vec) with mat 0 for input and 1 for
output vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.functions import vectors as fv
from polysem.functions.hashing import uniform
from polysem.operators.corpus import sense_of, word_of
from polysem.operators.objective import INPUT, OUTPUT, SUMMARY, sum_vectors
from polysem.operators.pairs import expand_senses

# Fixed values.
INPUT_SCALE = 1.0
OUTPUT_SCALE = 0.5
SENSE_NOISE = 0.01
NORM_MARGIN = 0.99


def _floats(v: Column) -> Column:
    return v.cast("array<float>")


def model_rows(vocab: DataFrame, one_sense_output: bool) -> DataFrame:
    """The keys of a model. Output rows of further senses are never trained if
    outputs have one sense, so they are not kept."""
    inputs = expand_senses(vocab.select("word_id", "n_senses")).select(F.lit(INPUT).alias("mat"), "word_id", "sense")
    if one_sense_output:
        outputs = vocab.select(F.lit(OUTPUT).alias("mat"), "word_id", F.lit(0).alias("sense"))
    else:
        outputs = inputs.select(F.lit(OUTPUT).alias("mat"), "word_id", "sense")
    return inputs.unionByName(outputs)


def _noise(purpose: str, seed: int, k: Column, *keys: Column) -> Column:
    return uniform(seed, purpose, *keys, k) - F.lit(0.5)


def init_random(
    vocab: DataFrame, dim: int, seed: int, one_sense_output: bool = True,
    input_scale: float = INPUT_SCALE, output_scale: float = OUTPUT_SCALE,
) -> DataFrame:
    """Entries uniform in +-scale / (2 dim)."""
    scale = F.when(F.col("mat") == INPUT, F.lit(input_scale / dim)).otherwise(F.lit(output_scale / dim))
    keys = [F.col("mat"), F.col("word_id"), F.col("sense")]
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: _noise("init", seed, k, *keys) * scale)
    return model_rows(vocab, one_sense_output).select("mat", "word_id", "sense", _floats(vec).alias("vec"))


def init_zero(vocab: DataFrame, dim: int, one_sense_output: bool = True) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return model_rows(vocab, one_sense_output).select("mat", "word_id", "sense", zeros.alias("vec"))


def init_from_vectors(
    vocab: DataFrame, stored: DataFrame, mat: int, dim: int, seed: int, noise: float = SENSE_NOISE,
    one_sense: bool = False,
) -> DataFrame:
    """Warm start of one matrix from stored vectors (line_no, word, sense, vec).
    The first line of a word gives all its senses, with a little noise; later
    lines set their own sense exactly; words not stored start at zero."""
    words = vocab.select("word", "word_id", (F.lit(1) if one_sense else F.col("n_senses")).alias("n_senses"))
    first = stored.groupBy("word").agg(
        F.min_by("vec", "line_no").alias("first_vec"), F.min("line_no").alias("first_line")
    )
    own = stored.join(first.select("word", "first_line"), "word").where("line_no > first_line")
    own = own.groupBy("word", "sense").agg(F.max_by("vec", "line_no").alias("own_vec"))
    keyed = expand_senses(words).join(first.select("word", "first_vec"), "word", "left")
    keyed = keyed.join(own, ["word", "sense"], "left")
    shaken = F.transform(
        "first_vec",
        lambda x, k: x.cast("double")
        + _noise(f"warm{mat}", seed, k, F.col("word_id"), F.col("sense")) * F.lit(noise / dim),
    )
    zeros = F.array_repeat(F.lit(0.0), dim)
    vec = F.coalesce(F.col("own_vec").cast("array<double>"), shaken, zeros)
    return keyed.select(F.lit(mat).alias("mat"), "word_id", "sense", _floats(vec).alias("vec"))


def check_stored(vocab: DataFrame, stored: DataFrame, dim: int) -> None:
    """Stored vectors must be of known words and senses and of the right width."""
    joined = stored.join(vocab.select("word", "n_senses"), "word", "left")
    bad = joined.where(
        F.col("n_senses").isNull() | (F.col("sense") >= F.col("n_senses")) | (F.size("vec") != dim)
    ).select("word", "sense").take(1)
    if bad:
        raise ValueError(f"stored vector does not fit the vocabulary: {bad[0]['word']} {bad[0]['sense']}")


def average_parameters(model: DataFrame, updates: DataFrame, n_parts: int, dim: int) -> DataFrame:
    """Mean of the models of all parts, given what each part changed: a part
    that did not touch a row counts with the old row."""
    changes = sum_vectors(updates.where(F.col("mat") != SUMMARY), ["mat", "code"], "vec", dim, "change")
    changes = changes.select("mat", word_of(F.col("code")).alias("word_id"), sense_of(F.col("code")).alias("sense"), "change")
    moved = F.zip_with("vec", "change", lambda x, c: x.cast("double") + c / F.lit(float(n_parts)))
    vec = F.when(F.col("change").isNull(), F.col("vec").cast("array<double>")).otherwise(moved)
    return model.join(changes, ["mat", "word_id", "sense"], "left").select("mat", "word_id", "sense", vec.alias("vec"))


def weight_decay(model: DataFrame, decay: float, share: float) -> DataFrame:
    """Shrink by decay x (share of the training sentences just seen)."""
    if not 0.0 <= decay < 0.5:
        raise ValueError(f"weight decay {decay} is not in [0, 0.5)")
    return model.withColumn("vec", fv.scale(F.col("vec"), 1.0 - decay * share))


def limit_norm(model: DataFrame, max_squared: float) -> DataFrame:
    """Scale vectors whose squared length exceeds the bound to just below it."""
    square = fv.squared_norm(F.col("vec"))
    marked = model.withColumn("limited", square > F.lit(max_squared))
    factor = F.when(F.col("limited"), F.sqrt(F.lit(NORM_MARGIN * max_squared) / square)).otherwise(F.lit(1.0))
    return marked.withColumn("vec", fv.scale(F.col("vec"), factor))


def as_floats(model: DataFrame) -> DataFrame:
    return model.select("mat", "word_id", "sense", _floats(F.col("vec")).alias("vec"))
