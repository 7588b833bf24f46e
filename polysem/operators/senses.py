"""Sense probabilities and re-initialisation of senses that win no tokens.

All groups here are the senses of one word: fewer than the packing constant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.functions.hashing import uniform
from polysem.operators.model import SENSE_NOISE
from polysem.operators.pairs import expand_senses

# Fixed values.
PROB_DECAY = 0.99


def uniform_sense_probs(vocab: DataFrame) -> DataFrame:
    share = F.lit(1.0) / F.col("n_senses")
    return expand_senses(vocab.select("word_id", "n_senses")).select("word_id", "sense", share.alias("prob"))


def update_sense_probs(probs: DataFrame, counts: DataFrame, decay: float = PROB_DECAY) -> DataFrame:
    """Move the probabilities of every word seen n times towards its observed
    shares, the old ones keeping the weight decay^n."""
    word_totals = counts.groupBy("word_id").agg(F.sum("n").alias("n_word"))
    joined = probs.join(counts, ["word_id", "sense"], "left").join(word_totals, "word_id", "left")
    keep = F.exp(F.col("n_word") * F.log(F.lit(decay)))
    share = F.coalesce("n", F.lit(0)) / F.col("n_word")
    new = F.when(F.col("n_word") > 0, F.col("prob") * keep + share * (1 - keep)).otherwise(F.col("prob"))
    return joined.select("word_id", "sense", new.alias("prob"))


def _fold(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + s[field])


def reset_plan(probs: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Renormalised probabilities and, for every sense below the threshold, the
    sense it is to copy: drawn in proportion among the senses not below it.
    Without such a sense it keeps its vector (donor = own sense)."""
    word = probs.groupBy("word_id").agg(F.sort_array(F.collect_list(F.struct("sense", "prob"))).alias("all"))
    total = _fold(F.col("all"), "prob")
    word = word.withColumn("_t", total).withColumn(
        "all", F.transform("all", lambda s: F.struct(s["sense"].alias("sense"), (s["prob"] / F.col("_t")).alias("prob")))
    )
    word = word.withColumn("donors", F.filter("all", lambda s: s["prob"] >= threshold))
    word = word.withColumn("mass", _fold(F.col("donors"), "prob"))
    rows = word.select("word_id", "donors", "mass", F.size("all").alias("n_senses"), F.explode("all").alias("s"))
    rare = (F.col("n_senses") > 1) & (F.col("s.prob") < threshold) & (F.size("donors") > 0)
    aim = uniform(seed, "donor", F.col("word_id"), F.col("s.sense")) * F.col("mass")
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(-1).alias("hit"))

    def step(acc: Column, s: Column) -> Column:
        cum = acc["cum"] + s["prob"]
        hit = F.when((acc["hit"] < 0) & (cum > aim), s["sense"]).otherwise(acc["hit"])
        return F.struct(cum.alias("cum"), hit.alias("hit"))

    drawn = F.aggregate("donors", start, step, lambda acc: acc["hit"])
    # only rounding can leave the aim beyond the last donor
    drawn = F.when(drawn < 0, F.element_at("donors", -1)["sense"]).otherwise(drawn)
    return rows.select(
        "word_id", F.col("s.sense").alias("sense"), F.col("s.prob").alias("prob"), "n_senses",
        F.when(rare, drawn).otherwise(F.col("s.sense")).alias("donor"), rare.alias("is_reset"),
    )


def reset_rare_senses(
    model: DataFrame, plan: DataFrame, dim: int, seed: int, one_sense_output: bool = True, noise: float = SENSE_NOISE
) -> DataFrame:
    """Give every rare sense the vector of its donor plus a little noise."""
    resets = plan.where("is_reset").select("word_id", "sense", "donor")
    donors = model.select("mat", "word_id", F.col("sense").alias("donor"), F.col("vec").alias("donor_vec"))
    if one_sense_output:
        donors = donors.where("mat = 0")
    copies = resets.join(donors, ["word_id", "donor"])
    shaken = F.transform(
        "donor_vec",
        lambda x, k: (
            x.cast("double")
            + (uniform(seed, "reset", F.col("mat"), F.col("word_id"), F.col("sense"), k) - 0.5) * F.lit(noise / dim)
        ).cast("float"),
    )
    copies = copies.select("mat", "word_id", "sense", shaken.alias("new_vec"))
    joined = model.join(copies, ["mat", "word_id", "sense"], "left")
    return joined.select("mat", "word_id", "sense", F.coalesce("new_vec", "vec").alias("vec"))


def reset_summary(plan: DataFrame) -> DataFrame:
    """Senses of multi-sense words and how many of them were reset."""
    return plan.agg(
        F.count_if(F.col("n_senses") > 1).alias("n_multi"), F.count_if("is_reset").alias("n_reset")
    )
