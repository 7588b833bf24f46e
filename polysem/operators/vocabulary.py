"""Word counts, vocabulary, number of senses per word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.operators.ordering import number_rows, running_share, running_total

# Fixed values.
SMOOTHING_POWER = 0.75
# Rows per window when summing up the word distribution.
SHARE_BLOCK = 65536
# Word and sense are packed into one number with room for so many senses.
MAX_SENSES = 100


def word_count(words: DataFrame) -> DataFrame:
    """Word sentences -> (word, cn); counts are combined before the shuffle."""
    return words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("cn"))


def count_of_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cn").agg(F.count("*").alias("n_words"))


def accumulated_count_histogram(counts: DataFrame) -> DataFrame:
    """For every count c: number of words with count >= c."""
    return running_total(count_of_counts(counts), [F.desc("cn")], "n_words", "n_at_least")


def thresholds_of(spec: str) -> list[int]:
    """'2000_10000': 2 senses from count 2000, 3 from 10000."""
    return [int(t) for t in spec.split("_")] if spec else []


def senses_for_count(cn: Column, thresholds: list[int]) -> Column:
    n = F.lit(1)
    for i, bound in enumerate(thresholds):
        n = F.greatest(n, F.when(cn >= F.lit(bound), F.lit(i + 2)).otherwise(F.lit(1)))
    return n.cast("int")


def vocab_predicate(counts: DataFrame, min_count: int, eval_words: DataFrame | None = None) -> DataFrame:
    """Words that are frequent enough or must stay because they are evaluated."""
    if eval_words is None:
        return counts.where(F.col("cn") >= min_count)
    marked = eval_words.select("word").distinct().withColumn("is_eval", F.lit(True))
    kept = counts.join(marked, "word", "left").where((F.col("cn") >= min_count) | F.col("is_eval"))
    return kept.drop("is_eval")


def build_vocab(
    counts: DataFrame, min_count: int, thresholds: list[int], eval_words: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """(word, cn, word_id, n_senses), ids ranked by count then word. Returns the
    materialised table and its size."""
    if len(thresholds) + 1 > MAX_SENSES:
        raise ValueError(f"{len(thresholds) + 1} senses: a word has at most {MAX_SENSES}")
    kept = vocab_predicate(counts, min_count, eval_words)
    numbered, rows = number_rows(kept, F.desc("cn"), F.asc("word"), column="word_id")
    vocab = numbered.select(
        "word", "cn", F.col("word_id").cast("int"), senses_for_count(F.col("cn"), thresholds).alias("n_senses")
    )
    return vocab, rows


def sense_cuts(vocab: DataFrame, max_senses: int) -> list[int]:
    """For s = 2..max_senses the number of words with at least s senses."""
    if max_senses < 2:
        return []
    sizes = [F.count_if(F.col("n_senses") >= s).alias(f"s{s}") for s in range(2, max_senses + 1)]
    return list(vocab.agg(*sizes).first())


def vocab_totals(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    raw = counts.agg(F.count("*").alias("raw_words"))
    selected = vocab.agg(F.count("*").alias("vocab_words"), F.sum("cn").alias("running_tokens"))
    return selected.select(raw.scalar().alias("raw_words"), "vocab_words", "running_tokens")


def sense_count_histogram(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("n_senses").agg(F.count("*").alias("n_words"))


def parameter_count(vocab: DataFrame, dim: int) -> DataFrame:
    rows = F.sum("n_senses").cast("bigint")
    return vocab.agg(rows.alias("n_rows"), (rows * dim).alias("per_matrix"), (rows * dim * 2).alias("in_total"))


def unigram_distribution(vocab: DataFrame) -> DataFrame:
    """Smoothed word distribution with its running sum `hi`."""
    weight = F.pow(F.col("cn").cast("double"), F.lit(SMOOTHING_POWER))
    return running_share(vocab.select("word_id", "cn"), "word_id", weight, SHARE_BLOCK)
