import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polysem.functions.hashing import counter_draw, series_keys
from polysem.functions.hashing import uniform
from polysem.operators import corpus, ordering, sampling, vocabulary
from polysem.session import cut


@pytest.fixture(scope="module")
def encoded(spark, lines):
    words = corpus.word_sentences(lines)
    vocab, n = vocabulary.build_vocab(vocabulary.word_count(words), 1, [15])
    return cut(corpus.encode(words, vocab, n)), vocab, n


def test_uniform_is_the_documented_hash(spark):
    got = spark.range(3).select(uniform(42, "x", F.col("id")).alias("u")).collect()
    for i, r in enumerate(got):
        assert r["u"] == int(hashlib.md5(f"42|x|{i}".encode()).hexdigest()[:13], 16) / 16**13


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    numbered, n = ordering.number_rows(df, "x")
    assert n == 1000
    assert all(r["x"] == r["row_no"] for r in numbered.collect())


def test_running_share(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("word_id"), (F.col("id") + 1).alias("cn"))
    got = ordering.running_share(df, "word_id", F.col("cn").cast("double"), block=7).orderBy("word_id").toPandas()
    want = np.cumsum(np.arange(1, 101)) / 5050
    assert np.allclose(got["hi"], want, atol=1e-14) and np.allclose(got["p"].sum(), 1.0)


def test_negatives_by_join_equal_those_in_memory(encoded):
    coded, vocab, n = encoded
    unigram = vocabulary.unigram_distribution(vocab)
    kept = sampling.negative_samples(coded, unigram, n, 4, 42)
    a = {
        (r["doc_id"], r["pos"], j, w)
        for r in kept.select("doc_id", F.posexplode("neg_ids").alias("pos", "w")).collect()
        for j, w in enumerate(r["w"])
    }
    rows = sampling.negatives_by_join(coded, unigram, n, 4, 42, "neg").collect()
    assert a == {(r["doc_id"], r["pos"], r["j"], r["neg_id"]) for r in rows}


def test_negatives_differ_from_the_word_and_follow_the_distribution(spark):
    counts = np.array([50, 30, 15, 5])
    vocab = spark.createDataFrame([(i, int(c)) for i, c in enumerate(counts)], "word_id int, cn bigint")
    unigram = vocabulary.unigram_distribution(vocab)
    sents = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("line"), F.array_repeat(F.lit(1), 25).alias("ids")
    )
    drawn = sampling.negative_samples(sents, unigram, 4, 5, 42)
    got = drawn.select(F.explode(F.flatten("neg_ids")).alias("w")).groupBy("w").count().toPandas().set_index("w")["count"]
    assert 1 not in got.index and got.sum() == 400 * 25 * 5
    p = counts**0.75
    p[1] = 0
    assert np.abs(got.reindex(range(4), fill_value=0) / got.sum() - p / p.sum()).max() < 6e-3


def test_a_million_draws_follow_the_distribution(spark):
    counts = np.array([40, 25, 20, 10, 5])
    vocab = spark.createDataFrame([(i, int(c)) for i, c in enumerate(counts)], "word_id int, cn bigint")
    unigram = vocabulary.unigram_distribution(vocab)
    sents = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("line"), F.array_repeat(F.lit(2), 10).alias("ids"))
    drawn = sampling.negative_samples(sents, unigram, 5, 10, 7)
    got = drawn.select(F.explode(F.flatten("neg_ids")).alias("w")).groupBy("w").count().toPandas().set_index("w")["count"]
    assert got.sum() == 1_000_000
    p = counts**0.75
    p[2] = 0
    assert np.abs(got.reindex(range(5), fill_value=0) / got.sum() - p / p.sum()).max() < 2e-3


def test_more_senses_than_codes_is_an_error(encoded):
    _, vocab, _ = encoded
    with pytest.raises(ValueError, match="senses"):
        vocabulary.build_vocab(vocab.select("word", "cn"), 1, list(range(100)))


def test_one_word_has_no_negatives(encoded):
    coded, _, _ = encoded
    assert sampling.negative_samples(coded, None, 1, 5, 42).select(F.flatten("neg_ids").alias("f")).first()["f"] == []


def test_draws_do_not_depend_on_partitioning(encoded):
    coded, vocab, n = encoded
    unigram = vocabulary.unigram_distribution(vocab)
    def run(parts):
        drawn = sampling.negative_samples(coded.repartition(parts), unigram, n, 3, 42)
        return sorted((r["doc_id"], str(r["neg_ids"])) for r in drawn.collect())
    assert run(1) == run(5)


def test_splits(spark, lines):
    train, held = sampling.split_train_validation(lines, 0.5, 1)
    assert train.count() + held.count() == lines.count() and held.count() > 0
    assert sampling.validation_ratio(10_000_000, 0.1, 200_000) == 0.02


def test_categorical_sample_follows_weights(spark):
    rows = spark.range(2000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    weights = rows.select("id", "k", (F.col("k") * 2 + 1).alias("w"))
    got = sampling.categorical_sample(weights, "id", "k", "w", uniform(1, F.col("id")))
    share = got.groupBy("k").count().toPandas().set_index("k")["count"] / 2000
    assert np.abs(share.sort_index().to_numpy() - np.array([1, 3, 5]) / 9).max() < 0.04


def test_draws_by_counter_are_even_and_uncorrelated(spark):
    """Equal on columns and arrays; 16 even cells; neighbours in place, draw and line do not follow each other."""
    keys = spark.range(200).select("id", *series_keys(42, "neg", F.col("id"), F.lit(0))).toDF("id", "a", "b")
    places = keys.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(49)).cast("array<bigint>")))
    rows = places.withColumn("u", counter_draw(F.col("a"), F.col("b"), F.col("p"), F.lit(3).cast("bigint"))).toPandas()
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    assert (rows["u"].to_numpy() == counter_draw(a, b, rows["p"].to_numpy(), 3)).all()
    first, second = (keys.toPandas()[c].to_numpy()[:, None, None] for c in "ab")
    u = counter_draw(first, second, np.arange(80)[None, :, None], np.arange(10)[None, None, :])
    assert u.min() >= 0 and u.max() < 1
    cells = np.bincount((u.ravel() * 16).astype(int), minlength=16) / u.size
    assert np.abs(cells - 1 / 16).max() < 0.002
    for x, y in ((u[1:], u[:-1]), (u[:, 1:], u[:, :-1]), (u[:, :, 1:], u[:, :, :-1]), (u[:, 2:], u[:, :-2])):
        assert abs(np.corrcoef(x.ravel(), y.ravel())[0, 1]) < 0.01
    pairs = np.bincount((u[:, :, 1:].ravel() * 8).astype(int) * 8 + (u[:, :, :-1].ravel() * 8).astype(int), minlength=64) / u[:, :, 1:].size
    assert np.abs(pairs - 1 / 64).max() < 0.002


def test_words_of_cells_are_those_of_a_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 1000):
        weight = 1.0 / np.arange(1, n + 1) ** 0.75
        hi = np.cumsum(weight) / weight.sum()
        borders = sampling.word_cells(hi)
        near = np.concatenate([hi, np.nextafter(hi, 0), np.nextafter(hi, 2), np.arange(len(borders)) / (len(borders) - 1), rng.random(5000)])
        near = near[(near >= 0) & (near <= 1)]
        assert (sampling.words_at(hi, borders, near) == np.searchsorted(hi, near, side="right")).all()
        assert (np.diff(borders) == 0).mean() > 0.4
