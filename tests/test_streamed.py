"""Sentences that stream past a model in memory, and buckets trained side by side."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polysem import session
from polysem.operators import corpus, model, objective, sampling, score_table, vocabulary
from polysem.operators import kernels as K
from polysem.session import cut

DIM = 4


@pytest.fixture(scope="module")
def setting(spark, lines):
    more = spark.createDataFrame([(100, 0, "a"), (101, 0, "a b " * 40), (102, 3, "e d c")], "doc_id bigint, line int, text string")
    words = corpus.word_sentences(lines.unionByName(more))
    vocab, n = vocabulary.build_vocab(vocabulary.word_count(words), 1, [15, 25])
    cuts = vocabulary.sense_cuts(vocab, 3)
    coded = corpus.random_senses(corpus.encode(words, vocab, n), cuts, 42)
    noisy = cut(sampling.with_negatives(coded, vocabulary.unigram_distribution(vocab), n, 2, cuts, True, 42))
    params = cut(model.init_random(vocab, DIM, 42, True, 2.0 * DIM, 2.0 * DIM))
    return noisy, params, tuple(cuts)


def test_nothing_is_shuffled_for_a_token(setting):
    noisy, params, cuts = setting
    for df in (
        score_table.assign_senses(noisy, params, K.Objective(2, 2, cuts), 100, DIM),
        score_table.pair_loss(noisy, params, K.Objective(2, 2, cuts, softmax=True), 100, DIM),
        objective.bucket_gradients(noisy, params, K.Objective(2, 2, cuts), 5, 42),
        objective.sentence_loss(noisy, params, K.Objective(2, 2, cuts), 5, 42),
    ):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_documents_that_repeat_are_merged_as_by_joins(setting, spark):
    noisy, params, cuts = setting
    twice = noisy.unionAll(noisy.where("doc_id in (2, 101)"))
    repeated = spark.createDataFrame([(2,), (101,)], "doc_id bigint")
    key = ["doc_id", "line", "pos", "ctx_pos"]
    for softmax in (False, True):
        o = K.Objective(2, 2, cuts, softmax=softmax)
        got = score_table.pair_loss(twice, params, o, 100, DIM, repeated).orderBy(*key).toPandas()
        want = score_table._joined_pair_loss(twice, params, o, 100, DIM).orderBy(*key).toPandas()
        assert len(got) == len(want) and np.allclose(got["loss"], want["loss"]) and (got["n_pred"] == want["n_pred"]).all()


def test_pieces_hold_every_sentence_once():
    sizes = [3, 1, 9, 2, 2, 0, 7]
    table = pa.table({"codes": [list(range(n)) for n in sizes], "k": range(len(sizes))})
    for tokens in (1, 4, 5, 100):
        found = list(corpus.pieces(table.to_batches(max_chunksize=3), "codes", tokens))
        assert [k for t in found for k in t["k"].to_pylist()] == list(range(len(sizes)))
        assert all(t.num_rows == 1 or sum(map(len, t["codes"].to_pylist())) <= tokens for t in found)


@pytest.mark.parametrize("softmax", [False, True])
@pytest.mark.parametrize("room", [1, 1 << 28])
def test_buckets_side_by_side_equal_one_after_the_other(setting, monkeypatch, softmax, room):
    """Also in blocks of few steps, and where a pair has a row twice."""
    monkeypatch.setattr(K, "SIDE_BYTES", room)
    monkeypatch.setattr(K, "STEPS", 7)
    noisy, params, cuts = setting
    o = K.Objective(2, 2, cuts, softmax=softmax)
    table = objective.with_codes(params).toArrow()
    start = [K.rows_of(table, m) for m in (objective.INPUT, objective.OUTPUT)]
    rows = noisy.withColumn("bucket", objective.bucket_of(5, 42)).toArrow()
    loss, n, *change = K.sgd_of_buckets(K.Bucket(rows, o), *start, 0.1)
    want_loss, want_n, want = 0.0, 0, [np.zeros_like(r.vectors) for r in start]
    for b in range(5):
        part = rows.filter(pa.compute.equal(rows["bucket"], b))
        mats = [K.Rows(r.codes, r.vectors.copy()) for r in start]
        more = K.sgd_sequential(K.Bucket(part, o), *mats, 0.1)
        want_loss, want_n = want_loss + more[0], want_n + more[1]
        want = [w + m.vectors - r.vectors for w, m, r in zip(want, mats, start, strict=True)]
    assert n == want_n and np.isclose(loss, want_loss)
    assert all(np.allclose(c, w) for c, w in zip(change, want, strict=True))


@pytest.mark.parametrize("limit", [0, session.BROADCAST_LIMIT])
def test_buckets_of_a_group_return_one_sum(setting, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_LIMIT", limit)
    noisy, params, cuts = setting
    updates = cut(objective.sgd_epoch(noisy, params, K.Objective(2, 2, cuts), 40, 42, 0.1))
    groups = objective.group_count(40, noisy.sparkSession.sparkContext.defaultParallelism)
    assert updates.where(F.col("mat") == objective.SUMMARY).count() <= groups < 40
    assert updates.agg(F.sum("n_tokens")).first()[0] == noisy.agg(F.sum(F.size("codes"))).first()[0]


def test_text_and_windows_need_no_shuffle(setting, lines, spark):
    noisy, _, _ = setting
    words = corpus.word_sentences(lines)
    vocab, n = vocabulary.build_vocab(vocabulary.word_count(words), 1, [15, 25])
    coded = cut(corpus.random_senses(corpus.encode(words, vocab, n), vocabulary.sense_cuts(vocab, 3), 42))
    plain = corpus.tagged(coded, vocab, n)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    read = lambda df: sorted(map(tuple, df.select("doc_id", "line", "text").collect()))
    assert read(plain) == read(corpus._tagged_by_join(coded, vocab, n))
    twice, repeated = coded.unionAll(coded.where("doc_id = 3")), spark.createDataFrame([(3,)], "doc_id bigint")
    assert read(corpus.tagged(twice, vocab, n, repeated)) == read(corpus._tagged_by_join(twice, vocab, n))


def test_a_model_of_floats_is_held_as_floats(setting, monkeypatch):
    noisy, params, cuts = setting
    rows = objective.held(params).value
    assert {r.vectors.dtype for r in rows} == {np.dtype(np.float32)} and all(r.first is not None for r in rows)
    n = params.count()
    monkeypatch.setattr(session, "BROADCAST_LIMIT", n * (4 * DIM + 12))
    o = K.Objective(2, 2, cuts)
    assert "Exchange" not in score_table.assign_senses(noisy, params, o, n, DIM)._jdf.queryExecution().executedPlan().toString()
    wide = params.withColumn("vec", F.col("vec").cast("array<double>"))
    assert objective.fits_in_memory(n, DIM, params) and not objective.fits_in_memory(n, DIM, wide)
    got = {(r["mat"], r["code"]): r["vec"] for r in objective.sgns_gradient(noisy, params, o, n, DIM).collect()}
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 1 << 28)
    want = {(r["mat"], r["code"]): r["vec"] for r in objective.sgns_gradient(noisy, wide, o, n, DIM).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_rows_are_found_with_and_without_gaps():
    for codes in ([0, 1, 100, 200, 201, 202], [0, 100, 102, 300], [100, 101]):
        rows = K.Rows(np.array(codes[::-1]), np.arange(len(codes))[:, None])
        assert rows.index(np.array([codes, codes])).tolist() == [list(range(len(codes)))] * 2
        for wrong in {-1, 2, 99, 101, 203, 300, 10_000} - set(codes):
            with pytest.raises(ValueError, match=str(wrong)):
                rows.index(np.array([codes[0], wrong]))


def test_words_are_looked_up_without_a_shuffle_or_a_table_of_all(spark, monkeypatch):
    words = spark.createDataFrame([(1, 0, ["a", "zz", "b", "a"]), (2, 0, []), (3, 0, ["zz"]), (4, 1, ["c"])], "doc_id bigint, line int, words array<string>")
    vocab = spark.createDataFrame([("c", 0), ("a", 1), ("b", 2), ("unused", 3)], "word string, word_id int")
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 4 * 100)
    encoded = corpus.encode(words, vocab, 4)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in encoded.selectExpr("doc_id", "concat_ws(' ', ids)").collect()} == {(1, "1 2 1"), (4, "0")}


def test_gradients_leave_in_no_more_parts_than_tasks_run(setting, spark):
    noisy, params, cuts = setting
    o, cores = K.Objective(2, 2, cuts), spark.sparkContext.defaultParallelism
    many = noisy.repartition(5 * cores, "doc_id", "line")
    parts = objective.bucket_gradients(many, params, o, 5, 42)
    assert parts.where(F.col("mat") == objective.SUMMARY).count() <= cores
    few = objective.bucket_gradients(noisy.coalesce(1), params, o, 5, 42)
    total = lambda df: df.groupBy("mat", "code").agg(F.sum("loss"), F.sum(F.get("vec", F.lit(0)))).orderBy("mat", "code").toPandas()
    assert np.allclose(total(parts).fillna(0.0), total(few).fillna(0.0))


def test_a_task_adds_up_the_changes_of_all_its_groups(setting, spark, monkeypatch):
    """More groups than tasks run at a time: updates do not grow with the groups."""
    noisy, params, cuts = setting
    o, cores = K.Objective(2, 2, cuts), spark.sparkContext.defaultParallelism
    total = lambda df: df.groupBy("mat", "code").agg(F.sum("loss"), F.sum("n_pred"), F.sum("n_tokens"), F.sum(F.get("vec", F.lit(0)))).orderBy("mat", "code").toPandas()
    want = total(objective.sgd_epoch(noisy, params, o, 40, 42, 0.1))
    monkeypatch.setattr(objective, "GROUP", 2)
    monkeypatch.setattr(objective, "LEAST_GROUP", 2)
    updates = cut(objective.sgd_epoch(noisy.repartition(3, "doc_id"), params, o, 40, 42, 0.1))
    assert objective.group_count(40, cores) == 20
    assert updates.where(F.col("mat") == objective.SUMMARY).count() <= cores
    assert updates.where("mat >= 0").groupBy("mat", "code").count().agg(F.max("count")).first()[0] <= cores
    assert np.allclose(total(updates).fillna(0.0), want.fillna(0.0))


def test_groups_that_cross_batches_are_whole():
    group = [3, 3, 3, 1, 1, 7, 7, 7, 7]
    batches = pa.table({"group": group, "k": range(9)}).to_batches(max_chunksize=2)
    found = [(t["group"].to_pylist(), t["k"].to_pylist()) for t in objective._groups([pa.RecordBatch.from_pydict({"group": pa.array([], pa.int64()), "k": pa.array([], pa.int64())}), *batches])]
    assert found == [([3] * 3, [0, 1, 2]), ([1, 1], [3, 4]), ([7] * 4, [5, 6, 7, 8])]
