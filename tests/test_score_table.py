import numpy as np
import pytest
from pyspark.sql import functions as F

from polysem import session
from polysem.operators import corpus, model, objective, sampling, score_table, vocabulary
from polysem.operators import kernels as K
from polysem.session import cut

DIM = 6


@pytest.fixture(scope="module")
def setting(spark, lines):
    """Nine sentences of ten tokens, one of one token, one that repeats a pair often."""
    more = spark.createDataFrame([(100, 0, "a"), (101, 0, "a b " * 60), (102, 0, "a b c")], "doc_id bigint, line int, text string")
    words = corpus.word_sentences(lines.unionByName(more))
    vocab, n = vocabulary.build_vocab(vocabulary.word_count(words), 1, [15, 25])
    cuts = vocabulary.sense_cuts(vocab, 3)
    coded = corpus.random_senses(corpus.encode(words, vocab, n), cuts, 42)
    noisy = cut(sampling.with_negatives(coded, vocabulary.unigram_distribution(vocab), n, 2, cuts, True, 42))
    params = cut(model.init_random(vocab, DIM, 42, True, 2.0 * DIM, 2.0 * DIM))
    return noisy, params, tuple(cuts)


@pytest.fixture(params=["broadcast", "join"])
def by(request, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(session, "BROADCAST_LIMIT", 0)


@pytest.mark.parametrize("softmax", [False, True])
@pytest.mark.parametrize("window", [1, 3])
def test_losses_equal_the_kernel(setting, by, softmax, window):
    noisy, params, cuts = setting
    o = K.Objective(window, 2, cuts, softmax=softmax)
    key = ["doc_id", "line", "pos", "ctx_pos"]
    got = score_table.pair_loss(noisy, params, o, 100, DIM).orderBy(*key).toPandas()
    want = objective.pair_loss(noisy, params, o, 3, 42).orderBy(*key).toPandas()
    assert got[key].equals(want[key].astype(got[key].dtypes)) and np.allclose(got["loss"], want["loss"])
    assert (got["n_pred"] == want["n_pred"]).all()
    codes = {(r["doc_id"], r["line"]): r["codes"] for r in noisy.collect()}
    assert all(codes[d, n][p] == c for d, n, p, c in got[["doc_id", "line", "pos", "in_code"]].itertuples(index=False))
    sums = score_table.sentence_loss(noisy, params, o, 100, DIM).orderBy("doc_id", "line").toPandas()
    plain = objective.sentence_loss(noisy, params, o, 3, 42).orderBy("doc_id", "line").toPandas()
    assert np.allclose(sums["loss"], plain["loss"]) and (sums["n_pred"] == plain["n_pred"]).all() and len(sums) == 12


def test_senses_equal_the_kernel(setting, by):
    noisy, params, cuts = setting
    o = K.Objective(2, 2, cuts)
    read = lambda df: {(r["doc_id"], r["line"]): (r["codes"], r["n_adjust"]) for r in df.collect()}
    got = read(score_table.assign_senses(noisy, params, o, 100, DIM))
    assert got == read(objective.assign_senses(noisy, params, o, 3, 42)) and len(got) == 12
    # chosen senses are a fixed point
    negs = noisy.select("doc_id", "line", "negs")
    chosen = cut(score_table.assign_senses(noisy, params, o, 100, DIM).select("doc_id", "line", "codes").join(negs, ["doc_id", "line"]))
    assert score_table.assign_senses(chosen, params, o, 100, DIM).agg(F.max("n_adjust")).first()[0] == 0


def test_softmax_gradient_equals_the_kernel(setting, by):
    noisy, params, cuts = setting
    o = K.Objective(2, 2, cuts, softmax=True)
    got = {(r["mat"], r["code"]): r["vec"] for r in score_table.softmax_gradient(noisy, params, o, 100, DIM).collect()}
    want = {(r["mat"], r["code"]): r["vec"] for r in objective.softmax_gradient(noisy, params, o, 3, 42, DIM).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_each_pair_is_scored_once(setting):
    noisy, params, cuts = setting
    rows = score_table.targets(noisy, K.Objective(2, 2, cuts))
    table = score_table.scores(rows, params, 100, DIM)
    assert table.count() == table.select("in_code", "out_code").distinct().count() == rows.select("in_code", "out_code").distinct().count()
    assert rows.count() > 5 * table.count()


def test_dependent_positions_are_refused(setting):
    noisy, params, cuts = setting
    for o in (K.Objective(2, 2, cuts, one_sense_output=False), K.Objective(2, 2, cuts, softmax=True)):
        with pytest.raises(ValueError, match="sweep"):
            score_table.assign_senses(noisy, params, o, 100, DIM)


def test_no_sentences(setting):
    noisy, params, cuts = setting
    o = K.Objective(2, 2, cuts)
    for f in (score_table.pair_loss, score_table.sentence_loss, score_table.assign_senses):
        assert f(noisy.limit(0), params, o, 100, DIM).count() == 0
