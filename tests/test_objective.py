"""Kernels against plain loops and finite differences, relational jobs against
kernels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polysem.operators import corpus, kernels as K, model, objective, sampling, vocabulary
from polysem.operators.corpus import ENCODE
from polysem.session import cut

DIM = 4


def make_bucket(o: K.Objective, n_words=6, lengths=(7, 1, 12), seed=0):
    rng = np.random.default_rng(seed)
    n = sum(lengths)
    words = rng.integers(0, n_words, n)
    senses = [rng.integers(0, k) for k in o.sense_numbers(words)]
    codes = words * ENCODE + np.array(senses)
    negs = rng.integers(0, n_words, (n, o.n_neg)) * ENCODE
    starts = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    inner = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * o.n_neg, pa.int32()), pa.array(negs.ravel()))
    table = pa.table({
        "doc_id": np.arange(len(lengths)),
        "line": np.zeros(len(lengths), np.int32),
        "codes": pa.ListArray.from_arrays(starts, pa.array(codes)),
        "negs": pa.ListArray.from_arrays(starts, inner),
    })
    return K.Bucket(table, o)


def make_rows(o: K.Objective, n_words=6, seed=1, output=False):
    rng = np.random.default_rng(seed)
    words = np.arange(n_words)
    codes = [w * ENCODE + s for w, k in zip(words, o.sense_numbers(words)) for s in range(k)]
    if output and o.one_sense_output:
        codes = list(words * ENCODE)
    return K.Rows(np.array(codes), rng.normal(size=(len(codes), DIM)))


def sigma(x):
    return 1 / (1 + np.exp(-x))


def plain_pairs(b: K.Bucket):
    w = b.objective.window
    for s in range(len(b.starts) - 1):
        a, e = b.starts[s], b.starts[s + 1]
        for i in range(a, e):
            for j in range(i - w, i + w + 1):
                if j != i and a <= j < e:
                    yield i, j


def plain_loss(b, V, U, in_code, j):
    v = V[in_code]
    out = b.codes[j] // ENCODE * ENCODE if b.objective.one_sense_output else b.codes[j]
    x, y = v @ U[out], np.array([v @ U[c] for c in b.negs[j]])
    if b.objective.softmax:
        return -np.log(np.exp(x) / (np.exp(x) + np.exp(y).sum()))
    return -np.log(sigma(x)) - np.log(1 - sigma(y)).sum()


def as_dict(rows: K.Rows):
    return {c: v.copy() for c, v in zip(rows.codes, rows.vectors)}


OBJECTIVES = [
    K.Objective(2, 3, (4, 2), one_sense_output=one, softmax=soft) for one in (True, False) for soft in (True, False)
]


@pytest.mark.parametrize("o", OBJECTIVES)
def test_losses_equal_plain_loop(o):
    b, V, U = make_bucket(o), make_rows(o), make_rows(o, seed=2, output=True)
    loss, count = K.position_losses(b, V, U, np.arange(b.n), b.codes)
    want, n = np.zeros(b.n), np.zeros(b.n)
    v, u = as_dict(V), as_dict(U)
    for i, j in plain_pairs(b):
        want[i] += plain_loss(b, v, u, b.codes[i], j)
        n[i] += 1 if o.softmax else 1 + o.n_neg
    assert np.allclose(loss, want) and np.array_equal(count, n)


@pytest.mark.parametrize("o", OBJECTIVES)
def test_gradient_equals_finite_differences(o):
    b, V, U = make_bucket(o), make_rows(o), make_rows(o, seed=2, output=True)
    loss, _, d_in, d_out = K.gradients(b, V, U)
    eps = 1e-6
    for rows, grad in ((V, d_in), (U, d_out)):
        for r in range(len(rows.codes)):
            for k in range(DIM):
                keep = rows.vectors[r, k]
                values = []
                for step in (eps, -eps):
                    rows.vectors[r, k] = keep + step
                    values.append(K.gradients(b, V, U)[0])
                rows.vectors[r, k] = keep
                assert abs((values[0] - values[1]) / (2 * eps) - grad[r, k]) < 1e-4
    # a small step against the gradient lowers the loss
    V.vectors -= 1e-3 * d_in
    U.vectors -= 1e-3 * d_out
    assert K.gradients(b, V, U)[0] < loss


@pytest.mark.parametrize("o", OBJECTIVES)
def test_sweeps_equal_plain_loop(o):
    b, V, U = make_bucket(o, lengths=(9, 2, 14, 1, 5)), make_rows(o), make_rows(o, seed=2, output=True)
    codes, sweeps = K.sweep_senses(b, V, U)
    v, u = as_dict(V), as_dict(U)
    plain = make_bucket(o, lengths=(9, 2, 14, 1, 5))
    n_senses = o.sense_numbers(plain.codes // ENCODE)
    for s in range(5):
        a, e = plain.starts[s], plain.starts[s + 1]
        n = 0
        while n < K.MAX_SWEEPS:
            changed = False
            for i in range(a, e):
                if n_senses[i] == 1:
                    continue
                word = plain.codes[i] // ENCODE * ENCODE
                losses = [
                    sum(plain_loss(plain, v, u, word + k, j) for p, j in plain_pairs(plain) if p == i)
                    for k in range(n_senses[i])
                ]
                if word + int(np.argmin(losses)) != plain.codes[i]:
                    plain.codes[i], changed = word + int(np.argmin(losses)), True
            if not changed:
                break
            n += 1
        assert n == sweeps[s]
    assert np.array_equal(codes, plain.codes)


@pytest.mark.parametrize("o", OBJECTIVES)
def test_sequential_sgd_equals_plain_loop(o):
    alpha = 0.1
    b, V, U = make_bucket(o), make_rows(o), make_rows(o, seed=2, output=True)
    v, u = as_dict(V), as_dict(U)
    loss, n = K.sgd_sequential(b, V, U, alpha)
    want = 0.0
    for i, j in plain_pairs(b):
        out = b.codes[j] // ENCODE * ENCODE if o.one_sense_output else b.codes[j]
        centre, targets = v[b.codes[i]], [out, *b.negs[j]]
        if o.softmax:
            want += plain_loss(b, v, u, b.codes[i], j)
            e = np.exp([centre @ u[t] for t in targets])
            slopes = e / e.sum() - np.array([1.0] + [0.0] * o.n_neg)
            for t, g in zip(targets, slopes):
                u[t] -= alpha * g * centre
                centre -= alpha * g * u[t]
        else:
            step = np.zeros(DIM)
            for k, t in enumerate(targets):
                s = sigma(centre @ u[t])
                want -= np.log(s if k == 0 else 1 - s)
                g = (k == 0) - s
                step += g * u[t]
                u[t] += alpha * g * centre
            centre += alpha * step
    assert np.isclose(loss, want) and n > 0
    assert all(np.allclose(v[c], x) for c, x in zip(V.codes, V.vectors))
    assert all(np.allclose(u[c], x) for c, x in zip(U.codes, U.vectors))


def test_zero_step_changes_nothing_and_gives_the_loss():
    o = OBJECTIVES[1]
    b, V, U = make_bucket(o), make_rows(o), make_rows(o, seed=2, output=True)
    before = V.vectors.copy()
    loss, _ = K.sgd_sequential(b, V, U, 0.0)
    assert np.array_equal(V.vectors, before)
    assert np.isclose(loss, K.position_losses(b, V, U, np.arange(b.n), b.codes)[0].sum())


@pytest.mark.parametrize("batch", [1, 8])
def test_loss_falls_over_learning_steps(batch):
    o = OBJECTIVES[1]
    b, V, U = make_bucket(o, lengths=(30, 30)), make_rows(o), make_rows(o, seed=2, output=True)
    losses = []
    for _ in range(10):
        if batch == 1:
            K.sgd_sequential(b, V, U, 0.05)
        else:
            K.sgd_batched(b, V, U, 0.05, batch)
        losses.append(K.gradients(b, V, U)[0])
    assert all(x > y for x, y in zip(losses, losses[1:]))


def test_batch_of_one_is_one_step_of_the_gradient():
    o = K.Objective(1, 2)
    b, V, U = make_bucket(o, lengths=(2,)), make_rows(o), make_rows(o, seed=2, output=True)
    before, alpha = V.vectors.copy(), 1e-3
    d_in = K.gradients(b, V, U)[2]
    K.sgd_batched(b, V, U, alpha, 64)
    assert np.allclose(V.vectors, before - alpha * d_in, atol=1e-5)


def test_steps_hold_back_no_gradient():
    rng = np.random.default_rng(3)
    here, there = rng.integers(0, 4, 60), rng.integers(0, 30, (60, 3))
    parts = list(K.steps_of(here, there, 5))
    assert sorted(map(tuple, np.column_stack((here, there)).tolist())) == sorted(
        tuple(r) for a, b in parts for r in np.column_stack((a, b)).tolist())
    for a, b in parts:
        assert np.bincount(a).max() <= 5 and np.bincount(b.ravel()).max() <= 5
    assert len(parts) > 1


def test_a_row_in_every_pair_moves_as_far_as_one_pair_at_a_time():
    """A frequent word gets all its gradient: batches end where single pairs do."""
    o = K.Objective(2, 2)
    b = make_bucket(o, lengths=(40, 40, 40))
    ends = []
    for batch in (1, 64):
        V, U = make_rows(o), make_rows(o, seed=2, output=True)
        for _ in range(3):
            K.sgd_batched(b, V, U, 0.1, batch)
        ends.append((V.vectors, U.vectors))
    for x, y in zip(*ends):
        assert np.corrcoef(x.ravel(), y.ravel())[0, 1] > 0.97


def test_segment_sums():
    rng = np.random.default_rng(0)
    at = rng.choice(20, 400, p=np.arange(1, 21) / 210)
    values, target, want = rng.normal(size=(400, 3)), np.zeros((20, 3)), np.zeros((20, 3))
    K.scatter_add(target, at, values)
    np.add.at(want, at, values)
    assert np.allclose(target, want)


def test_large_scores_stay_finite():
    x = np.array([-800.0, -20.0, 0.0, 17.5, 800.0])
    assert np.isfinite(K.pair_loss(x, x[:, None], False)).all()
    assert np.isfinite(K.pair_loss(x, x[:, None], True)).all()


def test_missing_row_is_an_error():
    with pytest.raises(ValueError, match="no model row"):
        make_rows(OBJECTIVES[0]).index(np.array([99_900]))


# --- on Spark ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def setting(spark, lines):
    words = corpus.word_sentences(lines)
    vocab, n = vocabulary.build_vocab(vocabulary.word_count(words), 1, [15, 25])
    cuts = vocabulary.sense_cuts(vocab, 3)
    coded = corpus.random_senses(corpus.encode(words, vocab, n), cuts, 42)
    noisy = cut(sampling.with_negatives(coded, vocabulary.unigram_distribution(vocab), n, 2, cuts, True, 42))
    params = cut(model.init_random(vocab, DIM, 42, True, 2.0 * DIM, 2.0 * DIM))
    return noisy, params, K.Objective(1, 2, tuple(cuts)), vocab


def test_buckets_do_not_change_losses_or_senses(setting):
    noisy, params, o, _ = setting
    def run(buckets):
        loss = objective.sentence_loss(noisy, params, o, buckets, 42).orderBy("doc_id").toPandas()
        codes = objective.assign_senses(noisy, params, o, buckets, 42).orderBy("doc_id").collect()
        return loss["loss"].to_numpy(), [r["codes"] for r in codes]
    (a, x), (b, y) = run(1), run(5)
    assert np.allclose(a, b) and x == y


def test_counted_loss_and_gradient_equal_the_kernel(setting):
    noisy, params, o, _ = setting
    total = objective.corpus_loss(noisy, params, o, 100, DIM).first()
    parts = objective.sentence_loss(noisy, params, o, 3, 42).agg(F.sum("loss").alias("l"), F.sum("n_pred").alias("n")).first()
    assert np.isclose(total["loss"], parts["l"]) and total["n_pred"] == parts["n"]
    relational = {(r["mat"], r["code"]): r["vec"] for r in objective.sgns_gradient(noisy, params, o, 100, DIM).collect()}
    bucketed = objective.bucket_gradients(noisy, params, o, 3, 42).where("mat >= 0")
    bucketed = objective.sum_vectors(bucketed, ["mat", "code"], "vec", DIM)
    kernel = {(r["mat"], r["code"]): r["vec"] for r in bucketed.collect()}
    assert relational.keys() == kernel.keys()
    assert all(np.allclose(relational[k], kernel[k]) for k in kernel)


def test_average_of_changes_equals_average_of_models(setting):
    noisy, params, o, _ = setting
    buckets = 4
    updates = cut(objective.sgd_epoch(noisy, params, o, buckets, 42, 0.1))
    got = {
        (r["mat"], r["word_id"] * ENCODE + r["sense"]): np.array(r["vec"])
        for r in model.average_parameters(params, updates, buckets, DIM).collect()
    }
    base = {(r["mat"], r["word_id"] * ENCODE + r["sense"]): np.array(r["vec"], float) for r in params.collect()}
    rows = noisy.withColumn("b", objective.bucket_of(buckets, 42)).toArrow()
    sums = {k: np.zeros(DIM) for k in base}
    for bucket in range(buckets):
        part = rows.filter(pa.compute.equal(rows["b"], bucket))
        mats = []
        for mat in (0, 1):
            codes = np.array(sorted(c for m, c in base if m == mat))
            mats.append(K.Rows(codes, np.array([base[mat, c] for c in codes])))
        if part.num_rows:
            K.sgd_sequential(K.Bucket(part, o), mats[0], mats[1], 0.1)
        for mat in (0, 1):
            for c, v in zip(mats[mat].codes, mats[mat].vectors):
                sums[mat, c] += v / buckets
    assert all(np.allclose(got[k], sums[k]) for k in sums)
    tokens = updates.where("mat = -1").agg(F.sum("n_tokens")).first()[0]
    assert tokens == noisy.agg(F.sum(F.size("codes"))).first()[0]


def test_negatives_are_drawn_after_the_shuffle(setting):
    """Only codes are shuffled, and nothing is sorted to find a group."""
    noisy, params, o, vocab = setting
    unigram, rows = vocabulary.unigram_distribution(vocab), vocab.count()

    def draw(coded):
        return sampling.with_negatives(coded, unigram, rows, 2, list(o.cuts), True, 42)

    def changes(updates):
        rows = objective.sum_vectors(updates.where("mat >= 0"), ["mat", "code"], "vec", DIM).collect()
        return {(r["mat"], r["code"]): r["vec"] for r in rows}, updates.where("mat < 0").agg(F.sum("n_pred")).first()[0]

    late = objective.sgd_epoch(cut(noisy.drop("negs")), params, o, 20, 42, 0.1, draw=draw)
    (found, n), (wanted, m) = changes(late), changes(objective.sgd_epoch(noisy, params, o, 20, 42, 0.1))
    assert n == m and found.keys() == wanted.keys()
    assert all(np.allclose(found[k], wanted[k]) for k in found)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and plan.index("neg") < plan.index("Exchange")
    assert "negs" not in plan[plan.index("Exchange") :]


@pytest.mark.parametrize("one_sense_output", [True, False])
def test_every_output_row_is_fetched_once_for_all_distances(monkeypatch, one_sense_output):
    o = K.Objective(window=3, n_neg=4, cuts=(4, 2), one_sense_output=one_sense_output)
    b = make_bucket(o, lengths=(9, 1, 14, 30, 2, 25))
    V, U = make_rows(o), make_rows(o, seed=2, output=True)
    works = (
        lambda: K.position_losses(b, V, U, np.arange(b.n), b.codes),
        lambda: [K.best_senses(b, V, U)],
        lambda: K.gradients(b, V, U),
    )
    whole = [work() for work in works]
    monkeypatch.setattr(K, "BLOCK", 40)
    taken, take = [], U.take
    U.take = lambda at: taken.append(at.size) or take(at)
    at_most = (b.n + 2 * o.window * -(-b.n // K.BLOCK)) * (1 + o.n_neg)
    for work, want in zip(works, whole, strict=True):
        taken.clear()
        assert all(np.allclose(x, y) for x, y in zip(work(), want, strict=True))
        assert 0 < sum(taken) <= at_most
