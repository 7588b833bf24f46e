import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polysem.functions import vectors as fv
from polysem.operators import model, objective, senses
from polysem.plans import catalog
from polysem.plans import training as tr
from polysem.session import cut, fresh_path
from polysem.sources import readers, writers


def settings(**changes):
    values = dict(
        min_count=1, thresholds=(15,), window=1, n_neg=2, dim=4, chunks=2, epochs=2, alpha=0.25, gamma=0.95,
        validate_every=2, max_squared_norm=5.0, min_prob=0.1, validation_ratio=0.3, buckets=2,
    )
    return tr.Settings(**{**values, **changes})


@pytest.fixture(scope="module")
def one_sense(lines):
    return tr.fit_one_sense(lines, settings())


def test_history(one_sense, spark):
    h = one_sense.history_table(spark).orderBy("it").collect()
    assert [r["it"] for r in h] == [0, 1, 2, 3]
    assert h[0]["vali_loss"] is None and h[1]["vali_loss"] is not None and h[3]["vali_loss"] is not None
    assert all(r["n_tokens"] > 0 and math.isfinite(r["train_loss"]) for r in h)


def test_norms_are_bounded(one_sense):
    assert one_sense.model.where(fv.squared_norm(F.col("vec")) > 5.0).count() == 0


def test_runs_repeat(lines, one_sense):
    again = tr.fit_one_sense(lines.repartition(3), settings())
    for a, b in zip(one_sense.history, again.history, strict=True):
        assert np.isclose(a["train_loss"], b["train_loss"])


def test_save_load_and_multi_sense(spark, lines, one_sense):
    path = fresh_path(spark, "test-model")
    tr.save(one_sense, path)
    stored = readers.read_sense_vectors(spark, f"{path}/input")
    names = {r["word"]: tuple(r["vec"]) for r in stored.collect()}
    assert names == {r["word"]: tuple(r["vec"]) for r in one_sense.vectors().collect()}
    fitted = tr.fit_multi_sense(lines, settings(epochs=1), tr.stored_start(spark, path, settings()))
    for r in fitted.vocab.collect():
        assert r["n_senses"] == (2 if r["cn"] >= 15 else 1)
    sums = fitted.probs.groupBy("word_id").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    assert all(r["n_reset"] is not None for r in fitted.history)


def test_resume(spark, lines):
    paths = [fresh_path(spark, "test-stage") for _ in range(4)]
    s = settings(chunks=1, validate_every=1)
    first = tr.run_stages(lines, s, "1_0", paths[0], paths[1])
    resumed = tr.run_stages(lines, s, "R1_0", paths[2], paths[3], resume_from=paths[0])
    assert resumed.history[0]["train_loss"] != first.history[0]["train_loss"]
    with pytest.raises(ValueError, match="resume"):
        tr.run_stages(lines, s, "R1_0", paths[2], paths[3])


def test_interrupted_training_goes_on_from_the_last_save(spark, lines, monkeypatch):
    paths = [fresh_path(spark, "test-saved") for _ in range(2)]
    s = settings(epochs=4, chunks=1, validate_every=1)
    losses = iter([0.5, 0.4])

    def validate(*args):
        return next(losses), 0.0  # the third call fails

    monkeypatch.setattr(tr, "validate", validate)
    with pytest.raises((StopIteration, RuntimeError)):
        tr.run_stages(lines, s, "4_0", paths[0], paths[1])
    last = tr.last_saved(spark, f"{paths[0]}_saved")
    assert "it00001" in last
    history = readers.read_history(spark, f"{last}/history").orderBy("it").collect()
    assert [(r["it"], r["vali_loss"]) for r in history] == [(0, 0.5), (1, 0.4)]
    words = spark.read.text(f"{last}/w2v").collect()
    assert words[0]["value"].split()[1] == str(s.dim) and int(words[0]["value"].split()[0]) == len(words) - 1
    monkeypatch.setattr(tr, "validate", lambda *a: (0.3, 0.0))
    resumed = tr.run_stages(lines, s, "R1_0", f"{paths[0]}-again", paths[1], resume_from=last)
    assert resumed.history[0]["saved"]


class Killed(Exception):
    pass


def rows_of(df):
    return {tuple(r)[:3]: np.array(r["vec"]) for r in df.select("mat", "word_id", "sense", "vec").collect()}


@pytest.mark.parametrize(("one_sense", "dies_in"), [(True, 1), (False, 0), (False, 2)])
def test_a_killed_run_goes_on_at_its_iteration(spark, lines, monkeypatch, one_sense, dies_in):
    s = settings(validate_every=1)
    whole = tr.fit(lines, s, one_sense)
    path, calls = fresh_path(spark, "test-run"), []
    average = model.average_parameters

    def dying(*args):
        calls.append(1)
        if len(calls) == dies_in + 1:
            raise Killed
        return average(*args)

    monkeypatch.setattr(model, "average_parameters", dying)
    with pytest.raises(Killed):
        tr.fit(lines, s, one_sense, manifest=path)
    seen = len(calls)
    again = tr.fit(lines, s, one_sense, manifest=path)
    assert len(calls) - seen == len(whole.history) - dies_in  # earlier iterations are not done again
    assert [h["it"] for h in again.history] == [h["it"] for h in whole.history]
    for a, b in zip(again.history, whole.history, strict=True):
        assert np.isclose(a["train_loss"], b["train_loss"]) and a["saved"] == b["saved"] and a["n_tokens"] == b["n_tokens"]
        assert np.isclose(a["vali_loss"], b["vali_loss"])
    x, y = rows_of(again.model), rows_of(whole.model)
    assert x.keys() == y.keys() and all(np.allclose(x[k], y[k], atol=1e-6) for k in x)
    if not one_sense:
        probs = lambda fit: {(r["word_id"], r["sense"]): r["prob"] for r in fit.probs.collect()}
        p, q = probs(again), probs(whole)
        assert p.keys() == q.keys() and all(np.isclose(p[k], q[k]) for k in p)
    # a finished run is not trained again, and other settings are refused
    done = tr.fit(lines, s, one_sense, manifest=path)
    assert done.history == again.history and len(calls) - seen == len(whole.history) - dies_in
    with pytest.raises(ValueError, match="other settings"):
        tr.fit(lines, settings(alpha=0.5), one_sense, manifest=path)


def test_buckets_follow_the_corpus_and_not_the_cluster():
    s = settings(buckets=0, tokens_per_bucket=1000)
    assert [tr.bucket_count(n, s) for n in (0, 1, 1000, 1001, 2000, 2_000_000)] == [1, 1, 1, 2, 2, 2000]


def test_the_largest_group_does_not_grow_with_the_corpus(spark):
    def largest(n):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("line"))
        buckets = tr.bucket_count(n * 10, settings(buckets=0, tokens_per_bucket=10_000))
        placed = rows.groupBy(objective.bucket_of(buckets, 1)).count()
        return placed.agg(F.max("count")).first()[0]

    assert largest(20_000) < 1.2 * largest(10_000)


def test_epoch_specs():
    assert tr.parse_epochs("5_10") == (tr.Stage(5, False), tr.Stage(10, False))
    assert tr.parse_epochs("0_R5")[1] == tr.Stage(5, True)
    assert tr.parse_epochs("R2_3")[0] == tr.Stage(2, True)
    for bad in ("5", "R1_R1", "1_R1", "R0_1", "0_R0"):
        with pytest.raises(ValueError):
            tr.parse_epochs(bad)


def test_schedule_and_stop():
    assert tr.learning_rate(0.1, 0.9, 0) == 0.1
    assert np.isclose(tr.learning_rate(0.1, 0.9, 2), 0.081)
    assert tr.learning_rate(0.1, 0.9, 10_000) == 1e-5
    assert not tr.must_stop([0.3]) and not tr.must_stop([0.3, 0.25]) and tr.must_stop([0.3, 0.25, 0.26])
    nan = float("nan")
    assert tr.must_stop([nan]) and tr.must_stop([0.3, nan])


def test_early_stop_keeps_the_last_good_model(lines, monkeypatch):
    losses = iter([0.30, 0.25, 0.24, 0.26, 0.23])
    monkeypatch.setattr(tr, "validate", lambda *a: (next(losses), 0.0))
    saved = []
    fitted = tr.fit(lines, settings(epochs=5, chunks=1, validate_every=1), True, on_save=lambda f: saved.append(f.model))
    assert [r["saved"] for r in fitted.history] == [True, True, True, False]
    assert fitted.model is saved[2]


def test_weight_decay_and_norm_limit(spark):
    m = spark.createDataFrame([(0, 0, 0, [3.0, 4.0]), (0, 1, 0, [0.3, 0.4])], "mat int, word_id int, sense int, vec array<float>")
    decayed = {r["word_id"]: r["vec"] for r in model.weight_decay(m, 0.1, 0.5).collect()}
    assert np.allclose(decayed[0], [2.85, 3.8])
    limited = {r["word_id"]: r for r in model.limit_norm(m, 15.0).collect()}
    assert np.isclose(np.square(limited[0]["vec"]).sum(), 15 * 0.99) and limited[0]["limited"]
    assert np.allclose(limited[1]["vec"], [0.3, 0.4]) and not limited[1]["limited"]
    with pytest.raises(ValueError):
        model.weight_decay(m, 0.5, 1.0)


def test_sense_probabilities(spark):
    probs = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5)], "word_id int, sense int, prob double")
    counts = spark.createDataFrame([(0, 0, 10)], "word_id int, sense int, n bigint")
    got = {(r["word_id"], r["sense"]): r["prob"] for r in senses.update_sense_probs(probs, counts).collect()}
    f = 0.99**10
    assert np.isclose(got[0, 0], 0.5 * f + 1 - f) and np.isclose(got[0, 1], 0.5 * f) and got[1, 0] == 0.5


def test_reset_of_rare_senses(spark):
    rows = [(0, 0, 0.97), (0, 1, 0.01), (0, 2, 0.02), (1, 0, 0.3), (1, 1, 0.7), (2, 0, 1.0), (3, 0, 0.005), (3, 1, 0.005)]
    probs = spark.createDataFrame(rows, "word_id int, sense int, prob double")
    plan = cut(senses.reset_plan(probs, 0.6, 7))
    by = {(r["word_id"], r["sense"]): r for r in plan.collect()}
    assert by[0, 1]["is_reset"] and by[0, 1]["donor"] == 0 and not by[0, 0]["is_reset"]
    assert by[1, 0]["donor"] == 1 and not by[2, 0]["is_reset"]
    assert not by[3, 0]["is_reset"], "no donor: the vector stays"
    assert tuple(senses.reset_summary(plan).first()) == (7, 3)
    params = [(m, w, s, [float(w), float(s)]) for w, s, _ in rows for m in (0, 1)]
    table = spark.createDataFrame(params, "mat int, word_id int, sense int, vec array<float>")
    for one_sense_output in (True, False):
        new = senses.reset_rare_senses(table, plan, 2, 7, one_sense_output).collect()
        for r in new:
            moved = by[r["word_id"], r["sense"]]["is_reset"] and (r["mat"] == 0 or not one_sense_output)
            donor = by[r["word_id"], r["sense"]]["donor"] if moved else r["sense"]
            assert np.allclose(r["vec"], [r["word_id"], donor], atol=0.0026)


def test_warm_start_rules(spark):
    vocab = spark.createDataFrame([("a", 0, 3), ("b", 1, 1), ("c", 2, 2)], "word string, word_id int, n_senses int")
    stored = spark.createDataFrame(
        [(0, "a", 0, [1.0, 2.0]), (1, "a", 1, [5.0, 6.0]), (2, "b", 0, [3.0, 3.0])],
        "line_no bigint, word string, sense int, vec array<float>",
    )
    got = {(r["word_id"], r["sense"]): r["vec"] for r in model.init_from_vectors(vocab, stored, 0, 2, 1).collect()}
    assert got[0, 1] == [5.0, 6.0] and got[2, 0] == got[2, 1] == [0.0, 0.0]
    for sense in (0, 2):  # the first line fills all senses, with noise
        assert np.allclose(got[0, sense], [1, 2], atol=0.0026) and got[0, sense] != [1.0, 2.0]
    model.check_stored(vocab, stored, 2)
    for bad in ([(0, "zzz", 0, [1.0, 2.0])], [(0, "a", 3, [1.0, 2.0])], [(0, "a", 0, [1.0])]):
        with pytest.raises(ValueError, match="does not fit"):
            model.check_stored(vocab, spark.createDataFrame(bad, stored.schema), 2)


def test_flat_and_w2v_files(spark):
    rows = spark.createDataFrame([("b", 0, [1.5, -2.0]), ("a", 1, [0.25, 3.0]), ("a", 0, [1.0, 1.0])], "word string, sense int, vec array<float>")
    path = fresh_path(spark, "w2v")
    writers.write_w2v_text(rows, 2, path)
    text = readers.numbered_lines(spark, path)[0].orderBy("line_no").collect()
    assert [r["value"] for r in text] == ["3 2", "a_0 1.0 1.0", "a_1 0.25 3.0", "b_0 1.5 -2.0"]
    index, flat = fresh_path(spark, "flat"), fresh_path(spark, "flat")
    writers.write_flat_model(rows, index, flat)
    assert sorted(r["value"] for r in spark.read.text(index).collect()) == ["a_0 0", "a_1 1", "b_0 2"]


def test_the_mean_is_of_eight_models_however_many_tokens(spark, tmp_path):
    rows = [(i, " ".join("abcdefgh"[(i * i + 3 * p) % 8] for p in range(12))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = catalog.Inputs(spark, str(tmp_path))
    key = ["mat", "word_id", "sense", "k"]
    read = lambda df: {tuple(r[c] for c in key): r[-1] for r in df.collect()}
    got, grads = read(catalog.QUERIES["average_parameters"](t)), read(catalog.QUERIES["sgns_gradient"](t))
    start = read(catalog._dims(t.model, "mat", "word_id", "sense", digits=9))
    assert got.keys() == start.keys() and len(grads) and t.buckets == 1
    assert all(np.isclose(got[k], start[k] + grads.get(k, 0.0) / 8, atol=1e-4) for k in got)
