import random
import zlib

import numpy as np
import pytest

from polysem.llm import chars, toxicity
from tests.llm.conftest import prose

BAD = ["vileword", "grimterm", "foulstem"]


def corpus(n=700):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = prose(["en", "de"][i % 2], 50, i).split()
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(50), rng.choice(BAD) + rng.choice(["", "s", "ung", "er"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, toxic))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame([(i, None, t, "x") for i, t in labels], "doc_id bigint, quality int, toxic int, score string")


def test_held_out_quality(spark, frame):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in toxicity.score(frame(rows, "toxic score"), label_frame(spark, labels)).collect()}
    assert len(got) == len(rows)
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    bad = [got[i]["score"] for i, t in held if t]
    good = [got[i]["score"] for i, t in held if not t]
    assert np.mean([b >= 0.7 for b in bad]) > 0.95 and np.mean([g < 0.3 for g in good]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    shown = [r["evidence"] for r in got.values() if r["predicted"]]
    assert all(e.split(",")[0].split(":")[1] == "1" for e in shown)


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
@pytest.mark.parametrize("least", [0.0, 0.4])
def test_nearest_against_brute_force(block, least):
    rng = np.random.default_rng(block)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(300)]
    terms = np.unique(toxicity.features(words)[1])
    idf = rng.random(len(terms)) * 5
    owner, cols, counts = toxicity.counted(texts, terms)
    dense = np.zeros((300, len(terms)), np.float32)
    for i, j in toxicity.runs_of(owner):
        dense[owner[i], cols[i:j]] = toxicity.vector_of(cols[i:j], counts[i:j], idf)
    col, row = np.nonzero(dense.T)
    index = toxicity.Index(col, row, dense[row, col], len(terms), 300, block)
    for i, j in toxicity.runs_of(owner):
        at = int(owner[i])
        weight = toxicity.vector_of(cols[i:j], counts[i:j], idf)
        cosine = np.round(dense.astype(float)[:, cols[i:j]] @ weight, 9)
        for k, without in ((1, -1), (10, -1), (10, at), (1000, at)):
            near, found = index.nearest(cols[i:j], weight, k, least, without)
            others = np.where(np.arange(300) == without, 0, cosine)
            order = np.lexsort((np.arange(300), -others))
            best = [x for x in order if others[x] > 1e-9 and others[x] >= least][:k]
            assert np.allclose(found, np.minimum(others[best], 1), atol=2e-9) and without not in near
            assert len(near) == len(best) and np.allclose(cosine[near], cosine[best], atol=2e-9)


def test_blocks_are_skipped():
    """Examples of few topics side by side: most blocks cannot reach the nearest found."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"topic{i // 64}word{j}" for j in rng.choice(60, 20)) + " the and of" for i in range(64 * 20)]
    terms = np.unique(toxicity.features(texts)[1])
    owner, cols, counts = toxicity.counted(texts, terms)
    df = np.bincount(cols, minlength=len(terms))
    idf = np.log(len(texts) / df) + 0.1
    weight = np.concatenate([toxicity.vector_of(cols[i:j], counts[i:j], idf) for i, j in toxicity.runs_of(owner)])
    order = np.lexsort((owner, cols))
    index = toxicity.Index(cols[order], owner[order], weight[order].astype(np.float32), len(terms), len(texts))
    trace = []
    for i, j in list(toxicity.runs_of(owner))[::37]:
        index.nearest(cols[i:j], weight[i:j], 25, trace=trace)
    assert sum(a for a, _ in trace) < 0.5 * sum(b for _, b in trace)


def test_few_postings_are_read(monkeypatch):
    """Most examples share the frequent words of a text; their own norms rule them out."""
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 2001)
    texts = [" ".join(f"w{j}x" for j in rng.choice(2000, 80, p=share / share.sum())) for _ in range(1200)]
    texts += [t + " more words" for t in texts[::40]]
    terms = np.unique(toxicity.features(texts)[1])
    owner, cols, counts = toxicity.counted(texts, terms)
    idf = np.log(len(texts) / np.bincount(cols, minlength=len(terms))) + 1
    weight = np.concatenate([toxicity.vector_of(cols[i:j], counts[i:j], idf) for i, j in toxicity.runs_of(owner)]).astype(np.float32)
    order = np.lexsort((owner, cols))
    index = toxicity.Index(cols[order], owner[order], weight[order], len(terms), len(texts))
    dense = np.zeros((len(texts), len(terms)))
    dense[owner, cols] = weight
    read, every, spans = [], 0, toxicity.spans
    monkeypatch.setattr(toxicity, "spans", lambda start, count: read.append(count.sum()) or spans(start, count))
    for i, j in list(toxicity.runs_of(owner))[::31]:
        every += (index.lists[cols[i:j] + 1] - index.lists[cols[i:j]]).sum()
        near, found = index.nearest(cols[i:j], weight[i:j].astype(float), 25, 0.5)
        cosine = np.round(dense @ dense[owner[i]], 9)
        best = [x for x in np.lexsort((np.arange(len(texts)), -cosine)) if cosine[x] >= 0.5][:25]
        assert near.tolist() == best and np.allclose(found, np.minimum(cosine[best], 1), atol=2e-9)
    assert sum(read) < 0.15 * every


def test_marks_follow_the_examples(spark, frame):
    """The bar rises with the number of terms tested, and chance finds pass at no size."""
    for n in (200, 700):
        rows, labels = corpus(n)
        docs = frame(rows).select("doc_id", "text")
        some, _ = toxicity.chosen_examples(docs, label_frame(spark, labels).select("doc_id", "toxic"), 3, 1, 4096)
        terms, marks = toxicity.vocabulary(some)
        stems = {chars.word_hash(w + e) for w in BAD for e in ["", "s", "ung", "er"]}
        grams = set(toxicity.features(BAD)[1].tolist())
        assert set(terms[marks].tolist()) <= stems | grams | {int(v) for w in BAD for e in ["s", "ung", "er"] for v in toxicity.features([w + e])[1]}
        assert marks.sum() >= 3


def test_isotonic_fit():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]), np.array([1.0, 1, 3, 1]))
    assert y.tolist() == [0, 0.25, 1] and np.allclose(x, [0.1, (0.2 + 0.9) / 4, 0.4])
    rng = np.random.default_rng(0)
    votes = rng.random(500)
    x, y = toxicity.isotonic(votes, (rng.random(500) < votes).astype(float), np.ones(500))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()


def test_examples_are_bounded_and_not_held_out(spark, frame):
    rows, labels = corpus(300)
    df = frame(rows + rows[:20]).select("doc_id", "text")
    given = label_frame(spark, [*labels, (5, 1), (None, 1), (9999, 1)]).select("doc_id", "toxic")
    some, sizes = toxicity.chosen_examples(df, given, 3, 1, 20)
    found = some.collect()
    assert sum(r["toxic"] for r in found) <= 20 and len(found) <= 40
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in found)
    train = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1} | {i for i in (5, 9999) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert sum(sizes.values()) == len(train)


def test_odd_rows(spark, odd, nothing, frame):
    labels = label_frame(spark, [(1, 1), (1, 0), (2, None), (None, 1), (6, 0)])
    assert toxicity.score(odd, labels).count() == odd.count()
    none = toxicity.score(odd, labels.limit(0)).collect()
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in none)
    assert toxicity.score(nothing, labels).count() == 0
    one_class = toxicity.score(odd, label_frame(spark, [(i, 1) for i in range(12)])).collect()
    assert all(0 <= r["score"] <= 1 for r in one_class)


def test_rare_words_reach_their_example(spark, frame):
    """Toxic texts whose words are in one example only are compared with it."""
    rows, labels = corpus(60)
    alone = " ".join(f"{w}x" for w in "rotten mouldy putrid rancid fetid squalid".split())
    train = next(i for i in range(900, 999) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows += [(train, alone), (5000, alone + " again")]
    got = {r["doc_id"]: r for r in toxicity.score(frame(rows), label_frame(spark, [*labels, (train, 1)])).collect()}
    first = got[5000]["evidence"].split(",")[0].split(":")
    assert first[:2] == [str(train), "1"] and float(first[2]) > 0.9
    assert got[train]["evidence"].startswith(f"{train}:1:1.000")


def test_characters_of_examples_are_bounded(spark, frame, monkeypatch):
    monkeypatch.setattr(toxicity, "EXAMPLE_CHARS", 8000)
    rows, labels = corpus(200)
    docs = frame(rows).select("doc_id", "text")
    some, _ = toxicity.chosen_examples(docs, label_frame(spark, labels).select("doc_id", "toxic"), 3, 1, 4096)
    found = some.collect()
    assert 0 < sum(len(r["text"]) for r in found) <= 8000
    assert sorted(r["number"] for r in found) == list(range(len(found)))
