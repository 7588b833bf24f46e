import math
import zlib

import numpy as np

from polysem.llm import langid
from tests.llm.conftest import prose


def corpus(n=240):
    rows = [(i, prose(lang, 60, i), lang) for i in range(n) for lang in [("en", "de", "fr")[i % 3]]]
    return rows + [(n, None, "en"), (n + 1, "", "de"), (n + 2, "123 %%", None), (None, prose("de", 30, 7), "de"), (n + 3, prose("fr", 60, 5), None)]


def test_held_out_accuracy(frame):
    rows = corpus()
    got = {r["doc_id"]: r for r in langid.predict(frame(rows, "score held_out languages")).collect()}
    held = [(i, lang) for i, t, lang in rows if i is not None and t and zlib.crc32(str(i).encode()) % 4 == 2 and lang]
    assert len(held) > 40
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got if i is not None)
    assert not got[None]["held_out"] and got[None]["lang_pred"] == "de"
    for i in (240, 241, 242):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0.0, "")
    assert all(0 <= r["score"] <= 1 for r in got.values())


def learnt(rows):
    names = ["de", "en", "fr"]
    table = np.full((3, langid.BUCKETS), langid.SMOOTHING)
    for _, t, lang in rows:
        if t and lang:
            table[names.index(lang)] += np.bincount(langid.ngrams([t])[1], minlength=langid.BUCKETS)
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def test_mixtures():
    logs = learnt(corpus())
    texts = [
        prose("en", 200, 901), prose("en", 300, 902) + "\n" + prose("de", 100, 903), "", "12 34",
        prose("en", 150, 904) + " " + prose("de", 150, 905) + " " + prose("fr", 150, 906),
    ]
    shares, sure = langid.proportions(texts, logs)
    assert shares[0].tolist() == [0, 1, 0] and sure[0] > 0.99
    assert shares[1][2] == 0 and 0.15 < shares[1][0] < 0.4 and abs(shares[1].sum() - 1) < 1e-4
    assert not shares[2:4].any()
    assert (shares[4] > 0.2).all()
    # What else is in the batch makes no difference.
    for text, share in zip(texts, shares, strict=True):
        assert np.allclose(langid.proportions([text], logs)[0][0], share, atol=1e-5)


def test_one_round_against_plain_expectation_maximisation():
    logs = learnt(corpus())
    text, cell, count = langid.counted([prose("en", 40, 1) + prose("fr", 20, 2)])
    likely = np.exp(logs.T[cell])
    share = np.full(3, 1 / 3)
    for _ in range(5):
        parts = np.zeros(3)
        for p, n in zip(likely, count, strict=True):
            parts += n * share * p / (share * p).sum()
        share = parts / parts.sum()
    found, value = langid.fit(np.full((1, 3), 1 / 3, np.float32), likely, count, text, np.array([0]), 5)
    assert np.allclose(found[0], share, atol=1e-4)
    assert np.isclose(value[0], sum(n * np.log((share * p).sum()) for p, n in zip(likely, count, strict=True)), rtol=1e-4)


def test_counts_cover_all_training_rows(spark, frame):
    rows = corpus(30)
    names, logs = langid.learn(frame(rows).repartition(4))
    assert names == ["de", "en", "fr"]
    assert np.allclose(logs, learnt(rows), atol=1e-5)


def test_filter(frame, odd, nothing):
    rows = corpus(60)
    df = frame(rows, "_held score")
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t, _ in rows if any(c.isalpha() for c in t or "")}
    assert langid.keep_known(nothing).count() == langid.predict(nothing).count() == 0
    assert langid.predict(odd).count() == odd.count() and langid.keep_known(odd).columns == odd.columns
    unlabelled = frame([(1, "some words", None)])
    assert langid.predict(unlabelled).first()["lang_pred"] == "und"


def test_filter_keeps_mixtures_and_drops_other_scripts(frame):
    rows = corpus(60)
    mixed = " ".join(prose("de", 40, 901).split() + prose("en", 30, 902).split() + prose("fr", 30, 903).split())
    rows += [(900, mixed, None), (901, "привет как дела это текст", None), (902, "日本語の文章です", "en"), (903, "zxqj wvkk qqzt jxjx zzqx", None)]
    # what only held-out rows have is not learnt
    held = [r for r in rows if r[0] != 902]
    kept = {r["doc_id"] for r in langid.keep_known(frame(held)).collect()}
    assert 900 in kept and not kept & {901, 903}
    shares, _ = langid.proportions([mixed], learnt(rows))
    assert shares.max() < 0.5  # no language has half


def test_filter_without_labels_keeps_all(frame):
    rows = [(i, t, None) for i, t, _ in corpus(20)] + [(99, "12 %", None)]
    assert langid.keep_known(frame(rows)).count() == len(rows)


def plain_choice(text, logs):
    """Proportions of the chosen set, number by number."""
    cells = [int(c) for c in langid.ngrams([text])[1]]
    n = len(cells)
    if not n:
        return [0.0] * len(logs)
    likely = [[math.exp(float(row[c])) for row in logs] for c in cells]

    def maximised(share):
        for _ in range(langid.ROUNDS):
            sums = [0.0] * len(share)
            for p in likely:
                whole = sum(s * x for s, x in zip(share, p, strict=True))
                for i, (s, x) in enumerate(zip(share, p, strict=True)):
                    sums[i] += s * x / whole
            share = [x / n for x in sums]
        return share, sum(math.log(sum(s * x for s, x in zip(share, p, strict=True))) for p in likely)

    single = [sum(math.log(p[i]) for p in likely) for i in range(len(logs))]
    chosen, value = [float(i == single.index(max(single))) for i in range(len(logs))], max(single)
    full, _ = maximised([1 / len(logs)] * len(logs))
    order = sorted(range(len(logs)), key=lambda i: -full[i])
    for k in range(2, len(logs) + 1):
        cost = langid.PENALTY * math.log(n + 1)
        if full[order[k - 1]] * n <= cost:
            break
        some = [full[i] if i in order[:k] else 0.0 for i in range(len(logs))]
        share, fitted = maximised([s / sum(some) for s in some])
        if fitted - (k - 1) * cost <= value:
            break
        chosen, value = share, fitted - (k - 1) * cost
    return chosen


def test_choice_of_the_set_against_plain_version():
    logs = learnt(corpus())
    texts = [prose(a, 20 + 7 * i, i) + " " + prose(b, 5 * i + 1, 50 + i) for i in range(6) for a in ("en", "de") for b in ("en", "fr")]
    texts += [" ".join(prose(x, 30, 77) for x in ("en", "de", "fr")), "x", "ab", "", "1 2"]
    shares, _ = langid.proportions(texts, logs)
    for text, found in zip(texts, shares, strict=True):
        want = plain_choice(text, logs)
        assert [x > 0 for x in found] == [x > 0 for x in want] and np.allclose(found, want, atol=2e-3), text[:60]
