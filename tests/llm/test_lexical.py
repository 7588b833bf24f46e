import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from polysem.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return WORD.findall((text or "").translate(LOW))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 10 + (90 * bag.total() * n_docs) // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m))
                for w in set(terms(text)) if bag[w]
            )
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def answers(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    docs += [(n + j, docs[j][1]) for j in range(0, n, 3)]  # ties
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 30])))) for i in range(15)]
    return docs, [*items, (15, None), (16, "!!"), (17, "nowhere unseen"), (17, "w1 w2 w1")]


@pytest.mark.parametrize(("segment", "step", "slice_terms"), [(16_384, 8, 1 << 20), (7, 1, 1 << 20), (40, 3, 25)])
def test_against_plain_ranking(spark, frame, monkeypatch, segment, step, slice_terms):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "SLICE_TERMS", slice_terms)
    docs, items = corpus(segment, 250)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    got = lexical.search(frame(docs).repartition(5), queries)
    assert answers(got) == plain(docs, items)


def lists_of(rng, n_docs, n_terms):
    keys = np.unique(rng.integers(0, n_docs * n_terms, n_docs * n_terms // 3))
    impact = np.ceil(1e6 / rng.integers(1, 3000, len(keys)) ** 1.3).astype(np.int64)
    return keys % n_terms, keys // n_terms, impact


def test_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    term, doc, impact = lists_of(rng, 5000, 6)
    lists = lexical.Lists(5000, term.astype(np.int32), doc.astype(np.int32), impact, 6)
    ids = rng.permutation(5000) * 3
    trace = []
    for wanted in ([0], [1, 4], [0, 1, 2, 3, 4, 5]):
        some = np.isin(term, wanted)
        total = np.bincount(doc[some], impact[some], minlength=5000).astype(np.int64)
        order = np.lexsort((ids, -total))[:10]
        order = order[total[order] > 0]
        docs, scores = lexical.best_positions(lists, np.array(wanted), ids, 10, trace=trace)
        assert docs.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert all(looked < n / 4 for looked, n in trace)


def test_equal_bound_does_not_stop():
    """All scores are the same: the smallest ids win though they stand last."""
    n = 500
    lists = lexical.Lists(n, np.zeros(n, np.int32), np.arange(n, dtype=np.int32), np.full(n, 7), 1)
    docs, scores = lexical.best_positions(lists, np.array([0]), np.arange(n)[::-1].copy(), 10)
    assert docs.tolist() == list(range(n - 1, n - 11, -1)) and (scores == 7).all()


def test_measure_beyond_63_bits():
    m = lexical.measures(np.array([10**9, 3]), 10**11, 10**14)
    assert m.tolist() == [10 + 90 * 10**9 * 10**11 // 10**14, 10]


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "one two THREE eight"), (2, "naïve 日本語 é"), (None, "words here"), (3, ""), (4, "x" * 50_000), (5, rows[12][1])]
    queries = spark.createDataFrame([(*x, "a") for x in items], "item_id bigint, text string, rank string")
    assert answers(lexical.search(odd, queries)) == plain(rows, items)
    assert lexical.search(nothing, queries).count() == 0
    assert lexical.search(odd, queries.limit(0)).count() == 0
