import random

import numpy as np
import pytest

from polysem.llm import decontaminate


def fold(text):
    return "".join(map(chr, decontaminate._trim(decontaminate.folded([text])[0]).tolist()))


def distance(passage, text):
    """Least edits between the passage and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, share, rng):
    out = list(text)
    for _ in range(rng.randint(0, int(len(out) * share))):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcxyz")
        elif kind == 1:
            out.insert(at, rng.choice("abc xyz"))
        else:
            del out[at]
    return "".join(out)


def words(n, rng):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    items = [(i, words(rng.choice([3, 8, 20, 45]), rng)) for i in range(12)] + [(12, ""), (13, None), (14, "a b"), (0, words(30, rng))]
    docs = [(i, words(rng.randint(0, 60), rng)) for i in range(20)]
    for i in range(20, 160):
        item = rng.choice(items[:12])[1]
        docs.append((i, f"{words(rng.randint(0, 30), rng)} {edited(item, 0.14, rng)}. {words(rng.randint(0, 30), rng)}"))
    return docs, items


def test_against_brute_force(spark, frame, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {}
    for r in decontaminate.matches(frame(docs), bench).collect():
        got.setdefault((r["doc_id"], r["item_id"]), []).append((r["start"], r["end"], r["edits"]))
    true = set()
    for i, t in docs:
        for j, p in items:
            passage = fold(p or "")
            if len(passage) >= decontaminate.Q:
                k = decontaminate.budget(len(passage), decontaminate.Q, decontaminate.RATE)
                cost = distance(passage, fold(t))
                if cost <= k:
                    true.add((i, j))
                    assert any(e == cost for _, _, e in got[i, j])
                    for a, b, e in got[i, j]:
                        assert min(distance(fold(t[a:b]), fold(x or "")) for y, x in items if y == j) <= e
    assert set(got) == true and len(true) > 50
    kept = {r["doc_id"] for r in decontaminate.clean(frame(docs), bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in true}


def test_slices_of_the_benchmark_find_the_same(spark, frame, cases, monkeypatch):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.matches(frame(docs), bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 500)
    assert sorted(map(tuple, decontaminate.matches(frame(docs), bench).collect())) == whole
    monkeypatch.setattr(decontaminate, "WORK_CHARS", 300)
    assert sorted(map(tuple, decontaminate.matches(frame(docs), bench).collect())) == whole


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "ONE two, three four five"), (2, "x" * 60), (3, None), (1, "ONE two, three four five")], "item_id bigint, text string")
    found = decontaminate.matches(odd, bench).collect()
    assert sorted((r["doc_id"], r["edits"]) for r in found if r["item_id"] == 1) == [(1, 0), (2, 0), (2, 0)]
    assert {r["doc_id"] for r in found if r["item_id"] == 2} == {9}
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert decontaminate.matches(nothing, bench).count() == decontaminate.clean(nothing, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


def test_repeated_occurrences_are_all_found():
    index = decontaminate.Passages([7], ["some passage of the benchmark"], 8, 0.1)
    text = "some passage of the benchmark, and some passage of the benchmark again"
    assert [h[2:4] for h in index.find([text])] == [(0, 29), (35, 64)]
    assert np.array_equal(decontaminate.grams(np.arange(40, dtype=np.uint32), 7)[5:6], decontaminate.grams(np.arange(5, 12, dtype=np.uint32), 7))
