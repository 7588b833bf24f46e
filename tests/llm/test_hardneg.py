import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polysem.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, is_anchor, n_pos=5, n_neg=3, low=50, high=95):
    good = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, i, label, q in good:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, other == label) for m, j, other, p in good if m != n)
        for s, j, same in [x for x in scored if x[2]][:n_pos]:
            window = [x for x in scored if not x[2] and low * -s <= -100 * x[0] <= high * -s][:n_neg]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(window, 1)]
    return sorted(out)


def answers(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def clustered(seed, n, dim, labels=4, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + noise * rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(labels)) if rng.random() < 0.6 else 0))
    return rows


def test_curve_is_a_walk():
    """Neighbours on the curve are neighbours in space, and every cell is met once."""
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = hardneg.curve_places(cells, bits)
        walk = cells[np.argsort(place)]
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_row():
    rng = np.random.default_rng(1)
    q = rng.integers(-300, 300, (500, 9))
    a = rng.integers(-300, 300, (40, 9))
    low, high = hardneg.bounds(a, q.min(axis=0)[None], q.max(axis=0)[None])
    scores = a @ q.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high[:, 0]).all()


@pytest.mark.parametrize(("block", "group", "chunk"), [(512, 256, 256), (16, 5, 3), (1, 1, 1)])
def test_against_all_pairs(spark, monkeypatch, block, group, chunk):
    for name, value in (("BLOCK", block), ("GROUP", group), ("CHUNK", chunk)):
        monkeypatch.setattr(hardneg, name, value)
    rows = clustered(block, 300 if block > 1 else 60, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(hardneg.mine(df, F.col("vec_id") % 5 == 0))
    assert got == plain(rows, lambda i: i % 5 == 0) and got
    other = answers(hardneg.mine(df, F.col("vec_id") % 7 == 0, 2, 4, 20, 99))
    assert other == plain(rows, lambda i: i % 7 == 0, 2, 4, 20, 99)


def test_zone_maps_skip_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 32)
    rows = clustered(9, 1500, 8, noise=0.02)
    visited = []
    got = answers(hardneg.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, visited=visited))
    assert got == plain(rows, lambda i: i % 50 == 0)
    for step, read, every in visited:
        assert 0 < read < 0.5 * every, (step, read, every)


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, v, 1), (0, v, 1), (5, v, 1), (6, v, 2), (7, [0.4, -0.25, 0.8], 2), (8, [0.4, -0.25, 0.8], 3), (8, [0.4, -0.25, 0.8], 3),
        (10, None, 1), (None, v, 1), (11, v, None), (12, [0.1, None, 1.0], 1), (13, [float("nan"), 0.0, 1.0], 1), (14, [float("inf"), 0.0, 0.0], 1),
        (15, [], 2), (16, [0.5], 1), (20, [0.5, 0.5, 0.5, 3.0, -2.0], 2), (25, [0.0, 0.0, 0.0], 1), (30, [-0.5, 0.25, -1.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", q string, score int")
    assert answers(hardneg.mine(df, F.col("vec_id") % 5 == 0)) == plain(rows, lambda i: i % 5 == 0)
    assert answers(hardneg.mine(df, F.col("vec_id") == -1)) == []
    assert answers(hardneg.mine(df.limit(0), F.col("vec_id") % 5 == 0)) == []
    huge = spark.createDataFrame([(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [1e30, 0.0], 2)], SCHEMA)
    assert [r[:4] for r in answers(hardneg.mine(huge, F.col("vec_id") == 0, low=0, high=100))] == [(0, 1, 1, 2)]


def test_one_label_and_equal_vectors(spark):
    rows = [(i, [1.0, 0.0], 0 if i < 700 else 1) for i in range(1100)] + [(2000 + i, [0.8, 0.0], 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert answers(hardneg.mine(df, F.col("vec_id") % 100 == 0)) == plain(rows, lambda i: i % 100 == 0)
