import hashlib
import re

import numpy as np
import pytest

from polysem.llm import exact


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 6])
def test_find_against_brute_force(odd, bits):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = exact.find(odd, fp_bits=bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    # One row of each class stays, and it has the smallest id.
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_many_copies_over_many_sources(spark, frame, monkeypatch):
    monkeypatch.setattr(exact, "SOURCE_ROWS", 7)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 50}") for i in range(400)]
    got = exact.find(frame(rows).repartition(5)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)


def test_keep_one(odd, nothing):
    for bits in (64, 4):
        kept = exact.keep_one(odd, fp_bits=bits)
        assert kept.columns == odd.columns
        rows = kept.collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        texts = [norm(r["text"]) for r in rows]
        every = {}
        for r in odd.collect():
            every.setdefault(norm(r["text"]), []).append(r["doc_id"])
        assert len(texts) == len(set(texts)) == len(every)
        for r in rows:
            assert r["doc_id"] == min((i for i in every[norm(r["text"])] if i is not None), default=None)
    assert exact.keep_one(nothing).count() == 0
    assert exact.find(nothing).count() == 0


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 100, 5000):
        for low, span in ((0, 1 << 64), (1 << 63, 1 << 62), (5 << 60, 1 << 40)):
            values = np.unique(np.array([low + int(x * (span - 1)) for x in rng.random(n)], np.uint64))
            shift, code = exact.golomb_encode(values, low, span)
            assert (exact.golomb_decode(code, len(values), low, shift) == values).all()
    shift, code = exact.golomb_encode(np.array([0, (1 << 64) - 1], np.uint64), 0, 1 << 64)
    assert exact.golomb_decode(code, 2, 0, shift).tolist() == [0, (1 << 64) - 1]


def test_codes_are_small():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64))
    _, code = exact.golomb_encode(values, 0, 1 << 63)
    assert len(code) * 8 / 10_000 < 63 - np.log2(10_000) + 2
