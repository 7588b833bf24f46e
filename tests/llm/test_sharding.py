import itertools
import random
import zlib

import pytest

from polysem.llm import sharding


def plain(sizes, n):
    """Smallest capacity by trying, and the ends of its greedy shards."""

    def ends(capacity):
        out, used, total = [], 0, 0
        for x in sizes:
            if used + x > capacity:
                out.append(total)
                used = 0
            used, total = used + x, total + x
        return [*out, total]

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(ends(mid)) <= n else (mid + 1, high)
    found = ends(low)
    return found + [sum(sizes)] * (n - len(found))


@pytest.mark.parametrize("seed", range(6))
def test_cuts_against_plain_search(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "FIRST_CELLS", 16)
    monkeypatch.setattr(sharding, "FINER", 4)
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 2, 5, rng.randint(1, 5000)]) for _ in range([1, 3, 8, 60, 500, 2000][seed])]
    if seed == 4:
        sizes[100] = 3 * sum(sizes)  # a group larger than all others together
    ends = list(itertools.accumulate(sizes))
    df = spark.createDataFrame([(e,) for e in ends], "upto bigint")
    assert sharding.minimax_cuts(df, ends[-1], max(sizes), 8) == plain(sizes, 8)


def check(rows, got, n):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    total = sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert sorted(r["size"] for r in got) == total
    crcs = sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    assert sorted(r["text_crc32"] for r in got) == crcs
    where = {}
    for r in got:
        assert 0 <= r["shard"] < n and r["grown_shard"] is None and r["law"] == "bytes"
        assert where.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    # The largest shard is as small as any contiguous division allows.
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    order = lambda ids: min(((i is None, i or 0) for i in ids))
    sizes = [len(ids) * (len(t.encode()) + 1) for t, ids in sorted(groups.items(), key=lambda g: order(g[1]))]
    ends = [0, *plain(sizes, n)]
    most = max(b - a for a, b in itertools.pairwise(ends))
    assert max(sum(r["size"] for r in got if r["shard"] == s) for s in range(n)) == most


def test_shards(frame, odd, nothing):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.3 else "é" * rng.randint(0, 40)) for i in rng.sample(range(10_000), 600)]
    check(rows, sharding.shard(frame(rows).repartition(4), 8).collect(), 8)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check([r for r in rows], sharding.shard(odd, 3).collect(), 3)
    assert sharding.shard(nothing, 8).count() == 0
