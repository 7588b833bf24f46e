import random
import tracemalloc

import numpy as np
import pytest

from polysem.llm import chars, minhash


def sets_of(texts):
    text, element, _ = minhash.shingles([t or "" for t in texts])
    out = [set() for _ in texts]
    for t, e in zip(text.tolist(), element.tolist(), strict=True):
        out[t].add(e)
    return out


def plain_shingles(text):
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Smallest id of the class of every row."""
    sets = [plain_shingles(t or "") for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and both >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    ids = {}
    for (i, _), x in zip(rows, label, strict=True):
        ids.setdefault(x, []).append(i)
    best = {x: min((i for i in g if i is not None), default=None) for x, g in ids.items()}
    return sorted(((i, best[x], len(ids[x])) for (i, _), x in zip(rows, label, strict=True)), key=str)


def near_copies(seed):
    """A text, copies with few and with many words changed, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for group in range(6):
        base = [word() for _ in range(rng.choice([6, 40, 120, 300]))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([2, 8, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) + ("." if rng.random() < 0.3 else ""))
    rows += ["a b c", "A  b, c!", "a b d", "x", "", "12"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(2))
def test_classes_against_brute_force(frame, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ELEMENTS", [100_000, 2_000][seed])
    rows = near_copies(seed)
    got = minhash.find(frame(rows).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = minhash.find(odd).collect()
    words = [(i, t) for i, t in rows if plain_shingles(t or "")]
    have = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got if r["n_shingles"]), key=str)
    assert have == brute(words)
    assert all(r["kept"] and r["class_id"] == r["doc_id"] for r in got if not r["n_shingles"])
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert len([t for t in texts if t and t.lower().startswith("one")]) == 1
    assert len([t for t in texts if t and len(t) > 100_000]) == 1
    assert texts.count(None) == 2 and texts.count("other text under the same id") == 1
    assert minhash.keep_one(nothing).count() == 0 and minhash.find(nothing).count() == 0


def test_shingles_agree_with_plain_ones():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aa Bb cé d9 日 e-f".split()) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    plain = [plain_shingles(t) for t in texts]
    found = sets_of(texts)
    for i in range(200):
        assert len(found[i]) == len(plain[i])
        for j in range(0, i, 7):
            assert len(found[i] & found[j]) == len(plain[i] & plain[j])


def test_words_agree_with_plain_ones():
    texts = ["", "Aa bB", "  x", "é\n日本 1a", "ab"]
    points, starts = chars.code_points(texts)
    owner, begin, end, value = chars.words(points, starts)
    shown = [(o, texts[o][b - starts[o] : e - starts[o]]) for o, b, e in zip(owner, begin, end, strict=True)]
    assert shown == [(1, "Aa"), (1, "bB"), (2, "x"), (3, "é"), (3, "日本"), (3, "1a"), (4, "ab")]
    assert all(int(v) == chars.word_hash(w) for (_, w), v in zip(shown, value, strict=True))
    inner, at, _ = chars.inner_grams(points, starts, 2)
    assert [(o, texts[o][b - starts[o] :][:2]) for o, b in zip(inner, at, strict=True)] == [
        (1, "Aa"), (1, "bB"), (3, "日本"), (3, "1a"), (4, "ab"),
    ]


@pytest.mark.parametrize("kind", ["sets", "integers", "fractions", "large"])
def test_signatures_agree_as_often_as_weights_do(kind):
    rng = np.random.default_rng(7)
    element = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    draw = {
        "sets": lambda: (rng.random(300) < 0.7).astype(float), "integers": lambda: rng.integers(0, 5, 300).astype(float),
        "fractions": lambda: rng.uniform(0, 0.02, 300), "large": lambda: rng.uniform(0, 40, 300),
    }[kind]
    a = draw()
    b = np.where(rng.random(300) < 0.6, a, draw())
    found = minhash.dart_minhash(np.repeat([0, 1], 300), np.tile(element, 2), np.concatenate([a, b]), 3, 2048)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 2048)
    assert not found[2].any() and found[:2].all()
    # A signature does not depend on what else is in the batch.
    alone = minhash.dart_minhash(np.zeros(300, int), element, b, 1, 2048)
    assert (alone[0] == found[1]).all()


@pytest.mark.parametrize("members", [1024, 2])
def test_near_pair_in_buckets_that_others_head(spark, frame, members, monkeypatch):
    """Two near copies agree, but in every bucket the picked members are below TIE to both."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", members, raising=False)
    by_pick = [r["id"] for r in spark.range(1, 60).selectExpr("id", "xxhash64(id) h").orderBy("h").collect()]
    near, heads = by_pick[20:22], by_pick[:3] + by_pick[-3:]
    words = [f"w{i}" for i in range(60)]
    texts = {near[0]: " ".join(words), near[1]: " ".join([*words, "end"])}
    code = np.arange(1, minhash.SIZE + 1, dtype="<u2")
    rows = [(i, t, code.copy()) for i, t in texts.items()]
    for k, i in enumerate(heads):
        own = code + np.uint16(1000 * (k + 1))
        part = slice(*[(0, 60), (60, 120), (120, 128)][k % 3])
        own[part] = code[part]
        rows.append((i, f"head {i} has words of its own only", own))
    signed = spark.createDataFrame([(100 + i, i, i, 57, bytearray(c.tobytes())) for i, _, c in rows], minhash.SIGNED)
    docs = frame([(i, t) for i, t, _ in rows])
    keys = {r["doc_id"]: r["row_key"] for r in minhash.keyed(docs, "doc_id", "text").collect()}
    signed = signed.drop("row_key").join(spark.createDataFrame(list(keys.items()), "doc_id bigint, row_key bigint"), "doc_id")
    monkeypatch.setattr(minhash, "signatures", lambda rows: signed.select("row_key", "doc_id", "set_id", "n", "signature"))
    got = {r["doc_id"]: r["class_id"] for r in minhash.find(docs).collect()}
    assert got == {i: min(near) if i in near else i for i in got} and len(got) == 8


@pytest.mark.parametrize("apart", [False, True])
def test_similar_pairs_join_what_brute_force_joins(apart):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(3, 12)), base[:k]])) for k in rng.integers(0, 30, 120)]
    blocks = rng.integers(0, 2, len(sets))
    label = np.arange(len(sets))
    similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    for i in range(len(sets)):
        for j in range(i):
            if (not apart or blocks[i] != blocks[j]) and similar(sets[i], sets[j]):
                label[label == label[i]] = label[j]
    mine = np.arange(len(sets))
    for i, j in minhash.similar_pairs(sets, blocks if apart else None):
        assert similar(sets[i], sets[j]) and mine[i] != mine[j]
        mine[mine == mine[i]] = mine[j]
    assert len({*zip(label.tolist(), mine.tolist(), strict=True)}) == len(set(label.tolist())) == len(set(mine.tolist()))


def test_many_short_texts_of_one_template(frame):
    """20,000 texts in one cluster, of which few are similar: bounded blocks, memory by elements."""
    texts = [f"thank you all for coming to our site n{k}" for k in range(19_900)]
    long = "thank you all for coming to our site again and again on this day of all days"
    texts += [f"{long} n{k}" for k in range(100)]
    sets = [np.array(sorted(s), np.uint64).view(np.int64) for s in sets_of(texts[: 2 * minhash.BLOCK_SETS])]
    tracemalloc.start()
    assert not list(minhash.similar_pairs(sets))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000
    got = {r["doc_id"]: r["class_id"] for r in minhash.find(frame(list(enumerate(texts)))).collect()}
    assert all(got[k] == k for k in range(19_900)) and {got[k] for k in range(19_900, 20_000)} == {19_900}
