import math
import random
import re
from collections import Counter

import pytest

from polysem.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(texts, templates):
    """Every place tried, every phrase compared word by word."""
    bags = [words(t) for t in texts]
    df = Counter(w for b in bags for w in set(b))
    idf = lambda w: math.log(1 + len(texts) / (1 + df[w]))
    out = []
    for own in bags:
        found = []
        for t in templates:
            whole = words(t.text)
            phrases = [words(p) for p in t.phrases or (t.text,)]
            at = [next(i for i in range(len(whole)) if whole[i : i + len(p)] == p) for p in phrases]
            begins = [[i for i in range(len(own)) if own[i : i + len(p)] == p] for p in phrases]
            for b in begins[0]:
                offsets = [b - at[0]]
                for k in range(1, len(phrases)):
                    near = [x - at[k] for x in begins[k]]
                    if near:
                        offsets.append(min(near, key=lambda x: (abs(x - offsets[0]), x)))
                if len(offsets) < len(phrases) or any(abs(o - offsets[0]) > licenses.SLACK for o in offsets):
                    continue
                have = 0.0
                for i, w in enumerate(whole):
                    gaps = [max(0, at[k] - i, i - at[k] - len(p) + 1) for k, p in enumerate(phrases)]
                    place = offsets[gaps.index(min(gaps))] + i
                    have += idf(w) * (0 <= place < len(own) and own[place] == w)
                share = min(1.0, have / sum(map(idf, whole)))
                if t.base or share >= licenses.LEAST:
                    found.append((b, t.label, share, t.base))
        base = [b for b, _, _, is_base in found if is_base]
        labels = lambda some: ",".join(sorted(set(some)))
        out.append((
            len(own), len(base), min(base, default=None), max(base, default=None), labels(x[1] for x in found if x[3]),
            labels(x[1] for x in found), round(max((x[2] for x in found), default=0.0), 9),
        ))
    return out


def row(r):
    return (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [w for t in licenses.TEMPLATES for w in t.text.split()] + "eins zwei drei quatro ünï".split() * 8
    out = []
    for _ in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
            t = rng.choice(licenses.TEMPLATES).text.split()
            for _ in range(rng.choice([0, 0, 1, 3])):  # edits
                i = rng.randrange(len(t))
                t[i : i + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                t = t or ["mit"]
            text += t
        out.append("".join(w.upper() + rng.choice(" .-\n,") if rng.random() < 0.2 else w + rng.choice([" ", " ", ", ", "\n"]) for w in text))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_every_place(spark, frame, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: row(r) for r in licenses.scan(frame(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, licenses.TEMPLATES)


def test_notices(spark, frame):
    texts = [
        "Released under the MIT License.", "the mit\n-- license; MIT LICENSE", "omit license, mit licenses",
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Redistribution and use in source and binary forms, with and without modification, are permitted if the following conditions are met:",
        "Der Hund kam mit Lizenz.",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(frame(list(enumerate(texts)))).collect()}
    labels = [got[i]["labels"].split(",") for i in range(len(texts))]
    assert labels == [
        ["mit", "mit-notice"], ["mit"], [""], ["cc-by-nc-4.0"], ["gpl", "gpl-3.0"], ["apache", "apache-2.0", "apache-2.0-text"], ["bsd-text"], [""],
    ]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 1, 3)
    assert 0.5 <= got[6]["score"] < 1 and got[7]["score"] == 0 and got[7]["first_word"] is None


def test_phrases_do_not_cross_texts(spark, frame):
    got = licenses.scan(frame([(1, "under the mit"), (2, "license here"), (3, "apache"), (4, "license mit")])).collect()
    assert all(r["n_base"] == 0 and r["labels"] == "" for r in got)


def test_a_very_long_text(spark, frame):
    text = ("general public license " * 30_000) + "x " * 400_000 + "mit license"
    r = licenses.scan(frame([(1, text)])).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (30_001, 0, 490_000, 490_002)


def test_odd_rows(spark, odd, nothing):
    rows = odd.collect()
    got = licenses.scan(odd).collect()
    assert sorted(map(row, got), key=str) == sorted(plain([r["text"] for r in rows], licenses.TEMPLATES), key=str)
    assert licenses.scan(nothing).count() == 0
