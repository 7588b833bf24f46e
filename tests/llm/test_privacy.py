import math
import random
import re

import numpy as np
import pytest

from polysem.llm import privacy, sketch


def plain_base(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [
        (1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(d) for d in re.sub("[^0-9]", "", m[0])][::-1]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [
        (3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15
    ]


def test_base_spans_against_plain_patterns():
    rng = random.Random(0)
    seeds = ["4111 1111 1111 1111", "+1 (555) 010-1234", "b", "x@y.z", "10.0.0.1", "a@b.c.d@e.f", "0000.1.2.3", "4111-1111-1111-1111"]
    for _ in range(20_000):
        text = "".join(rng.choice("ab@.. 0123456789-+()٣é") for _ in range(rng.randint(0, 60)))
        text = text.replace("b", rng.choice(seeds), 1)
        assert privacy.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("part", ["a", "1", "1.", "+1", "a@", "@a", "1 ", ".", "a@b.", "+1("])
def test_base_spans_in_linear_time(part):
    text = part * 60_000
    assert isinstance(privacy.base_spans(text), list)


def fold(word):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in word)


def terms_of(text):
    taken = set()
    for _, a, b in plain_base(text):
        taken.update(range(a, b))
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end].isalnum():
            end += 1
        if end > at and not taken & set(range(at, end)):
            out.append((fold(text[at:end]), at, end))
        at = max(end, at + 1)
    return out


def brute(texts, support, generalise):
    sets = [{t for t, _, _ in terms_of(x)} for x in texts]
    entities = [{privacy.entity(x, s) for s in plain_base(x)} for x in texts]
    share = {}
    for e in set().union(*entities):
        with_e = [s for s, own in zip(sets, entities, strict=True) if e in own]
        for t in set().union(*with_e):
            both, n_t = sum(t in s for s in with_e), sum(t in s for s in sets)
            if len(with_e) >= support and both >= support and len(with_e) < len(texts):
                value = math.log(both * len(texts) / (len(with_e) * n_t)) / math.log(len(texts) / len(with_e))
                share[t] = max(share.get(t, -9), value)
    return {t: v for t, v in share.items() if v >= generalise - 1e-12}


def corpus():
    rng = random.Random(2)
    common = [f"w{i}" for i in range(30)]
    texts = []
    for i in range(120):
        words = [rng.choice(common) for _ in range(25)]
        person = i % 12
        if person < 4:
            words[3] = f"p{person}.x@mail.example.com" if i % 24 != person or person else "w1"
            words[5] = ["Zanzibar", "Acme", "zörnitz", "R2D2"][person]
            if rng.random() < 0.5:
                words[7] = ["10.1.2.3", "+1 (555) 010-1234", "Zanzibar", "acme"][person]
        texts.append(" ".join(words))
    return [*texts, None, "", texts[0], texts[0]]


def test_terms_against_brute_force(frame, monkeypatch):
    texts = corpus()
    rows = list(enumerate(texts))
    want = brute([t or "" for t in texts], 3, 0.8)
    assert {"zanzibar", "acme", "zörnitz", "r2d2"} & set(want)
    for limit in (1 << 20, 2):
        monkeypatch.setattr(privacy, "SLICE_TERMS", limit)
        got = {r["doc_id"]: r for r in privacy.protect(frame(rows, "marks spans term").repartition(3)).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            t = t or ""
            base = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for k, a, b in plain_base(t))
            term = ",".join(f"term:{a}:{b}" for w, a, b in terms_of(t) if w in want)
            assert got[i]["base"] == base and got[i]["spans"] == ",".join(filter(None, [base, term]))
            assert [got[i][f"n_{k}"] for k in privacy.KINDS[:4]] == [sum(x == k for x, _, _ in plain_base(t)) for k in range(4)]
            clean = got[i]["clean"]
            assert not plain_base(clean)
            assert all(w not in want or w in ("name", "term", "code") for w, _, _ in terms_of(clean))


def test_odd_rows(odd, nothing):
    got = privacy.protect(odd, with_text=False)
    assert "clean" not in got.columns and got.count() == odd.count()
    assert privacy.protect(nothing).count() == 0


def test_cleaned_text():
    text = "Call Zoe at +1 (555) 010-1234 or zoe@x.org, code A1"
    spans = [(3, 12, 29, False), (0, 33, 42, False), (4, 5, 8, False), (4, 49, 51, True)]
    assert privacy.cleaned(text, spans) == "Call [NAME] at [PHONE] or [EMAIL], code "
    assert privacy.cleaned("ab", [(2, 0, 2, False), (3, 1, 2, False)]) == "[CARD]"


def test_a_hot_entity(frame, monkeypatch):
    """One address in most of the rows: what only stands with it is disclosing, as of a rare one."""
    rng = random.Random(7)
    rows = [(i, f"mail hot@x.org about w{rng.randrange(9)} thing") for i in range(600)]
    rows += [(1000 + i, "rare@y.org Zanzibar w1") for i in range(5)] + [(2000 + i, f"w{i % 9} alone") for i in range(300)]
    want = brute([t for _, t in rows], 3, 0.8)
    assert set(want) == {"zanzibar", "mail", "about", "thing"}
    for limit in (1 << 20, 0):
        monkeypatch.setattr(privacy, "SLICE_TERMS", limit)
        got = {r["doc_id"]: r["n_term"] for r in privacy.protect(frame(rows).repartition(4), with_text=False).collect()}
        assert got == {i: sum(w in want for w, _, _ in terms_of(t)) for i, t in rows}


def test_bit_table(spark):
    values = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 500)
    table = sketch.bit_table(spark.createDataFrame([(int(v),) for v in values] + [(None,)], "term bigint")).value
    assert sketch.maybe_at(values.view(np.uint64), table).tolist() == list(range(500))
    others = np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64)
    assert len(sketch.maybe_at(others, table)) < 1000
