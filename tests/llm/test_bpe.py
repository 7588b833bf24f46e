import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from polysem.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_pieces_agree_with_tiktoken(plain):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh   ''étñ\n\t.%1234日🙂́") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [c * rng.randint(1, 400) for c in "ab1 -\n=é" for _ in range(20)]
    coder = bpe.codec(bpe.read_ranks(PATH), PATTERN, "test")
    for text, (pieces, kept) in zip(texts, coder.pieces_of(texts, coder.summary), strict=True):
        ids = [i for p in pieces for i in kept[p][0]]
        assert ids == plain(text)
        assert coder.decode(ids) == text.encode()


def test_every_code_point(plain):
    chars = [chr(i) for i in range(0, 0x110000, 7) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c} b{c}1 {c}" for c in chars]
    coder = bpe.codec(bpe.read_ranks(PATH), PATTERN, "test")
    for text, (pieces, kept) in zip(texts, coder.pieces_of(texts, coder.summary), strict=True):
        assert [i for p in pieces for i in kept[p][0]] == plain(text)


def test_offsets_cover_split_characters(spark, frame):
    out = bpe.encode(frame([(1, "é日🙂 áb"), (2, ""), (3, None)], "ids"), PATH, PATTERN)
    rows = {r["doc_id"]: r for r in out.collect()}
    text, r = "é日🙂 áb", rows[1]
    assert rows[2]["ids"] == rows[3]["ids"] == []
    coder = bpe.codec(bpe.read_ranks(PATH), PATTERN, "test")
    at = 0
    for token, start, end in zip(r["ids"], r["starts"], r["ends"], strict=True):
        size = len(coder.bytes_of[token])
        # The span is the smallest run of characters that has all bytes of the token.
        assert len(text[:start].encode()) <= at and at + size <= len(text[:end].encode())
        assert len(text[: start + 1].encode()) > at and len(text[: end - 1].encode()) < at + size
        at += size
    assert at == len(text.encode())


def test_round_trip_and_cut_ids(spark, odd):
    back = bpe.decode(bpe.encode(odd, PATH, PATTERN, offsets=False), PATH, PATTERN)
    for r in back.collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "") == r["decoded_text"]
    ids = bpe.encode(spark.createDataFrame([("🙂🙃",)], "text string"), PATH, PATTERN).first()["ids"]
    assert len(ids) > 2
    cut = bpe.decode(spark.createDataFrame([(ids[:1],), (None,)], "ids array<int>"), PATH, PATTERN).collect()
    assert "�" in cut[0]["decoded_text"] and cut[1]["decoded_text"] == ""


def test_digests(plain, odd, nothing):
    for r in bpe.digests(odd.where("doc_id = 1 or doc_id = 3 or doc_id = 9"), PATH, PATTERN, with_ids=True).collect():
        text = {1: "One two three four five six seven eight.", 3: "", 9: "x" * 50_000}[r["doc_id"]]
        ids = plain(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(odd, PATH, PATTERN).count() == odd.count()
    assert bpe.digests(nothing, PATH, PATTERN, with_ids=True).count() == 0
    assert bpe.encode(nothing, PATH, PATTERN).count() == 0


def test_kept_pieces_are_begun_anew(monkeypatch, plain):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 10)
    coder = bpe.Codec(bpe.read_ranks(PATH), PATTERN)
    texts = ["one two three", "two three four", "", "one one one five"] * 3
    found = [[i for p in pieces for i in kept[p][0]] for pieces, kept in coder.pieces_of(texts, coder.summary)]
    assert found == [plain(t) for t in texts]


def test_frequent_pieces_are_encoded_once(plain, monkeypatch):
    """A full table is begun anew, but what is met again is taken over."""
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 80)
    texts = [f"the of and rare{i}word some{i} other{i}s the" for i in range(200)]
    coder, seen = bpe.Codec(bpe.read_ranks(PATH), PATTERN), []
    ids_of = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda pieces: seen.extend(pieces) or ids_of(pieces))
    for text, (pieces, kept) in zip(texts, coder.pieces_of(texts, coder.summary), strict=True):
        assert [i for p in pieces for i in kept[p][0]] == plain(text)
        assert len(kept) < 60
    assert seen.count(" of") == seen.count(" the") == 1


def test_ids_of_whole_slices(plain, monkeypatch):
    """Slices are looked up, listed and decoded as a whole; what is met most outlives a full table."""
    monkeypatch.setattr(bpe, "TABLE_PIECES", 30)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 80)
    texts = ["", "x", "", *[f"the of and rare{i}word some{i} é日🙂{i} the" for i in range(150)], "y" * 300, ""]
    coder, seen = bpe.Codec(bpe.read_ranks(PATH), PATTERN), []
    encoded = coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda pieces: seen.extend(pieces) or encoded(pieces))
    found = []
    for ids, starts in coder.ids_of(texts):
        each = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        found += zip(each, coder.hashes(ids, starts), strict=True)
        assert len(coder.table.numbers) < 90
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert found == [(plain(t), (sha(",".join(map(str, plain(t))).encode()), sha(t.encode()))) for t in texts]
    assert seen.count(" of") == seen.count(" the") == 1
    assert list(coder.ids_of([])) == []
    assert [s.tolist() for _, s in coder.ids_of(["", ""])] == [[0, 0, 0]]
    assert len(list(coder.hashes(*next(coder.ids_of(["", ""]))))) == 2
