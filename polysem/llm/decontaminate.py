"""Benchmark passages in documents, by the q-gram lemma.

Texts are compared by their letters and digits in lower case; every run of
anything else is one space. A passage of m characters may differ by up to
`RATE` x m edits, and by no more than leave a quarter of its q-grams. If it occurs with k edits, at least m - q + 1 - kq of its
q-grams occur in the document, and the places of these in the document, less
those in the passage, differ by at most k. So all q-grams of a document that
some passage has are found in a hash table and counted by passage and band of
k + 1 diagonals; each two neighbouring bands overlap with the next two, and
where they hold enough q-grams their region is aligned with the passage within
a band. Nothing else is compared, and no occurrence within the edits is missed.

Passages travel to the tasks in slices of at most `SLICE_CHARS` characters,
each slice in one more pass over the documents. Passages with fewer than q
characters are no evidence and match nothing. Null texts are empty; documents
and passages that are repeated are found as often; passages that repeat id and
text count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysem.llm.chars import SPACE, folding, small, text_slices

Q = 8
RATE = 0.1
SLICE_CHARS = 2_000_000
# Characters of documents worked on at a time.
WORK_CHARS = 300_000
TABLE_BITS = 22
# A key holds text (a slice of `SLICE_ROWS` rows at most), passage (of one slice of the
# benchmark, whose characters bound their number) and band (of a text of up to 2 GB).
BAND_BITS, TEXT_BIT = 33, 54
MIX = np.uint64(0x9E3779B97F4A7C15)


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded characters of all texts one after the other and where each
    came from; where each text begins in these, and where before folding (both
    with the end of all)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    seen = folding()[points]
    space = seen == SPACE
    kept = np.ones(len(seen), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    kept[starts[:-1][sizes > 0]] = True
    origin = np.flatnonzero(kept)
    return seen[origin], origin, np.searchsorted(origin, starts), starts


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q characters in a row: polynomials, where those of
    two halves make that of the whole."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)

    def rolled(n: int) -> np.ndarray:
        if n == 1:
            return chars.astype(np.uint64)
        half = rolled(n // 2)
        size = len(chars) - n + 1
        out = half[:size] * np.uint64(pow(int(MIX), n // 2, 1 << 64))
        out += half[n // 2 :][:size]
        if n % 2:
            out *= MIX
            out += chars[n - 1 :][:size]
        return out

    out = rolled(q)
    out ^= out >> np.uint64(32)
    out *= MIX
    return out


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed in a passage: the rate, as far as a quarter of the q-grams
    must remain (with fewer, any common phrase would call for an alignment)."""
    return max(0, min(int(rate * m), 3 * (m - q + 1) // (4 * q)))


class Passages:
    """Index of some passages: sorted q-gram hashes with passage and place."""

    def __init__(self, ids: list, texts: list[str], q: int, rate: float) -> None:
        self.q = q
        chars, _, starts, _ = folded(texts)
        trimmed = [_trim(chars[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        use = [i for i, c in enumerate(trimmed) if len(c) >= q]
        self.ids = [ids[i] for i in use]
        self.chars = [trimmed[i] for i in use]
        self.edits = np.array([budget(len(c), q, rate) for c in self.chars], np.int64)
        sizes = np.array([len(c) for c in self.chars], np.int64)
        self.least = sizes - q + 1 - self.edits * q
        hashes = [grams(c, q) for c in self.chars]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else owner
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, self.first = np.unique(every[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(every)))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - TABLE_BITS)] = True

    def regions(self, chars: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, passage, first and last diagonal) of neighbouring bands that
        hold enough q-grams; diagonals count from the beginning of all texts."""
        found = grams(chars, self.q)
        at = np.flatnonzero(self.table[found >> np.uint64(64 - TABLE_BITS)])
        # A q-gram that reaches into the next text is none.
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + self.q <= starts[text + 1]
        at, text = at[inside], text[inside]
        slot = np.minimum(np.searchsorted(self.hashes, found[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == found[at]
        at, text, slot = at[same], text[same], slot[same]
        many = self.many[slot]
        ends = np.cumsum(many)
        entry = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - self.first[slot], many)
        owner = self.owner[entry]
        width = self.edits[owner] + 1
        # Diagonals may be negative; the shift is a whole number of bands.
        band = (np.repeat(at, many) - self.place[entry]) // width + (1 << BAND_BITS - 1)
        key = (np.repeat(text, many) << TEXT_BIT) | (owner << BAND_BITS) | band
        keys, count = np.unique(key, return_counts=True)
        nearby = np.zeros(len(keys), np.int64)
        if len(keys):
            nearby[:-1] = np.where(keys[1:] == keys[:-1] + 1, count[1:], 0)
        owner = (keys >> BAND_BITS) & ((1 << TEXT_BIT - BAND_BITS) - 1)
        good = np.flatnonzero(count + nearby >= self.least[owner])
        # Bands that hold enough only with the band before them are met there.
        for k in good:
            o = int(owner[k])
            first = (int(keys[k] & ((1 << BAND_BITS) - 1)) - (1 << BAND_BITS - 1)) * int(self.edits[o] + 1)
            yield int(keys[k] >> TEXT_BIT), o, first, first + 2 * int(self.edits[o] + 1) - 1

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, passage, start, end, edits), places in code points of the text."""
        if not self.ids:
            return
        chars, origin, starts, before = folded(texts)
        best: dict[tuple[int, int], list] = {}
        for text, o, first, last in self.regions(chars, starts):
            a, b = int(starts[text]), int(starts[text + 1])
            k, passage = int(self.edits[o]), self.chars[o]
            low = max(a, first - k)
            high = min(b, last + k + len(passage))
            hit = occurrence(passage, chars[low:high], k, first - k - low, last + k - low)
            if hit:
                start, end, cost = hit
                best.setdefault((text, o), []).append((low + start, low + end, cost))
        for (text, o), hits in best.items():
            end_before = -1
            for start, end, cost in sorted(hits, key=lambda h: (h[1], h[2], h[0])):
                if start < end_before:
                    continue
                end_before = end
                yield text, o, int(origin[start] - before[text]), int(origin[end - 1] - before[text]) + 1, cost


def _trim(chars: np.ndarray) -> np.ndarray:
    solid = np.flatnonzero(chars != SPACE)
    return chars[solid[0] : solid[-1] + 1] if len(solid) else chars[:0]


def banded(passage: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool) -> np.ndarray:
    """Edit distances of the passage to the texts that end at the diagonals from
    `low` to `high`. They may begin anywhere, or only at 0 if `anchored`."""
    width = high - low + 1
    step = np.arange(width)
    far = len(passage) + len(text) + 1
    padded = np.zeros(len(passage) + width + max(0, high) + len(text) + 2, np.uint32)
    shift = max(0, -low)
    padded[shift : shift + len(text)] = text
    ends = step + low  # characters of the text used so far
    row = np.where((ends >= 0) & (ends <= len(text)), ends if anchored else 0, far)
    for i, c in enumerate(passage):
        ends = step + (low + i + 1)
        here = padded[max(0, low + i + shift) :][:width] if low + i + shift >= 0 else padded[:width]
        kept = row + (here != c)
        kept = np.where(ends >= 1, kept, far)
        kept[:-1] = np.minimum(kept[:-1], row[1:] + 1)
        kept = np.minimum.accumulate(kept - step) + step
        row = np.where((ends >= 0) & (ends <= len(text)), kept, far)
    return row


def occurrence(passage: np.ndarray, text: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the closest occurrence with up to k edits whose
    diagonals lie between `low` and `high`."""
    m = len(passage)
    exact = text.tobytes().find(passage.tobytes())
    while exact >= 0 and exact % 4:
        exact = text.tobytes().find(passage.tobytes(), exact + 1)
    if exact >= 0:
        return exact // 4, exact // 4 + m, 0
    low, high = max(low, -k), min(high, len(text) - m + k)
    if high < low:
        return None
    row = banded(passage, text, low, high, False)
    at = int(row.argmin())
    cost, end = int(row[at]), m + low + at
    if cost > k:
        return None
    back = banded(passage[::-1], text[:end][::-1], -k, k, True)
    start = end - (m - k + int(np.flatnonzero(back == back.min())[0]))
    return start, end, cost


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE,
) -> DataFrame:
    """One row per occurrence: doc_id, item_id, start, end (code points of the
    document, end exclusive), edits."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    items = benchmark.select(
        benchmark[item_id].cast("bigint").alias("item_id"), F.coalesce(benchmark[item_text], F.lit("")).alias("text")
    ).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_slices = max(1, -(-total // (SLICE_CHARS // 2)))
    found = []
    for s in range(n_slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == s)
        table = part.orderBy("item_id", "text").toArrow()
        shared = spark.sparkContext.broadcast((table["item_id"].to_pylist(), table["text"].to_pylist(), q, rate))
        found.append(rows.mapInArrow(_finder(shared), "doc_id bigint, item_id bigint, start int, end int, edits int"))
    return reduce(DataFrame.unionByName, found)


def _finder(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Passages(*shared.value)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hits = [(start + h[0], *h[1:]) for start, some in text_slices(texts, WORK_CHARS) for h in index.find(some)]
            ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
            arrays = [pa.array([h[i] for h in hits], pa.int32()) for i in (2, 3, 4)]
            items = pa.array([index.ids[h[1]] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, items, *arrays], names=["doc_id", "item_id", "start", "end", "edits"])

    return work


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """`docs` without the documents in which a passage occurs. Passages of one
    slice are looked for in one narrow pass that keeps all columns."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_slices = max(1, -(-total // (SLICE_CHARS // 2)))
    place = docs.columns.index(text_col)
    for s in range(n_slices):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == s).toArrow()
        shared = spark.sparkContext.broadcast((table["item_id"].to_pylist(), table["text"].to_pylist(), q, rate))
        docs = docs.mapInArrow(_cleaner(shared, place), docs.schema)
    return docs


def _cleaner(shared, place: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Passages(*shared.value)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            kept = np.ones(len(texts), bool)
            for start, some in text_slices(texts, WORK_CHARS):
                kept[[start + h[0] for h in index.find(some)]] = False
            yield batch.filter(pa.array(kept))

    return work
