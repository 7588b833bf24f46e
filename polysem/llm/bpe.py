"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file (base64 token, rank per line) becomes a `tokenizers` model: each
byte is the Latin-1 character of its number, every way in which a token falls
into two shorter tokens becomes a merge, in the order of the ranks. Texts are
encoded in Arrow batches, slice by slice, so that memory does not follow the
size of the batch. Decoding looks the bytes of each id up in the reversed table;
a character whose bytes lie in several tokens is put together again, and the
offsets of all these tokens cover it.

Nulls: a null text is empty. An empty text has no tokens. Repeated rows give
repeated results; other columns pass through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from polysem.llm.chars import release, small, text_slices

# The rank file is sent to the workers; a larger one is refused.
MAX_FILE_BYTES = 64 * 1024 * 1024
# Characters cut into pieces at a time, pieces in one input of the library, and pieces and their characters kept from slice
# to slice (beyond either the table is begun anew, and the one before serves until then).
SLICE_CHARS = 300_000
INPUT_PIECES = 500
KEPT_PIECES, KEPT_CHARS = 50_000, 500_000
# The same of the table of `digests`, which goes on with the pieces that were met most.
TABLE_PIECES, TABLE_CHARS = 120_000, 1_200_000


def shown(token: bytes) -> str:
    """A character for each byte; ASCII stands for itself."""
    return token.decode("latin-1")


def shown_text(text: str) -> str:
    return text if text.isascii() else shown(text.encode())


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file, whose size is checked."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merges(ranks: dict[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """Every split of every token into two tokens, by the rank of the whole."""
    for token in sorted(ranks, key=ranks.get):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                yield token[:i], token[i:]


def _joined(items: pa.Array, starts: np.ndarray) -> Iterator[memoryview]:
    """The bytes of the items from each of `starts` to the next, which stand side by side."""
    ends = np.frombuffer(items.buffers()[1], np.int64, len(items) + 1)[starts].tolist()
    raw = memoryview(items.buffers()[2] or b"")
    return (raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


class Numbers(dict):
    """Pieces, numbered in the order in which they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Table:
    """The ids of the pieces met so far, one after the other, and how often each was met."""

    def __init__(self) -> None:
        self.numbers, self.chars = Numbers(), 0
        self.ids, self.ends, self.times = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.numbers) > TABLE_PIECES or self.chars > TABLE_CHARS

    def often(self) -> Table:
        """A table of the pieces that were met most, at most half of what this may hold."""
        new, room = Table(), TABLE_CHARS // 2
        order = np.argsort(-self.times, kind="stable")[: TABLE_PIECES // 2]
        order = order[self.times[order] > 1]
        names = list(self.numbers)
        order = order[np.cumsum([len(names[i]) for i in order.tolist()], dtype=np.int64) <= room]
        kept = [names[i] for i in order.tolist()]
        new.numbers.update(zip(kept, range(len(kept)), strict=True))
        new.chars, new.times = sum(map(len, kept)), np.zeros(len(kept), np.int64)
        new.ids, ends = self._gathered(order)
        new.ends = np.concatenate(([0], ends))
        return new

    def look_up(self, cut: list[list[str]], encoded: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces of all texts, and for every number of pieces how many ids
        these have; `encoded` gives those of pieces that were not met before."""
        known = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int64)
        if len(self.numbers) > known:
            new = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
            self.chars += sum(map(len, new))
            ids, ends = [self.ids], [self.ends]
            for more, cuts in encoded(new):
                ids.append(more)
                ends.append(cuts + ends[-1][-1])
            self.ids, self.ends = np.concatenate(ids), np.concatenate(ends)
            self.times = np.append(self.times, np.zeros(len(new), np.int64))
        self.times += np.bincount(at, minlength=len(self.times))
        ids, ends = self._gathered(at)
        return ids, np.concatenate(([0], ends))

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.ends[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class Codec:
    """Encoder and decoder of one vocabulary. Texts are cut into the matches of
    the pattern; the library encodes each distinct match of a slice once, many
    at a time, and what it gave is kept for the slices that follow."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer, models

        ranks = parse_ranks(raw)
        model = models.BPE(
            vocab={shown(t): r for t, r in ranks.items()},
            merges=[(shown(a), shown(b)) for a, b in merges(ranks)],
            ignore_merges=True,
            cache_capacity=0,
        )
        self.tokenizer = Tokenizer(model)
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = {i: token.encode("latin-1") for token, i in self.tokenizer.get_vocab().items()}
        self.width = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.width[i] = len(b)
        every = range(len(self.width))
        self.token_bytes = pa.array([self.bytes_of.get(i, b"") for i in every], pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in every], pa.large_binary())
        self.table = Table()
        self.kept: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.kept_chars = 0

    def _encoded(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the pieces, each encoded on its own, and where those of each end:
        many pieces go to the library as words of one input, whose ids are dealt out by
        their bytes."""
        words = [shown_text(p) for p in pieces]
        inputs = [words[i : i + INPUT_PIECES] for i in range(0, len(words), INPUT_PIECES)]
        found = self.tokenizer.encode_batch_fast(inputs, is_pretokenized=True, add_special_tokens=False)
        for some, encoding in zip(inputs, found, strict=True):
            ids = np.array(encoding.ids, np.int32)
            yield ids, np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(w) for w in some])) + 1

    def _ids(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of each piece."""
        for found, ends in self._encoded(pieces):
            ids, cuts = found.tolist(), ends.tolist()
            yield from map(ids.__getitem__, map(slice, [0, *cuts[:-1]], cuts))

    def ids_of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts the ids of all its texts, one after the other, and
        the places at which the texts begin, with the end of all."""
        for _, some in text_slices(texts, SLICE_CHARS):
            cut = [self.pieces(t) for t in some]
            if self.table.full():
                self.table = self.table.often()
            ids, ends = self.table.look_up(cut, self._encoded)
            yield ids, np.concatenate(([0], ends[np.cumsum(list(map(len, cut)))]))

    def hashes(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[str, str]]:
        """Of each text, whose ids begin at `starts`, the SHA-256 of the ids (decimal, joined
        by commas) and of the bytes to which they decode."""
        at = pa.array(ids)
        ends = starts[1:].tolist()
        listed, decoded = (_joined(pc.take(t, at), starts) for t in (self.decimals, self.token_bytes))
        for begin, end, numbers, back in zip(starts.tolist(), ends, listed, decoded, strict=False):
            yield hashlib.sha256(numbers[:-1] if end > begin else b"").hexdigest(), hashlib.sha256(back).hexdigest()

    def pieces_of(self, texts: list[str], entry: Callable) -> Iterator[tuple[list[str], dict]]:
        """For each text its pieces, and a table that gives `entry(piece, ids)`
        of each of them."""
        for _, some in text_slices(texts, SLICE_CHARS):
            cut = [self.pieces(t) for t in some]
            if len(self.kept) > KEPT_PIECES or self.kept_chars > KEPT_CHARS:
                # what is met again is taken over, so frequent pieces stay
                self.kept, self.older, self.kept_chars = {}, self.kept, 0
            kept, older = self.kept, self.older
            missing = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in kept]
            new = [p for p in missing if p not in older]
            kept.update((p, older[p]) for p in missing if p in older)
            kept.update(zip(new, map(entry, new, self._ids(new)), strict=True))
            self.kept_chars += sum(map(len, missing))
            for pieces in cut:
                yield pieces, kept

    def forget(self) -> None:
        """Workers outlive their tasks; what a task kept need not."""
        self.kept, self.older, self.kept_chars = {}, {}, 0
        self.table = Table()

    def forgetting(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches; in the end, also of a failed task, nothing is kept."""
        try:
            yield from batches
        finally:
            self.forget()
            release()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a list of ids. An id outside the vocabulary is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def spans(self, piece: str, ids: list[int]) -> tuple[list[int], list[int], list[int]]:
        """The ids of a piece and the characters of the piece that each covers."""
        char_at = [i for i, c in enumerate(piece) for _ in range(len(c.encode()))]
        ends = np.cumsum(self.width[ids])
        starts = ends - self.width[ids]
        return ids, [char_at[b] for b in starts], [char_at[b - 1] + 1 for b in ends]

    def summary(self, piece: str, ids: list[int]) -> tuple[list[int], str, bytes]:
        """The ids, the ids as text, and the bytes to which they decode."""
        return ids, ",".join(map(str, ids)), self.decode(ids)


@lru_cache(maxsize=2)
def codec(raw: bytes, pattern: str, use: str) -> Codec:
    """One codec for each use, as what it keeps of a piece differs."""
    return Codec(raw, pattern)


def _with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays = [batch.column(i) for i in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays([*arrays, *new.values()], names=[*batch.schema.names, *new])


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Add `ids` and, if asked for, `starts` and `ends`: the code points of the
    text that each token covers, end exclusive. Other columns stay; of the same name
    only the new ones."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    longs = T.ArrayType(T.IntegerType())
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    df = df.drop(*names)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, longs) for n in names]])
    place = df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern, "encode")
        kind = pa.list_(pa.int32())
        for batch in coder.forgetting(small(batches)):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            out: dict[str, list] = {n: [] for n in names}
            for pieces, kept in coder.pieces_of(texts, coder.spans):
                out["ids"].append([i for p in pieces for i in kept[p][0]])
                if offsets:
                    places = list(accumulate(map(len, pieces), initial=0))
                    for name, k in (("starts", 1), ("ends", 2)):
                        out[name].append([at + x for p, at in zip(pieces, places) for x in kept[p][k]])
            yield _with_columns(batch, {n: pa.array(v, kind) for n, v in out.items()})

    return df.mapInArrow(work, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the bytes of `ids`, and `decoded_text`, which has U+FFFD
    where the bytes are no UTF-8 (ids cut inside a character). Null ids: empty.
    Columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    df = df.drop("decoded", "decoded_text")
    new = [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())]
    schema = T.StructType([*df.schema.fields, *new])
    place = df.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern, "decode")
        for batch in small(batches):
            raw = [coder.decode(i or []) for i in batch.column(place).to_pylist()]
            shown = [r.decode("utf-8", "replace") for r in raw]
            yield _with_columns(
                batch, {"decoded": pa.array(raw, pa.binary()), "decoded_text": pa.array(shown, pa.string())}
            )

    return df.mapInArrow(work, schema)


def digests(
    df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per document: number of tokens, SHA-256 of the ids (decimal,
    joined by commas) and of the bytes to which the ids decode, and the ids if
    asked for. The texts do not leave the task."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    rows = df.select(df[key].cast("bigint").alias("doc_id"), df[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern, "digests")
        for batch in coder.forgetting(small(batches)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes, codes, backs, flat = [], [], [], []
            for ids, starts in coder.ids_of(texts):
                sizes.extend(np.diff(starts).tolist())
                for listed, decoded in coder.hashes(ids, starts):
                    codes.append(listed)
                    backs.append(decoded)
                if with_ids:
                    flat.append(ids)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(codes, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                every = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
                arrays, names = [*arrays, pa.ListArray.from_arrays(ends, every)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    ids = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(work, f"doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string{ids}")
