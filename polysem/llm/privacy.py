"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The
value of each is a protected entity. How strongly a term reveals an entity is
estimated from the documents in which they occur together: the pointwise
mutual information log(n_both x N / (n_entity x n_term)) as a share of what
there is to know, log(N / n_entity). A share of 1 says that whoever reads the
term knows the entity. Terms that occur with an entity in at least `SUPPORT`
documents and whose share reaches `GENERALISE` are replaced by their shape,
from `REMOVE` on they are removed, wherever they occur.

Terms are runs of letters and digits, folded, outside base spans, known by a
64-bit hash. Counts cover all documents: a first pass finds the documents with
entities and the terms of these; a second one counts in how many documents the
candidates occur, handing on the words that a bit table of them does not rule out, which
are joined with the candidates. A third one marks: up to `SLICE_TERMS` terms travel to the
tasks and no text is shuffled; of more terms a bit table does, words and
terms are joined, and the texts with marks meet these by a hash of the row. An entity
in a third of all rows is split over tasks, as both sides of its join are stored.

A null text is empty. Ids may be null or repeated; every row counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysem.llm import chars
from polysem.llm.chars import small
from polysem.llm.sketch import bit_table, maybe_at, maybe_in
from polysem.session import stored

SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
# Hashes sent to the tasks at most.
SLICE_TERMS = 1 << 20
KINDS = ("email", "ip", "card", "phone", "term")

# An address is found at its @ and extended to the left, which takes the same
# spans as a search from the left, in time that follows the text.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # place of the kind in KINDS, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def base_spans(text: str, with_digits: bool = True) -> list[Span]:
    """The base spans by kind, then start."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not with_digits:
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def entity(text: str, span: Span) -> str:
    kind, a, b = span
    value = text[a:b]
    value = value.lower() if kind == 0 else value if kind == 1 else NOT_DIGITS.sub("", value)
    return f"{KINDS[kind]}:{value}"


class Slice:
    """Some texts with their base spans and the words outside of them."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.points, self.starts = chars.code_points(texts)
        digit = np.flatnonzero((self.points >= 48) & (self.points <= 57))
        digits = np.zeros(len(texts) + 1, bool)
        digits[np.searchsorted(self.starts, digit, side="right") - 1] = True
        self.base = [base_spans(t, d) for t, d in zip(texts, digits[:-1].tolist(), strict=True)]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner, begin, end, value = chars.words(self.points, self.starts)
        taken = np.zeros(len(self.points) + 1, np.int32)
        for start, spans in zip(self.starts.tolist(), self.base, strict=False):
            for _, a, b in spans:
                taken[start + a : start + b] = 1
        before = np.concatenate(([0], np.cumsum(taken)))
        free = before[end] == before[begin]
        return owner[free], begin[free], end[free], value[free]


def slices_of(column: pa.Array) -> Iterator[Slice]:
    for _, some in chars.text_slices([t or "" for t in column.to_pylist()]):
        yield Slice(some)


def entity_terms(rows: DataFrame) -> DataFrame:
    """One row per entity of each document: entity, terms (distinct hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for part in slices_of(batch.column(0)):
                hit = [i for i, spans in enumerate(part.base) if spans]
                if not hit:
                    continue
                some = Slice([part.texts[i] for i in hit])
                owner, _, _, value = some.words()
                names, terms = [], []
                for i, spans in enumerate(some.base):
                    mine = np.unique(value[owner == i]).view(np.int64)
                    for name in {entity(some.texts[i], s) for s in spans}:
                        names.append(name)
                        terms.append(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(terms, pa.list_(pa.int64()))], names=["entity", "terms"]
                )

    return rows.select("text").mapInArrow(work, "entity string, terms array<bigint>")


def found_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the values that stand in the sorted table. A bit table of the
    leading bits turns nearly all others away first."""
    if not len(table):
        return np.zeros(0, np.int64)
    bits = min(24, max(12, int(len(table)).bit_length() + 5))
    shift = np.uint64(64 - bits)
    quick = np.zeros(1 << bits, bool)
    quick[table >> shift] = True
    maybe = np.flatnonzero(quick[values >> shift])
    at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    return maybe[table[at] == values[maybe]]


def document_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term: the number of documents with each of the terms."""
    shared = bit_table(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for part in slices_of(batch.column(0)):
                owner, _, _, value = part.words()
                some = maybe_at(value, shared.value)
                order = np.lexsort((owner[some], value[some]))
                owner, value = owner[some][order], value[some][order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                term, n = np.unique(value[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

    counts = rows.select("text").mapInArrow(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counts.join(terms, "term")


def disclosing(rows: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """Terms at or above the threshold: term, share (the largest over all
    entities). `rows` has a column text."""
    n_docs = rows.count()
    pairs = stored(entity_terms(rows), "entities")
    # Written, so that a hot entity on the other side can be split.
    often = stored(pairs.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support), "often")
    both = (
        pairs.join(often, "entity")
        .select("entity", "n_entity", F.explode("terms").alias("term"))
        .groupBy("entity", "n_entity", "term")
        .agg(F.count("*").alias("n_both"))
        .where(F.col("n_both") >= support)
    )
    both = stored(both, "together")
    counts = document_counts(rows, stored(both.select("term").distinct(), "candidates"))
    n = F.lit(float(n_docs))
    known = F.log(n / F.col("n_entity"))
    told = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    share = F.when(known > 0, told / known).otherwise(0.0)
    return (
        both.join(counts, "term")
        .groupBy("term")
        .agg(F.max(share).alias("share"))
        .where(F.col("share") >= generalise)
    )


def shape(word: str) -> str:
    """What a generalised term is replaced by."""
    if any(c.isdigit() for c in word):
        return "[CODE]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def cleaned(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with base spans as their kind, terms generalised or removed.
    Overlapping spans of several kinds are replaced together, as the first."""
    out, at = [], 0
    for kind, a, b, removed in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out.append(text[at:a])
            out.append(("" if removed else shape(text[a:b])) if kind == 4 else f"[{KINDS[kind].upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def marks(part: Slice, terms: np.ndarray, removed: np.ndarray) -> list[list[int]]:
    """For each text start, end and whether to remove, of every word among the terms."""
    owner, begin, end, value = part.words()
    hit = found_in(value, terms)
    gone = removed[np.searchsorted(terms, value[hit])]
    out: list[list[int]] = [[] for _ in part.texts]
    for o, a, b, r in zip(owner[hit].tolist(), begin[hit].tolist(), end[hit].tolist(), gone.tolist(), strict=True):
        first = int(part.starts[o])
        out[o] += (a - first, b - first, int(r))
    return out


COUNTS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_term bigint"


def marks_by_join(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """row_key, marks: start, end and whether to remove, one after the other, of every word of a
    text among the terms. `rows`: row_key, text; `terms`: term, removed."""
    shared = bit_table(terms.select("term"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            before = 0
            for part in slices_of(batch.column(1)):
                owner, begin, end, value = part.words()
                some = maybe_at(value, shared.value)
                first = part.starts[owner[some]]
                keys = batch.column(0).take(pa.array(owner[some] + before))
                arrays = [value[some].view(np.int64), (begin[some] - first).astype(np.int32), (end[some] - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, arrays)], names=["row_key", "term", "start", "end"])
                before += len(part.texts)

    words = rows.mapInArrow(work, "row_key bigint, term bigint, start int, end int")
    # rows that are repeated have equal marks; those of one text are no more than its words
    met = words.join(terms, "term").select("row_key", "start", "end", F.col("removed").cast("int").alias("removed")).distinct()
    flat = F.flatten(F.collect_list(F.array("start", "end", "removed")))
    return met.groupBy("row_key").agg(flat.alias("marks"))


def _finishing(shared, with_text: bool):
    """Counts and spans; terms are those of the broadcast slice, or where there is none the column `marks`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            known = batch.column(2).to_pylist()
            counts, base, every, clean = [], [], [], []
            for part in slices_of(batch.column(1)):
                own = marks(part, *shared.value) if shared else [m or [] for m in known[len(base) : len(base) + len(part.texts)]]
                for text, spans, flat in zip(part.texts, part.base, own, strict=True):
                    term = sorted(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
                    counts.append([*(sum(k == kind for k, _, _ in spans) for kind in range(4)), len(term)])
                    base.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans))
                    every.append(",".join([*filter(None, base[-1:]), *(f"term:{a}:{b}" for a, b, _ in term)]))
                    if with_text:
                        clean.append(cleaned(text, [*((*x, False) for x in spans), *((4, a, b, bool(r)) for a, b, r in term)]))
            numbers = np.array(counts, np.int64).reshape(len(counts), 5)
            arrays = [batch.column(0), *(pa.array(numbers[:, i]) for i in range(5)), pa.array(base, pa.string()), pa.array(every, pa.string())]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_term", "base", "spans"]
            if with_text:
                arrays, names = [*arrays, pa.array(clean, pa.string())], [*names, "clean"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return work


def protect(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
    generalise: float = GENERALISE, remove: float = REMOVE, with_text: bool = True,
) -> DataFrame:
    """One row per document: doc_id, counts, base and all spans (kind:start:end,
    joined by commas), and `clean`, the sanitised text, if asked for."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    terms = stored(disclosing(rows.select("text"), support, generalise), "terms")
    terms = terms.select("term", (F.col("share") >= remove).alias("removed"))
    none = F.expr("cast(null as array<int>)").alias("marks")
    if terms.count() <= SLICE_TERMS:
        table = terms.toArrow()
        values = table["term"].to_numpy().view(np.uint64)
        order = np.argsort(values)
        shared = spark.sparkContext.broadcast((values[order], np.array(table["removed"].to_pylist(), bool)[order]))
        found = rows.select("doc_id", "text", none)
    else:
        shared = None
        keyed = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
        marked = stored(marks_by_join(keyed.select("row_key", "text"), terms), "marks")
        tested = maybe_in(keyed, F.col("row_key"), marked.select("row_key"))
        met = tested.where("_maybe").join(marked, "row_key", "left").select("doc_id", "text", "marks")
        found = met.unionByName(tested.where("not _maybe").select("doc_id", "text", none))
    text = ", clean string" if with_text else ""
    return found.mapInArrow(_finishing(shared, with_text), f"doc_id bigint, {COUNTS}, base string, spans string{text}")
