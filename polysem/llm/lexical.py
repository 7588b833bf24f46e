"""Ranked lexical search by the Best Position Algorithm over impact lists.

Terms are runs of 0-9, A-Z, a-z and characters above ASCII, A-Z lower-cased
(compared by 64-bit hashes). N counts the documents with a term, L all terms, n
those of a document, df the documents with a term, tf its occurrences in one. A
term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document's measure is
m = 10 + (90 n N) div L, and its impact in the list of a term is
w ((10^9 tf) div (1000 tf + 8 m)). A score is the sum over the query's terms,
once each; documents above 0 are ranked by score, then id.

`index` reads every text once and writes segments of bounded size: the postings
(term, document, tf) of the terms that a slice of queries has. Totals and df
are summed over all segments. `search` turns the postings of each segment into
impact lists and ranks every query in them: rows of its lists are read in step,
each new document is looked up in all other lists (direct access), and in every
list the best position (the end of the stretch from the top that was seen in
either way) moves on. No unseen document can exceed the sum of the impacts at
the best positions; once that is strictly below the k-th score found, the
segment is done. A task takes the k-th score of a query on to its next segment.
The k best of all segments meet per query in a window.

Bounds: a segment has at most `SEGMENT_DOCS` documents and about
`SEGMENT_POSTINGS` postings (one document may exceed that), a slice of queries
`SLICE_TERMS` terms (one query may exceed that), which is what travels to the
tasks; more queries are more passes. Every task hands on k rows per query.

A null text has no terms and a query without terms has no rows. Rows are their
own documents and queries: a repeated row is ranked as often as it is there.
Documents without an id count in N, L and df, and are not returned. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysem.llm import chars
from polysem.llm.chars import small
from polysem.llm.privacy import found_in
from polysem.session import stored

K = 10
SEGMENT_DOCS = 16_384
SEGMENT_POSTINGS = 2_000_000
SLICE_TERMS = 1 << 20
# Rows of every list read at first between two looks at the threshold; then twice as many each time.
STEP = 8
SEGMENT = "docs bigint, terms bigint, id binary, known binary, length binary, term binary, doc binary, tf binary"


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, item_id, terms): a number, the id and the distinct hashes of each row of
    `queries` (item_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            terms = [np.unique(chars.plain_word_hashes(t or "")).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.tolist() for t in terms], pa.list_(pa.int64()))], names=["query", "item_id", "terms"]
            )

    numbered = queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text")
    return stored(numbered.mapInArrow(work, "query bigint, item_id bigint, terms array<bigint>"), "lexical-queries")


def slices(queries: DataFrame, limit: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Queries with terms in parts of at most `limit` terms: numbers and terms. The driver
    holds one partition of rows and one part at a time."""
    numbers, terms, size = [], [], 0
    for row in queries.where(F.size("terms") > 0).select("query", "terms").toLocalIterator():
        if numbers and size + len(row["terms"]) > limit:
            yield np.array(numbers), terms
            numbers, terms, size = [], [], 0
        numbers.append(row["query"])
        terms.append(np.array(row["terms"], np.int64).view(np.uint64))
        size += len(row["terms"])
    if numbers:
        yield np.array(numbers), terms


class Segment:
    """Documents and their postings while texts are read, or put together from rows."""

    def __init__(self, docs: int, postings: int) -> None:
        self.limits = docs, postings
        self.parts: list[tuple[np.ndarray, ...]] = []  # id, known, length, term, doc, tf
        self.docs = self.postings = 0

    def add(self, ids: np.ndarray, known: np.ndarray, length: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        self.parts.append((ids, known, length, term, doc + np.int32(self.docs), tf))
        self.docs += len(ids)
        self.postings += len(term)

    def full(self) -> bool:
        return self.docs >= self.limits[0] or self.postings >= self.limits[1]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))

    def row(self) -> pa.RecordBatch:
        arrays = self.arrays()
        length = arrays[2]
        values = [pa.array([int((length > 0).sum())]), pa.array([int(length.sum())])] + [pa.array([a.tobytes()], pa.binary()) for a in arrays]
        return pa.RecordBatch.from_arrays(values, names=["docs", "terms", "id", "known", "length", "term", "doc", "tf"])


TYPES = (np.int64, np.bool_, np.int64, np.int32, np.int32, np.int64)


def opened(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in enumerate(TYPES, 2)]


def index(docs: DataFrame, vocabulary) -> DataFrame:
    """Segments of `docs` (doc_id, text) with the postings of the sorted hashes in the
    broadcast `vocabulary`, by place in it."""
    limits = SEGMENT_DOCS, SEGMENT_POSTINGS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        held = Segment(*limits)
        for batch in small(batches):
            known = np.array(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            for start, some in chars.text_slices([t or "" for t in batch.column(1).to_pylist()]):
                owner, _, _, value = chars.plain_words(*chars.code_points(some))
                hit = found_in(value, terms)
                keys, tf = np.unique(owner[hit] * len(terms) + np.searchsorted(terms, value[hit]), return_counts=True)
                part = slice(start, start + len(some))
                held.add(
                    ids[part], known[part], np.bincount(owner, minlength=len(some)).astype(np.int64),
                    (keys % len(terms)).astype(np.int32), (keys // len(terms)).astype(np.int32), tf.astype(np.int64),
                )
                if held.full():
                    yield held.row()
                    held = Segment(*limits)
        if held.docs:
            yield held.row()

    return docs.mapInArrow(work, SEGMENT)


def document_frequency(segments: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(np.frombuffer(cell.as_py(), np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    found = segments.select("term").mapInArrow(work, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def measures(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """10 + (90 n N) div L, also where the product has more than 63 bits."""
    if 90 * int(length.max(initial=0)) * n < 1 << 63:
        return 10 + (90 * n * length) // max(total, 1)
    return np.array([10 + (90 * int(x) * n) // total for x in length], np.int64)


class Lists:
    """The impact lists of one segment."""

    def __init__(self, n_docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        some = np.flatnonzero(impact > 0)
        term, doc, impact = term[some].astype(np.int64), doc[some].astype(np.int64), impact[some]
        order = np.lexsort((doc, -impact, term))
        self.n_docs, self.doc, self.impact = n_docs, doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        # direct access: the place in `doc` of a (term, document)
        key = term[order] * n_docs + self.doc
        self.place = np.argsort(key)
        self.key = key[self.place]

    def lookup(self, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which (list, document) of all exist, and their places."""
        if not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = (terms[:, None] * self.n_docs + docs[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero(self.key[at] == key)
        return hit // len(docs), hit % len(docs), self.place[at[hit]]


def best_positions(lists: Lists, terms: np.ndarray, ids: np.ndarray, k: int, least: int = 0, step: int = STEP, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores, best first, of the k best of one query. Those strictly below
    `least` may be missing. `step` rows of every list are read at first. `trace` is told the documents looked up."""
    terms = terms[lists.start[terms + 1] > lists.start[terms]]
    start, end = lists.start[terms], lists.start[terms + 1]
    base = np.cumsum(end - start) - (end - start)  # where a list begins in `seen`
    seen = np.zeros(int((end - start).sum()) + 1, bool)
    known = np.zeros(lists.n_docs, bool)
    best = np.zeros(len(terms), np.int64)  # seen rows at the top of each list
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, looked = 0, 0
    while len(terms):
        read = [lists.doc[a + depth : min(a + depth + step, b)] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        new = np.unique(np.concatenate(read))
        new = new[~known[new]]
        known[new] = True
        looked += len(new)
        row, col, place = lists.lookup(terms, new)
        seen[place - start[row] + base[row]] = True
        total = np.zeros(len(new), np.int64)
        np.add.at(total, col, lists.impact[place])
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, total])
        order = np.lexsort((ids[docs], -scores))[:k]
        docs, scores = docs[order], scores[order]
        bound, done = 0, True
        for i, (a, b, at) in enumerate(zip(start.tolist(), end.tolist(), base.tolist(), strict=True)):
            here = int(best[i])
            here += int(np.argmin(np.append(seen[at + here : at + b - a], False)))
            best[i] = here
            if here < b - a:
                done = False
                bound += int(lists.impact[a + here - 1])
        kth = max(least, int(scores[-1]) if len(scores) == k else 0)
        if done or bound < kth:
            break
        depth, step = depth + step, step * 2
    if trace is not None:
        trace.append((looked, lists.n_docs))
    return docs, scores


def ranked(segments: DataFrame, weight: np.ndarray, numbers: np.ndarray, places: list[np.ndarray], n: int, total: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of every query in what each task reads."""
    shared = segments.sparkSession.sparkContext.broadcast((weight, numbers, places))
    limits, step = (SEGMENT_DOCS, SEGMENT_POSTINGS), STEP

    def answers(held: Segment, kth: np.ndarray) -> pa.RecordBatch:
        weight, numbers, places = shared.value
        ids, known, length, term, doc, tf = held.arrays()
        m = measures(length, n, total)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        some = known[doc]
        lists = Lists(len(ids), term[some], doc[some], impact[some], len(weight))
        rows = []
        for q, terms in enumerate(places):
            docs, scores = best_positions(lists, terms, ids, k, int(kth[q]), step)
            if len(scores) == k:
                kth[q] = max(kth[q], scores[-1])
            rows.append((np.full(len(docs), numbers[q]), ids[docs], scores))
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "doc_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kth = np.zeros(len(shared.value[1]), np.int64)
        held = Segment(*limits)
        for batch in batches:
            for i in range(batch.num_rows):
                held.add(*opened(batch, i))
                if held.full():
                    yield answers(held, kth)
                    held = Segment(*limits)
        if held.docs:
            yield answers(held, kth)

    return segments.mapInArrow(work, "query bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per query and rank: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    queries = query_terms(items.select(items[item_id].cast("bigint").alias("item_id"), items[item_text].alias("text")))
    found = []
    for numbers, terms in slices(queries, SLICE_TERMS):
        vocabulary = np.unique(np.concatenate(terms))
        segments = stored(index(rows, spark.sparkContext.broadcast(vocabulary)), "lexical-index")
        sums = segments.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("total")).first()
        df = document_frequency(segments, len(vocabulary))
        weight = np.floor(1000 * np.log((2 * sums["n"] + 2) / (2 * df + 1))).astype(np.int64)
        places = [np.searchsorted(vocabulary, t) for t in terms]
        found.append(ranked(segments, weight, numbers, places, sums["n"], sums["total"], k))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
