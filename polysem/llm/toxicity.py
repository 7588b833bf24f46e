"""Toxicity by the nearest labelled examples.

Examples are at most `EXAMPLES` labelled training documents of either class
(the smallest hashes of their ids; equal texts count once), as far as their texts
have no more than `EXAMPLE_CHARS` characters together. Terms are words and `GRAM`
characters within a word, idf is ln((N + 1) / (df + 1)) + 1 over all N documents.
Two indexes hold the examples as TF-IDF vectors of length 1:

* over all terms: neighbours of a cosine of `NEAR_EQUAL` or more, which finds
  texts that nearly equal an example whatever their words;
* over the marks, the terms that stand out in toxic examples: a lift of `MIN_LIFT`
  and a G-squared of 2 ln M, where M is the number of terms that are in as many examples
  or more (as many tests are made, so about one would pass by chance, at any size).

An index has postings (example, weight) by term, cut into blocks of `BLOCK`
examples of similar length, and for each term and block the largest weight. A document
adds up most of its lists; those longest for their weight, up to a norm of `TAIL`, are only bounded: an example
can gain no more than that norm (Cauchy-Schwarz), and no more than the sum of weight times
the maxima of its block. Blocks whose largest partial sum and bound reach what is asked for are
scored whole and exactly, from the largest bound down, until no bound reaches the
`NEIGHBOURS`-th cosine found. So the nearest are exact (ties after rounding to 9 digits: the
first example), and most blocks of the long lists are never looked at.

Lists that are short together are scored whole. Where a cosine of `HIGH` or more is asked for, terms are put into `CELLS`
cells of equal weight, those of the longest
lists for their weight first. The first cells of a document, up to a norm of `LOOSE`, are only bounded: by that norm times
the norm which an example has in the same cells. Examples that can reach the cosine are scored whole from their own
vectors, from the largest bound down, until no bound reaches the `NEIGHBOURS`-th cosine found; the nearest are as exact.

Neighbours of both indexes vote with 1 / (`CLOSE` + distance), times what an example
stands for (the labelled documents of its class per example), and one vote at
full distance for the base rate. An isotonic fit over the examples, each
voted on by the others, turns votes into probabilities. A document without
neighbours has the base rate alone.

Terms, vectors and votes of the examples are made in tasks. What travels through the
driver to the tasks is bounded by the characters of the examples (`EXAMPLE_CHARS`: at most 1.2
postings of 12 bytes for each); documents are read twice, for the idf and to be
scored. A null text is empty. Labels that are null are none; of several labels of
one id the larger counts. Without examples of both classes every score is the share
of toxic labels (0 without any). Repeated rows have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysem.llm import chars
from polysem.llm.chars import small
from polysem.llm.langid import held_out
from polysem.operators.ordering import number_rows
from polysem.session import stored

EXAMPLES, EXAMPLE_CHARS = 4096, 40_000_000
GRAM = 5
NEIGHBOURS = 25
CLOSE, NEAR_EQUAL = 0.05, 0.5
MIN_LIFT = 3.0
# Examples in a block, blocks that are scored at first, norm of the lists that are bounded.
BLOCK, AT_ONCE, TAIL = 32, 8, 0.43
# Cosines from which examples are bounded by their own norms, cells of terms, norm of the cells that are bounded, and
# examples scored at a time.
HIGH, CELLS, LOOSE, SCORED = 0.3, 64, 0.57, 128
ROUNDING = 1e-6


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every term in the texts."""
    points, starts = chars.code_points(texts)
    owner, _, _, word = chars.words(points, starts)
    inner, _, gram = chars.inner_grams(points, starts, GRAM)
    return np.concatenate([owner, inner]), np.concatenate([word, gram])


def chosen_examples(docs: DataFrame, labels: DataFrame, folds: int, fold: int, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """The examples (doc_id, text, toxic, number) and the number of training labels of
    each class. `docs`: doc_id, text; `labels`: doc_id, toxic."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(limit).unionByName(known.where("toxic = 0").orderBy(*order).limit(limit))
    # At most 2 x limit ids.
    met = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    once = met.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    held = stored(once, "examples")
    before = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = held.select("doc_id", "toxic", F.sum(F.length("text")).over(before).alias("upto"))  # at most `limit` rows a class
    kept = held.join(F.broadcast(size.where(F.col("upto") <= EXAMPLE_CHARS // 2).select("doc_id")), "doc_id")
    # equally long examples side by side
    numbered, _ = number_rows(kept, F.length("text"), "doc_id", column="number")
    return numbered, sizes


def example_terms(examples: DataFrame) -> DataFrame:
    """(term, bad, good): in how many examples of either class each term is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for start, some in chars.text_slices(batch.column(0).to_pylist()):
                owner, value = features(some)
                order = np.lexsort((owner, value))
                owner, value = owner[order], value[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                owner, value = owner[new], value[new]
                terms, first = np.unique(value, return_index=True)
                if not len(terms):
                    continue
                bad = np.add.reduceat(toxic[start + owner], first)
                every = np.diff(np.append(first, len(value)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms.view(np.int64)), pa.array(bad), pa.array(every - bad)], names=["term", "bad", "good"]
                )

    counts = examples.select("text", "toxic").mapInArrow(work, "term bigint, bad bigint, good bigint")
    return counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def vocabulary(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of the examples, sorted, and whether they are marks."""
    counts = stored(example_terms(examples), "example-terms")
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = (F.lit(float(max(1, sizes.get(c, 0)))) for c in (1, 0))
    a, b = F.col("bad").cast("double"), F.col("good").cast("double")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    n, both = n1 + n0, a + b
    g2 = 2 * (
        part(a, both * n1 / n) + part(b, both * n0 / n)
        + part(n1 - a, (n - both) * n1 / n) + part(n0 - b, (n - both) * n0 / n)
    )
    lift = (a / n1) / ((b + 0.5) / n0)
    # M of each number of examples: at most one row for every example
    tests = counts.groupBy((F.col("bad") + F.col("good")).alias("df")).agg(F.count("*").alias("n"))
    tests = tests.select("df", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("df"))).alias("m"))
    met = counts.withColumn("df", F.col("bad") + F.col("good")).join(F.broadcast(tests), "df")
    marks = F.coalesce((lift >= MIN_LIFT) & (g2 >= 2 * F.log("m")), F.lit(False))
    terms = met.select("term", marks.alias("marks")).toArrow()
    found = terms["term"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], terms["marks"].to_numpy()[order].astype(bool)


def document_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the terms is. `docs`: text."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in small(batches):
            for _, some in chars.text_slices([t or "" for t in batch.column(0).to_pylist()]):
                total += np.bincount(counted(some, shared.value)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    found = docs.select("text").mapInArrow(work, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(terms), np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def counted(texts: list[str], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place of the term, and count, of the vocabulary's terms in the texts."""
    owner, value = features(texts)
    if not len(value) or not len(terms):
        return owner[:0], owner[:0], owner[:0]
    # Sorted values are looked up side by side, which is several times faster.
    order = np.argsort(value)
    value = value[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    many = np.diff(np.append(first, len(value)))
    at = np.minimum(np.searchsorted(terms, value[first]), len(terms) - 1)
    known = terms[at] == value[first]
    rows = order[np.repeat(known, many)]
    keys, count = np.unique(owner[rows] * len(terms) + np.repeat(at[known], many[known]), return_counts=True)
    return keys // len(terms), keys % len(terms), count


def runs_of(owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)).tolist() if len(owner) else []
    return zip(edges[:-1], edges[1:], strict=True)


def vector_of(cols: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of a text's terms, of length 1."""
    weight = (1 + np.log(counts)) * idf[cols]
    return weight / np.sqrt((weight**2).sum())


def postings(examples: DataFrame, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, number of the example, weight: the vectors of all examples, made in tasks, by term.
    `shared` is a broadcast (terms, idf)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        for batch in small(batches):
            numbers = batch.column(1).to_numpy()
            for start, some in chars.text_slices(batch.column(0).to_pylist()):
                owner, cols, counts = counted(some, terms)
                weight = np.concatenate([np.zeros(0), *(vector_of(cols[i:j], counts[i:j], idf) for i, j in runs_of(owner))])
                arrays = [cols.astype(np.int32), numbers[start + owner].astype(np.int32), weight.astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["term", "number", "weight"])

    table = examples.select("text", "number").mapInArrow(work, "term int, number int, weight float").toArrow()
    term, number, weight = (table[c].to_numpy() for c in ("term", "number", "weight"))
    order = np.argsort(term.astype(np.int64) << 32 | number)
    return term[order], number[order], weight[order]


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Every place of the runs that begin at `start`."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


class Index:
    """Block-max postings of vectors of length 1, sorted by term and number."""

    def __init__(self, term: np.ndarray, number: np.ndarray, weight: np.ndarray, n_terms: int, n: int, block: int = BLOCK) -> None:
        self.number, self.weight, self.n, self.block = number.astype(np.uint16 if n <= 1 << 16 else np.int32), weight, n, block
        self.lists = np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int32)

    def turn(self) -> None:
        """The vector of each example, the cell of each term, and the norm of each example up to each cell."""
        many = np.diff(self.lists)
        term = np.repeat(np.arange(len(many), dtype=np.int32), many)
        square = self.weight.astype(float) ** 2
        mass = np.bincount(term, square, len(many))
        order = np.argsort(-(many.astype(float) ** 2) / np.maximum(mass, 1e-12), kind="stable")
        so_far = np.cumsum(mass[order])
        self.cell = np.empty(len(many), np.uint8)
        self.cell[order] = np.minimum(so_far * CELLS / so_far[-1], CELLS - 1) if len(many) else 0
        place = self.cell[term].astype(np.int64) * self.n + self.number
        parts = np.bincount(place, square, CELLS * self.n).reshape(CELLS, self.n)
        self.norms = np.sqrt(np.cumsum(parts, axis=0)).astype(np.float32)
        order = np.argsort(self.number, kind="stable")
        self.terms_of, self.weights_of = term[order], self.weight[order]
        self.begin = np.searchsorted(self.number[order], np.arange(self.n + 1))
        self.asked = np.zeros(len(many))

    def cut(self) -> None:
        """The blocks and their maxima, which follow from the postings."""
        self.n_blocks = max(1, -(-self.n // self.block))
        of = (self.number // self.block).astype(np.uint16 if self.n_blocks <= 1 << 16 else np.int32)
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        new[self.lists[:-1][np.diff(self.lists) > 0]] = True
        first = np.flatnonzero(new)
        self.of = of[first]
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.first = np.append(first, len(of)).astype(np.int32)
        self.start = np.searchsorted(first, self.lists).astype(np.int32)

    def __getstate__(self) -> dict:
        """Only postings travel; a worker cuts or turns them again."""
        return {c: getattr(self, c) for c in ("number", "weight", "n", "block", "lists")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def nearest(
        self, cols: np.ndarray, weight: np.ndarray, k: int, least: float = 0.0, without: int = -1, trace: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest (ties: the first) of at least `least` and above
        0, leaving one out. `trace` is told the blocks (from `HIGH` on: the examples) that were scored."""
        if least >= HIGH:
            return self._reaching(cols, weight, k, least, without, trace)
        low, size = self.lists[cols].astype(np.int64), self.lists[cols + 1] - self.lists[cols]
        if size.sum() <= self.n:
            return self._all(low, size, weight, k, least, without, trace)
        if not hasattr(self, "first"):
            self.cut()
        long = np.argsort(-size / weight**2, kind="stable")  # most postings for their norm first
        norms = np.cumsum(weight[long] ** 2)
        tail, head = np.split(long, [int(np.searchsorted(norms, TAIL**2))])
        rest = float(np.sqrt(norms[len(tail) - 1])) if len(tail) else 0.0
        place = spans(low[head], size[head])
        partial = np.bincount(self.number[place], np.repeat(weight[head], size[head]) * self.weight[place], self.n)
        least = max(least, 2e-9)
        near, cosine, at = np.zeros(0, np.int64), np.zeros(0), 0
        top = np.maximum.reduceat(partial, np.arange(0, self.n, self.block)) if self.n else partial
        order = np.flatnonzero(top + rest + ROUNDING >= least)
        if len(order):
            start = self.start[cols[tail]].astype(np.int64)
            count = self.start[cols[tail] + 1] - start
            entry = spans(start, count)
            of, own = self.of[entry], np.repeat(weight[tail], count)
            bound = top + np.minimum(np.bincount(of, own * self.most[entry], self.n_blocks), rest) + ROUNDING
            order = order[np.argsort(-bound[order], kind="stable")]
            order = order[bound[order] >= least]
        step = AT_ONCE
        while at < len(order):
            some = np.zeros(self.n_blocks, bool)
            some[order[at : at + step]] = True
            hit = np.flatnonzero(some[of])
            first = self.first[entry[hit]].astype(np.int64)
            count = self.first[entry[hit] + 1] - first
            inner = spans(first, count)
            scores = partial + np.bincount(self.number[inner], np.repeat(own[hit], count) * self.weight[inner], self.n)
            scores = np.round(np.where(np.repeat(some, self.block)[: self.n], scores, 0.0), 9)
            if without >= 0:
                scores[without] = 0
            found = np.flatnonzero(scores >= least)
            near, cosine = np.concatenate([near, found]), np.concatenate([cosine, scores[found]])
            best = np.lexsort((near, -cosine))[:k]
            near, cosine = near[best], cosine[best]
            at, step = at + step, step * 2
            if at < len(order) and len(near) == k and bound[order[at]] < cosine[-1]:
                break
        if trace is not None:
            trace.append((min(at, len(order)), self.n_blocks))
        return near, np.minimum(cosine, 1.0)

    def _all(
        self, low: np.ndarray, size: np.ndarray, weight: np.ndarray, k: int, least: float, without: int, trace: list | None
    ) -> tuple[np.ndarray, np.ndarray]:
        """`nearest` where the lists are short: every example in them is scored."""
        place = spans(low, size)
        scores = np.bincount(self.number[place], np.repeat(weight, size) * self.weight[place], self.n)
        if without >= 0:
            scores[without] = 0
        found = np.flatnonzero(scores)
        cosine = np.round(scores[found], 9)
        found, cosine = found[cosine >= max(least, 2e-9)], cosine[cosine >= max(least, 2e-9)]
        best = np.lexsort((found, -cosine))[:k]
        if trace is not None:
            trace.append((len(np.unique(found // self.block)), -(-self.n // self.block)))
        return found[best], np.minimum(cosine[best], 1.0)

    def _reaching(
        self, cols: np.ndarray, weight: np.ndarray, k: int, least: float, without: int, trace: list | None
    ) -> tuple[np.ndarray, np.ndarray]:
        """`nearest` where few examples reach `least`."""
        if not hasattr(self, "norms"):
            self.turn()
        cell = self.cell[cols]
        norms = np.sqrt(np.cumsum(np.bincount(cell, weight**2, CELLS)))
        tail = int(np.searchsorted(norms, LOOSE))
        head = np.flatnonzero(cell >= tail)
        low, size = self.lists[cols[head]].astype(np.int64), self.lists[cols[head] + 1] - self.lists[cols[head]]
        place = spans(low, size)
        bound = np.bincount(self.number[place], np.repeat(weight[head], size) * self.weight[place], self.n) + ROUNDING
        if tail:
            bound += norms[tail - 1] * self.norms[tail - 1]
        if without >= 0:
            bound[without] = 0
        order = np.flatnonzero(bound >= least)
        order = order[np.argsort(-bound[order], kind="stable")]
        near, cosine, at = np.zeros(0, np.int64), np.zeros(0), 0
        self.asked[cols] = weight
        while at < len(order) and (len(near) < k or bound[order[at]] >= cosine[-1]):
            some = order[at : at + SCORED]
            many = self.begin[some + 1] - self.begin[some]
            place = spans(self.begin[some], many)
            products = self.asked[self.terms_of[place]] * self.weights_of[place]
            scores = np.round(np.bincount(np.repeat(np.arange(len(some)), many), products, len(some)), 9)
            near, cosine = np.concatenate([near, some[scores >= least]]), np.concatenate([cosine, scores[scores >= least]])
            best = np.lexsort((near, -cosine))[:k]
            near, cosine = near[best], cosine[best]
            at += SCORED
        self.asked[cols] = 0
        if trace is not None:
            trace.append((min(at, len(order)), self.n))
        return near, np.minimum(cosine, 1.0)


def isotonic(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step means of `toxic` over sorted `votes` (pool adjacent violators),
    as points to interpolate between."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []
    for v, y, w in zip(votes[order], toxic[order], weight[order], strict=True):
        blocks.append([y * w, w, v * w])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """What the tasks need: vocabulary, both indexes, labels of the examples."""

    def __init__(self, terms: np.ndarray, marks: np.ndarray, idf: np.ndarray, every: Index, marked: Index, toxic: np.ndarray, ids: np.ndarray, sizes: dict[int, int]) -> None:
        self.terms, self.idf, self.every, self.marked, self.toxic, self.ids = terms, idf, every, marked, toxic, ids
        self.mark = np.where(marks, np.cumsum(marks) - 1, -1).astype(np.int32)  # place among the marks
        self.mark_idf = idf[marks]
        have = [int((toxic == c).sum()) for c in (0, 1)]
        self.stands_for = np.array([sizes.get(c, 0) / max(have[c], 1) for c in (0, 1)])[toxic] if len(toxic) else np.zeros(0)
        total = sum(sizes.values())
        self.base = sizes.get(1, 0) / total if total else 0.0

    def votes(self, texts: list[str], without: np.ndarray | None = None) -> Iterator[tuple[int, float, str]]:
        """Number of the text, weighted share of toxic examples, and the three nearest as id:label:cosine, of
        the texts that have neighbours."""
        owner, cols, counts = counted(texts, self.terms)
        prior = self.stands_for.mean() if len(self.stands_for) else 1.0
        for i, j in runs_of(owner):
            text = int(owner[i])
            leave = -1 if without is None else int(without[text])
            own, n = cols[i:j], counts[i:j]
            near, cosine = self.every.nearest(own, vector_of(own, n, self.idf), NEIGHBOURS, NEAR_EQUAL, leave)
            mark = self.mark[own]
            if (mark >= 0).any():
                some = mark[mark >= 0]
                more, closeness = self.marked.nearest(some, vector_of(some, n[mark >= 0], self.mark_idf), NEIGHBOURS, 0.0, leave)
                near, cosine = np.concatenate([near, more]), np.concatenate([cosine, closeness])
            if not len(near):
                continue
            weight = self.stands_for[near] / (CLOSE + 1 - cosine)
            vote = ((weight * self.toxic[near]).sum() + prior * self.base) / (weight.sum() + prior)
            best = np.lexsort((near, -cosine))
            shown = dict.fromkeys((int(near[b]) for b in best), None)
            closest = {int(near[b]): float(cosine[b]) for b in best[::-1]}
            yield text, float(vote), ",".join(f"{self.ids[e]}:{self.toxic[e]}:{closest[e]:.3f}" for e in list(shown)[:3])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, limit: int = EXAMPLES) -> tuple:
    """The broadcast model, and points between which votes become scores.
    `docs`: doc_id, text; `labels`: doc_id, toxic."""
    context = docs.sparkSession.sparkContext
    examples, sizes = chosen_examples(docs, labels, folds, fold, limit)
    terms, marks = vocabulary(examples)
    idf = np.log((docs.count() + 1) / (document_counts(docs, terms) + 1)) + 1
    table = examples.select("number", "doc_id", "toxic").orderBy("number").toArrow()
    toxic, ids = table["toxic"].to_numpy().astype(np.int64), table["doc_id"].to_numpy()
    indexes = []
    for some in (np.ones(len(terms), bool), marks):
        known = context.broadcast((terms[some], idf[some]))
        indexes.append(Index(*postings(examples, known), int(some.sum()), len(ids)))
        known.destroy()
    model = Model(terms, marks, idf, *indexes, toxic, ids, sizes)
    shared = context.broadcast(model)
    if not {0, 1} <= set(toxic.tolist()):
        return shared, np.array([0.0, 1.0]), np.array([model.base, model.base])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            numbers = batch.column(1).to_numpy()
            votes = np.full(len(numbers), shared.value.base)
            for start, some in chars.text_slices(batch.column(0).to_pylist()):
                for at, vote, _ in shared.value.votes(some, numbers[start : start + len(some)]):
                    votes[start + at] = vote
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes)], names=["number", "vote"])

    # sorted here: a sort in Spark computes the votes once more to see their range
    own = examples.select("text", "number").mapInArrow(work, "number bigint, vote double").toArrow().sort_by("number")
    return shared, *isotonic(own["vote"].to_numpy(), toxic.astype(float), model.stands_for)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = EXAMPLES) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence."""
    rows = docs.select(
        docs[text_col].alias("text"), docs[id_col].cast("bigint").alias("doc_id"), held_out(docs[id_col], 3, 1).alias("held_out")
    )
    given = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].alias("toxic"))
    shared, x, y = learn(rows.select("doc_id", "text"), given, limit=limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            votes, shown = np.full(batch.num_rows, model.base), [""] * batch.num_rows
            for start, some in chars.text_slices([t or "" for t in batch.column(0).to_pylist()]):
                for at, vote, near in model.votes(some):
                    votes[start + at], shown[start + at] = vote, near
            scores = np.interp(votes, x, y)
            arrays = [batch.column(1), batch.column(2), pa.array(scores), pa.array((scores >= 0.7).astype(np.int32)), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int, evidence string")
