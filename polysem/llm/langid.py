"""Language proportions of a document by expectation-maximisation.

Every letter gives one n-gram: itself between its neighbours, where whatever is
no letter counts as a space. The n-grams are hashed into `BUCKETS` cells. For
each language the cells are counted over all training documents (combined
within tasks, summed by Spark); smoothed, they are its n-gram likelihoods.

A document is a mixture of languages. Expectation-maximisation over all of them
estimates its proportions, which order the languages. Sets of the first 1, 2, ...
languages are then fitted in turn, and a larger set is taken as long as its
log-likelihood, less `PENALTY` x log(n-grams) for each further language, rises.
Neighbouring n-grams share letters, hence a penalty above one half. Each fit takes
`ROUNDS` rounds, from equal shares or those of the fit before; no test of convergence ends them.

A null text, and one without letters, is `und` with score 0. Documents without
an id can be learnt from and are not held out. Nothing but the text and
`lang` of training rows is used. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.llm.chars import small, text_slices
from polysem.session import fits

BITS = 17
BUCKETS = 1 << BITS
SMOOTHING = 0.05
ROUNDS = 12
PENALTY = 2.0
# How much n-grams that share letters say.
DEPENDENCE = 3.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of the texts the number of its text and its cell."""
    lowered = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[points]
    at = np.flatnonzero(is_letter)
    seen = np.where(is_letter, points, 32).astype(np.uint64)
    mixed = seen[at - 1] * np.uint64(0x9E3779B97F4A7C15)
    mixed += seen[at] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += seen[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    lengths = np.array([len(t) + 1 for t in lowered])
    lengths[:1] += 1
    lengths[-1:] += 1
    owner = np.repeat(np.arange(len(texts)), lengths[: len(texts)])
    return owner[: len(points)][at], (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, cell and count of every distinct (text, cell)."""
    owner, cell = ngrams(texts)
    keys, count = np.unique(owner << BITS | cell, return_counts=True)
    return keys >> BITS, keys & (BUCKETS - 1), count.astype(np.float32)


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-likelihoods (language x cell). `rows`: text, lang."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small(batches):
            langs = batch.column(1).to_pylist()
            for start, texts in text_slices([t or "" for t in batch.column(0).to_pylist()]):
                owner, cell = ngrams(texts)
                for lang in set(langs[start : start + len(texts)]):
                    mine = np.array([x == lang for x in langs[start : start + len(texts)]])
                    found = np.bincount(cell[mine[owner]], minlength=BUCKETS)
                    sums[lang] = sums[lang] + found if lang in sums else found
        for lang, found in sums.items():
            cells = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(found[cells], pa.int64())],
                names=["lang", "cell", "n"],
            )

    counts = rows.where("lang is not null").select("text", "lang").mapInArrow(work, "lang string, cell int, n bigint")
    summed = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(summed["lang"].to_pylist()))
    if not fits(len(names) * BUCKETS, 4):
        raise ValueError(f"{len(names)} languages are too many for a broadcast model")
    place = {x: i for i, x in enumerate(names)}
    table = np.full((len(names), BUCKETS), SMOOTHING)
    table[[place[x] for x in summed["lang"].to_pylist()], summed["cell"].to_numpy()] += summed["n"].to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def fit(shares: np.ndarray, likely: np.ndarray, count: np.ndarray, text: np.ndarray, starts: np.ndarray, rounds: int):
    """Proportions (text x language) after `rounds` of expectation and
    maximisation, and the log-likelihood of each text."""
    total = np.add.reduceat(count, starts)
    for _ in range(rounds):
        parts = shares[text] * likely
        parts *= (count / parts.sum(axis=1))[:, None]
        shares = np.add.reduceat(parts, starts, axis=0) / total[:, None]
    mixture = np.maximum((shares[text] * likely).sum(axis=1), np.float32(1e-30))
    return shares, np.add.reduceat(count * np.log(mixture), starts)


def proportions(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the proportions of the languages in its chosen set (others
    0; all 0 without letters) and how sure the leading language is."""
    return mixtures(texts, logs)[:2]


def mixtures(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the log-likelihood for each n-gram under the chosen set (none:
    minus infinity)."""
    n_langs = len(logs)
    shares_of, sure, fitting = np.zeros((len(texts), n_langs)), np.zeros(len(texts)), np.full(len(texts), -np.inf)
    text, cell, count = counted(texts)
    if not len(text) or not n_langs:
        return shares_of, sure, fitting
    seen, starts = np.unique(text, return_index=True)
    row = np.searchsorted(seen, text)
    log_of = np.ascontiguousarray(logs.T[cell])
    likely = np.exp(log_of)
    single = np.add.reduceat(log_of * count[:, None], starts, axis=0)
    size = np.add.reduceat(count, starts)
    full, _ = fit(np.full((len(seen), n_langs), 1 / n_langs, np.float32), likely, count, row, starts, ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    best = single.argmax(axis=1)
    chosen = np.zeros((len(seen), n_langs))
    chosen[np.arange(len(seen)), best] = 1
    value = single.max(axis=1)
    plain = value.copy()  # without the penalty
    going = np.arange(len(seen))  # texts whose set may still grow
    for k in range(2, n_langs + 1):
        # A second language that has next to nothing of the text cannot pay.
        going = going[full[going, order[going, k - 1]] * size[going] > PENALTY * np.log(size[going] + 1)]
        if not len(going):
            break
        mine = np.isin(row, going)
        sub_row, sub_starts = np.unique(row[mine], return_index=True)
        sub = np.searchsorted(sub_row, row[mine])
        start = np.zeros((len(going), n_langs), np.float32)
        np.put_along_axis(start, order[going, :k], np.take_along_axis(full[going], order[going, :k], 1), 1)
        start /= start.sum(axis=1, keepdims=True)
        shares, fitted = fit(start, likely[mine], count[mine], sub, sub_starts, ROUNDS)
        raw = fitted
        fitted = raw - PENALTY * (k - 1) * np.log(size[going] + 1)
        better = fitted > value[going]
        plain[going[better]] = raw[better]
        chosen[going[better]], value[going[better]] = shares[better], fitted[better]
        going = going[better]
    lead = chosen.argmax(axis=1)
    gap = (single - single[np.arange(len(seen)), lead][:, None]) / DEPENDENCE
    shares_of[seen] = chosen
    sure[seen] = 1 / np.exp(np.minimum(gap, 50)).sum(axis=1)
    fitting[seen] = plain / size
    return shares_of, sure, fitting


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages (the
    chosen set as `lang:proportion`, largest first)."""
    rows = docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"),
        held_out(docs[id_col], 4, 2).alias("held_out"),
    )
    return score(rows.drop("lang"), learn(rows.where("not held_out"))).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "lang_pred", "score", "languages"
    )


def score(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """`rows` (with `text`) without the text, and with lang_pred, score,
    languages and `main_share`, the proportion of the leading language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema.fields)
    return rows.select("text", *others).mapInArrow(
        lambda batches: _scored(batches, *shared.value),
        f"{kinds}, lang_pred string, score double, languages string, main_share double",
    )


def _scored(batches: Iterator[pa.RecordBatch], names: list[str], logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        langs, scores, sets, mains = [], [], [], []
        for _, texts in text_slices([t or "" for t in batch.column(0).to_pylist()]):
            shares, sure = proportions(texts, logs)
            for share, certain in zip(shares, sure.tolist(), strict=True):
                here = sorted(((-p, names[i]) for i, p in enumerate(share.tolist()) if p > 0))
                langs.append(here[0][1] if here else UNKNOWN)
                mains.append(min(1.0, -here[0][0]) if here else 0.0)
                scores.append(mains[-1] * min(1.0, certain))
                sets.append(",".join(f"{x}:{-p:.3f}" for p, x in here))
        arrays = [batch.column(i) for i in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*arrays, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string()), pa.array(mains, pa.float64())],
            names=[*batch.schema.names[1:], "lang_pred", "score", "languages", "main_share"],
        )


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without documents in no known language: those that have no letters, and those
    that the best set of learnt languages explains worse, n-gram by n-gram,
    than a language in which all cells are equally likely. What share a language has does
    not matter, so mixtures of learnt languages stay. Learns from the documents that are
    not held out; where none of them has a language, nothing can be told and all stay."""
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang"), held_out(docs[id_col], 4, 2).alias("_held"))
    names, logs = learn(rows.where("not _held"))
    if not names:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            kept: list[bool] = []
            for _, texts in text_slices([t or "" for t in batch.column(place).to_pylist()]):
                kept += (mixtures(texts, shared.value)[2] >= -np.log(BUCKETS)).tolist()
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
