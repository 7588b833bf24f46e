"""Skip-gram windows and pairs, built inside the sentence row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.operators.corpus import pieces


def _around(items: Column, pos: Column, window: int) -> Column:
    first = F.greatest(pos - window, F.lit(0))
    return F.slice(items, first + 1, pos + window + 1 - first)


def context_windows(sentences: DataFrame, window: int, **sliced: str) -> DataFrame:
    """One row per position: doc_id, line, pos, first_pos (position of the first
    element of the slices) and for every `name=column` the slice of that column
    around the position. Only the slices leave the sentence row, so a very long
    line is not copied once per token."""
    items = {name: F.col(column) for name, column in sliced.items()}
    lead = next(iter(sliced.values()))

    def cell(_: Column, pos: Column) -> Column:
        slices = [_around(c, pos, window).alias(name) for name, c in items.items()]
        return F.struct(pos.alias("pos"), F.greatest(pos - window, F.lit(0)).alias("first_pos"), *slices)

    cells = sentences.select("doc_id", "line", F.explode(F.transform(lead, cell)).alias("c"))
    return cells.select("doc_id", "line", "c.*")


def _near(batches: Iterable[pa.RecordBatch], window: int, column: str) -> Iterator[tuple]:
    """Of bounded numbers of tokens: keys of each, position, number, neighbours of each as a
    mask over the offsets, and the places of the neighbours in order."""
    offsets = np.array([d for d in range(-window, window + 1) if d], np.int64)
    for table in pieces(batches, column):
        lists = table[column].combine_chunks()
        lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy()
        sentence = np.repeat(np.arange(len(lengths)), lengths)
        pos = np.arange(len(sentence)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = pos[:, None] + offsets
        near = (at >= 0) & (at < lengths[sentence][:, None])
        places = (np.arange(len(sentence))[:, None] + offsets)[near]
        keys = [table[c].combine_chunks().take(pa.array(sentence)) for c in ("doc_id", "line")]
        yield keys, pos.astype(np.int32), lists.flatten(), near, places


def _types(sentences: DataFrame, column: str) -> tuple[str, str]:
    keys = ", ".join(f"{c} {sentences.schema[c].dataType.simpleString()}" for c in ("doc_id", "line"))
    return keys, sentences.schema[column].dataType.elementType.simpleString()


def skipgram_pairs(sentences: DataFrame, window: int, column: str = "ids") -> DataFrame:
    """All (pos, ctx_pos) within `window` of each other in a sentence."""

    def run(batches):
        for keys, pos, items, near, places in _near(batches, window, column):
            centre, context = pa.array(np.nonzero(near)[0]), pa.array(places)
            parts = [*(k.take(centre) for k in keys), pa.array(pos).take(centre), pa.array(pos).take(context)]
            yield pa.RecordBatch.from_arrays([*parts, items.take(centre), items.take(context)], names=names)

    names = ["doc_id", "line", "pos", "ctx_pos", "word_id", "ctx_id"]
    keys, item = _types(sentences, column)
    schema = f"{keys}, pos int, ctx_pos int, word_id {item}, ctx_id {item}"
    return sentences.select("doc_id", "line", column).mapInArrow(run, schema)


def context_window(sentences: DataFrame, window: int, column: str = "ids") -> DataFrame:
    """Per position the neighbours within the window as one list."""

    def run(batches):
        for keys, pos, items, near, places in _near(batches, window, column):
            ends = np.concatenate(([0], np.cumsum(near.sum(axis=1))))
            others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items.take(pa.array(places)))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(pos), items, others], names=names)

    names = ["doc_id", "line", "pos", "word_id", "context"]
    keys, item = _types(sentences, column)
    return sentences.select("doc_id", "line", column).mapInArrow(run, f"{keys}, pos int, word_id {item}, context array<{item}>")


def expand_senses(tokens: DataFrame) -> DataFrame:
    """Every row once per candidate sense of its word (needs n_senses)."""
    return tokens.withColumn("sense", F.explode(F.sequence(F.lit(0), F.col("n_senses") - 1)))
