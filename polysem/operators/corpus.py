"""From text to sentences of word-sense codes.

A sentence is one line of one document, keyed by (doc_id, line). Sentences stay
array rows: cleaning, encoding and windowing never shuffle tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.functions import text as tx
from polysem.functions.hashing import uniform
from polysem.operators.joins import lookup_join
from polysem.session import fits

# Packing of a word and its sense into one number.
ENCODE = 100
# Bytes a vocabulary entry takes where it is joined (string, number, hash table), and in a
# Python worker that looks words up (string, number, place).
VOCAB_ROW_BYTES, ENTRY_BYTES = 160, 64
# Tokens of streamed sentences that are worked on at a time.
PIECE = 1 << 17


def pieces(batches: Iterable[pa.RecordBatch], column: str, tokens: int = PIECE) -> Iterator[pa.Table]:
    """The sentences in tables of at most so many tokens; a longer sentence stands alone."""
    kept, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(batch.column(column).value_lengths(), 0).to_numpy())
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = int(np.searchsorted(ends, before + tokens - n, side="right"))
            if last <= first and not kept:
                last = first + 1
            if last > first:
                kept.append(batch.slice(first, last - first))
                n += int(ends[last - 1] - before)
                first = last
            if first < len(ends):
                yield pa.Table.from_batches(kept)
                kept, n = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row per line: doc_id, line, text."""
    return documents.select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line", "text"))


def tokenize(lines: DataFrame) -> DataFrame:
    """Split on single spaces; empty tokens are still there."""
    return lines.select("doc_id", "line", F.posexplode(tx.tokens(F.col("text"))).alias("raw_pos", "raw"))


def clean_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("word", tx.clean(F.col("raw"))).where(F.col("word") != "").drop("raw")


def word_sentences(lines: DataFrame) -> DataFrame:
    """One row per line with all its cleaned words in order."""
    return lines.select("doc_id", "line", tx.words(F.col("text")).alias("words"))


def drop_empty(sentences_: DataFrame, column: str = "ids") -> DataFrame:
    return sentences_.where(F.size(column) > 0)


def _dictionary_lookup(entries, batches):
    """Replace the words of every list by their ids; unknown words vanish. The words stay
    two Arrow columns: a Python dictionary takes several times their size. They are looked up
    among the distinct words of a piece, so no table of the whole vocabulary is built."""
    words, numbers = entries.value
    for table in pieces(batches, "words", 4 * PIECE):
        batch = table.combine_chunks().to_batches()[0]
        lists = batch.column("words")
        flat = lists.flatten().dictionary_encode()
        place = pc.index_in(words, value_set=flat.dictionary)
        number, known = np.zeros(len(flat.dictionary), np.int32), np.zeros(len(flat.dictionary), bool)
        at = place.drop_null().to_numpy()
        number[at[::-1]] = numbers.filter(place.is_valid()).to_numpy()[::-1]  # the first of equal words
        known[at] = True
        ids = pc.take(pa.array(number, mask=~known), flat.indices)
        keep = ids.is_valid()
        kept_before = pc.cumulative_sum(pc.cast(keep, pa.int32()))
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0))
        kept_before = pa.concat_arrays([pa.array([0], pa.int32()), kept_before])
        offsets = pc.take(kept_before, pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(ends, pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("line"), pa.ListArray.from_arrays(offsets, pc.filter(ids, keep))],
            names=["doc_id", "line", "ids"],
        )


def encode_by_dictionary(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Look words up in a dictionary held by every worker: no shuffle."""
    spark = words.sparkSession
    entries = vocab.select("word", "word_id").toArrow().combine_chunks()
    columns = [pa.concat_arrays(entries[c].chunks) if entries.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("word_id", pa.int32()))]
    shared = spark.sparkContext.broadcast(columns)
    return words.mapInArrow(
        lambda batches: _dictionary_lookup(shared, batches), "doc_id bigint, line int, ids array<int>"
    )


def encode_by_join(words: DataFrame, vocab: DataFrame, vocab_rows: int) -> DataFrame:
    """Same result for a vocabulary of any size: join and regroup by sentence.
    A group is one line of text, which was one row before."""
    tokens = words.select("doc_id", "line", F.posexplode("words").alias("raw_pos", "word"))
    found = lookup_join(tokens, vocab.select("word", "word_id"), ["word"], vocab_rows, VOCAB_ROW_BYTES)
    ordered = F.sort_array(F.collect_list(F.struct("raw_pos", "word_id")))
    return found.groupBy("doc_id", "line").agg(
        F.transform(ordered, lambda s: s["word_id"].cast("int")).alias("ids")
    )


def encode(words: DataFrame, vocab: DataFrame, vocab_rows: int) -> DataFrame:
    """Word sentences -> (doc_id, line, ids): words outside the vocabulary are
    dropped, positions close up, empty sentences go."""
    if fits(vocab_rows, ENTRY_BYTES):
        return drop_empty(encode_by_dictionary(words, vocab))
    return encode_by_join(words, vocab, vocab_rows)


def pack(word_id: Column, sense: Column) -> Column:
    return (word_id.cast("bigint") * ENCODE + sense).cast("bigint")


def word_of(code: Column) -> Column:
    return F.floor(code / ENCODE).cast("int")


def sense_of(code: Column) -> Column:
    return (code % ENCODE).cast("int")


def sense_number(word_id: Column, cuts: list[int]) -> Column:
    """Number of senses of a word. Ids are ranks by count, so this needs no
    look-up: the words with at least s senses are exactly ids below cuts[s-2]."""
    n = F.lit(1)
    for bound in cuts:
        n = n + F.when(word_id < F.lit(bound), 1).otherwise(0)
    return n


def random_senses(encoded: DataFrame, cuts: list[int], seed: int) -> DataFrame:
    """Give every token a random sense: (doc_id, line, codes)."""

    def code(word: Column, pos: Column) -> Column:
        n = sense_number(word, cuts)
        u = uniform(seed, "sense", F.col("doc_id"), F.col("line"), pos)
        return pack(word, F.when(n > 1, F.floor(u * n)).otherwise(F.lit(0)))

    return encoded.select("doc_id", "line", F.transform("ids", code).alias("codes"))


def _tagged_text(names, batches):
    for table in pieces(batches, "codes"):
        lists = table.combine_chunks()["codes"].chunk(0)
        codes = lists.flatten().to_numpy()
        senses = pc.cast(pa.array(codes % ENCODE), pa.string())
        keys = pc.binary_join_element_wise(pc.take(names.value, pa.array(codes // ENCODE)), senses, tx.KEY_SEPARATOR)
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys), " ")
        yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("doc_id", "line")), text], names=["doc_id", "line", "text"])


def tagged(coded: DataFrame, vocab: DataFrame, vocab_rows: int, repeated: DataFrame | None = None) -> DataFrame:
    """Sentences as text again, every token written `word_sense`. Where every worker can
    hold the words nothing is shuffled, but for sentences of the documents in `repeated`
    (doc_id): those that occur several times, whose lines of one number are one sentence."""
    if not fits(vocab_rows, VOCAB_ROW_BYTES) or not vocab_rows:
        return _tagged_by_join(coded, vocab, vocab_rows)
    words = vocab.select("word_id", "word").toArrow().sort_by("word_id")["word"].combine_chunks()
    names = coded.sparkSession.sparkContext.broadcast(words)
    once = coded if repeated is None else coded.join(repeated, "doc_id", "left_anti")
    texts = once.select("doc_id", "line", "codes").mapInArrow(lambda batches: _tagged_text(names, batches), "doc_id bigint, line int, text string")
    if repeated is None:
        return texts
    return texts.unionByName(_tagged_by_join(coded.join(repeated, "doc_id", "left_semi"), vocab, vocab_rows))


def _tagged_by_join(coded: DataFrame, vocab: DataFrame, vocab_rows: int) -> DataFrame:
    tokens = coded.select("doc_id", "line", F.posexplode("codes").alias("pos", "code")).select(
        "doc_id", "line", "pos", word_of(F.col("code")).alias("word_id"), sense_of(F.col("code")).alias("sense")
    )
    named = lookup_join(tokens, vocab.select("word_id", "word"), ["word_id"], vocab_rows, VOCAB_ROW_BYTES)
    parts = F.sort_array(F.collect_list(F.struct("pos", tx.sense_key(F.col("word"), F.col("sense")).alias("k"))))
    return named.groupBy("doc_id", "line").agg(
        F.array_join(F.transform(parts, lambda s: s["k"]), " ").alias("text")
    )
