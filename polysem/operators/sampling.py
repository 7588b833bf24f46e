"""Splits and samples. All draws are hashes (see functions.hashing)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysem.functions.hashing import counter_draw, series_keys, uniform
from polysem.operators.corpus import pack, sense_number, word_of
from polysem.operators.joins import lookup_join
from polysem.operators.vocabulary import SHARE_BLOCK
from polysem.session import fits

CDF_ROW_BYTES = 24  # with its cells
# Cells per word when the distribution is joined instead of held in memory.
CELLS_PER_WORD = 1


def validation_ratio(n_sentences: int, ratio: float, max_sentences: int) -> float:
    return min(ratio, max_sentences / n_sentences)


def split_train_validation(sentences: DataFrame, ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    u = uniform(seed, "split", F.col("doc_id"), F.col("line"))
    return sentences.where(u >= ratio), sentences.where(u < ratio)


def chunk_of(n_chunks: int, seed: int) -> Column:
    u = uniform(seed, "chunk", F.col("doc_id"), F.col("line"))
    return F.floor(u * n_chunks).cast("int")


def vocab_sample(vocab: DataFrame, vocab_rows: int, wanted: int, seed: int) -> DataFrame:
    """About `wanted` random vocabulary rows."""
    u = uniform(seed, "vocab", F.col("word_id"))
    return vocab.where(u < F.lit(wanted) / F.lit(float(vocab_rows)))


def categorical_sample(weights: DataFrame, group: str, index: str, weight: str, u: Column) -> DataFrame:
    """Draw one `index` per group in proportion to `weight`. A group is the
    list of candidates of one draw, e.g. the senses of one word."""
    before = Window.partitionBy(group).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    cumulated = weights.withColumn("_cum", F.sum(weight).over(before)).withColumn("_all", F.sum(weight).over(whole))
    hit = cumulated.where(F.col("_cum") > u * F.col("_all"))
    return hit.groupBy(group).agg(F.min(index).alias(index))


# --- negative samples ---------------------------------------------------------
#
# Position by position, words are drawn from the unigram distribution until they
# differ from the word at that position. That is the same as drawing in
# [0, 1 - p_w) and stepping over the interval of w, so no draw is ever rejected.


def _draw_keys(seed: int, purpose: str) -> dict[str, Column]:
    """The keys of the draws of a line; its positions and their draws are counted."""
    first, second = series_keys(seed, purpose, F.col("doc_id"), F.col("line"))
    return {"_first": first, "_second": second}


def word_cells(hi: np.ndarray) -> np.ndarray:
    """The word at every border of 2^k equal cells of [0, 1], at least two cells for each word."""
    cells = 2 << max(1, len(hi)).bit_length()
    return np.searchsorted(hi, np.arange(cells + 1) / cells, side="right").astype(np.int32)


def words_at(hi: np.ndarray, borders: np.ndarray, at: np.ndarray) -> np.ndarray:
    """np.searchsorted(hi, at, side="right"); most places are in a cell of one word."""
    cells = len(borders) - 1
    cell = np.minimum((at * cells).astype(np.int64), cells - 1)  # exact: cells are a power of 2
    found = borders[cell]
    several = np.flatnonzero(found != borders[cell + 1])
    found[several] = np.searchsorted(hi, at[several], side="right")
    return found


def _draw_words(cdf, n, batches):
    hi = np.frombuffer(cdf.value, dtype=np.float64)
    lo = np.concatenate(([0.0], hi[:-1]))
    last, borders = len(hi) - 1, word_cells(hi)
    for batch in batches:
        words = batch.column("ids").flatten().to_numpy()
        lengths = batch.column("ids").value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first, second = (batch.column(c).to_numpy()[row][:, None] for c in ("_first", "_second"))
        u = counter_draw(first, second, place[:, None], np.arange(n)[None, :]).ravel()
        own = np.repeat(words, n)
        at = u * (1.0 - (hi[own] - lo[own]))
        at = np.where(at >= lo[own], at + (hi[own] - lo[own]), at)
        drawn = np.minimum(words_at(hi, borders, at), last)
        same = drawn == own  # only by rounding at an interval border
        drawn[same] = np.where(own[same] < last, own[same] + 1, own[same] - 1)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * n, pa.int32()), pa.array(drawn))
        outer = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), inner)
        columns = [c for c in batch.schema.names if c not in ("_first", "_second")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], outer], names=[*columns, "neg_ids"])


def negatives_in_memory(encoded: DataFrame, unigram: DataFrame, n: int, seed: int, purpose: str) -> DataFrame:
    """Sentences with `ids` -> the same with neg_ids ARRAY<ARRAY<INT>>. The
    distribution is held by every worker (8 bytes per word): no shuffle."""
    spark = encoded.sparkSession
    hi = unigram.select("word_id", "hi").toArrow().sort_by("word_id")["hi"].to_numpy()
    cdf = spark.sparkContext.broadcast(hi.tobytes())
    drawn = encoded.withColumns(_draw_keys(seed, purpose))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return drawn.mapInArrow(lambda batches: _draw_words(cdf, n, batches), f"{fields}, neg_ids array<array<int>>")


def negatives_by_join(
    encoded: DataFrame, unigram: DataFrame, vocab_rows: int, n: int, seed: int, purpose: str
) -> DataFrame:
    """Same result for a vocabulary of any size: every draw is joined with the
    words whose interval meets its cell. Cells are hit evenly, as u is uniform."""
    lo = F.lag("hi").over(Window.partitionBy("_b").orderBy("word_id"))
    blocks = unigram.withColumn("_b", F.expr(f"word_id div {SHARE_BLOCK}"))
    heads = blocks.groupBy((F.col("_b") + 1).alias("_b")).agg(F.max("hi").alias("_head"))
    table = (
        blocks.withColumn("lo", lo)
        .join(heads, "_b", "left")
        .withColumn("lo", F.coalesce("lo", "_head", F.lit(0.0)))
        .withColumn("hi", F.when(F.col("word_id") == vocab_rows - 1, F.lit(1.0)).otherwise(F.col("hi")))
        .select("word_id", "lo", "hi")
    )
    cells = vocab_rows * CELLS_PER_WORD
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("bigint")
    own = table.select("word_id", F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"))
    spans = table.select(
        F.col("word_id").alias("neg_id"), "lo", "hi",
        F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"),
    )
    tokens = encoded.select("doc_id", "line", F.posexplode("ids").alias("pos", "word_id"))
    draw = lambda j: counter_draw(F.col("_first"), F.col("_second"), F.col("pos").cast("bigint"), j.cast("bigint"))
    p = F.col("own_hi") - F.col("own_lo")
    scaled = F.col("u") * (1 - p)
    draws = (
        lookup_join(tokens, own, ["word_id"], vocab_rows, 40)
        .withColumns(_draw_keys(seed, purpose))
        .withColumn("us", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw))
        .select("doc_id", "line", "pos", "word_id", "own_lo", "own_hi", F.posexplode("us").alias("j", "u"))
        .withColumn("at", F.when(scaled >= F.col("own_lo"), scaled + p).otherwise(scaled))
        .withColumn("cell", cell(F.col("at")))
    )
    hits = draws.join(spans, "cell").where((F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")))
    other = F.when(F.col("word_id") < vocab_rows - 1, F.col("word_id") + 1).otherwise(F.col("word_id") - 1)
    drawn = F.when(F.col("neg_id") == F.col("word_id"), other).otherwise(F.col("neg_id"))  # only by rounding, as in memory
    return hits.select("doc_id", "line", "pos", "j", drawn.cast("int").alias("neg_id"))


def negative_samples(
    encoded: DataFrame, unigram: DataFrame, vocab_rows: int, n: int, seed: int, purpose: str = "neg"
) -> DataFrame:
    """Sentences with `ids` -> the same rows with neg_ids ARRAY<ARRAY<INT>>: n
    words per position, none equal to the word there."""
    if vocab_rows < 2 or n == 0:
        none = F.transform("ids", lambda w: F.array().cast("array<int>"))
        return encoded.withColumn("neg_ids", none)
    if fits(vocab_rows, CDF_ROW_BYTES):
        return negatives_in_memory(encoded, unigram, n, seed, purpose)
    drawn = negatives_by_join(encoded, unigram, vocab_rows, n, seed, purpose)
    # two steps, each group bounded: the n draws of a position, the positions of a line
    per_pos = drawn.groupBy("doc_id", "line", "pos").agg(F.sort_array(F.collect_list(F.struct("j", "neg_id"))).alias("d"))
    per_line = per_pos.groupBy("doc_id", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("d"))
    lists = F.transform("d", lambda s: F.transform(s["d"], lambda x: x["neg_id"]))
    return encoded.join(per_line.select("doc_id", "line", lists.alias("neg_ids")), ["doc_id", "line"])


def negative_senses(neg_ids: Column, cuts: list[int], one_sense_output: bool, seed: int, purpose: str = "neg") -> Column:
    """Codes of negatives: sense 0 if outputs have one sense, else a random one."""
    if one_sense_output or not cuts:
        return F.transform(neg_ids, lambda ws: F.transform(ws, lambda w: pack(w, F.lit(0))))

    def code(w: Column, j: Column, pos: Column) -> Column:
        n = sense_number(w, cuts)
        u = uniform(seed, purpose + "sense", F.col("doc_id"), F.col("line"), pos, j)
        return pack(w, F.when(n > 1, F.floor(u * n)).otherwise(F.lit(0)))

    return F.transform(neg_ids, lambda ws, pos: F.transform(ws, lambda w, j: code(w, j, pos)))


def with_negatives(
    coded: DataFrame, unigram: DataFrame, vocab_rows: int, n: int, cuts: list[int],
    one_sense_output: bool, seed: int, purpose: str = "neg",
) -> DataFrame:
    """(…, codes) -> (…, codes, negs ARRAY<ARRAY<BIGINT>>)."""
    kept = coded.columns
    with_ids = coded.withColumn("ids", F.transform("codes", word_of))
    drawn = negative_samples(with_ids, unigram, vocab_rows, n, seed, purpose)
    negs = negative_senses(F.col("neg_ids"), cuts, one_sense_output, seed, purpose)
    return drawn.select(*kept, negs.alias("negs"))
