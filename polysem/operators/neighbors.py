"""Look-ups and nearest neighbours in a table of sense vectors
(word, sense, vec)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysem.functions import text as tx
from polysem.functions import vectors as fv
from polysem.operators.vector_table import block_no, matrix, n_blocks, unit_rows
from polysem.session import cut

# Queries and stored vectors per side of one cell.
BLOCK_ROWS = 4096


def keyed(vectors: DataFrame) -> DataFrame:
    return vectors.select(tx.sense_key(F.col("word"), F.col("sense")).alias("key"), "word", "sense", "vec")


def senses_of_words(vectors: DataFrame) -> DataFrame:
    """(word, n_senses): the highest sense and one."""
    return vectors.groupBy("word").agg((F.max("sense") + 1).alias("n_senses"))


def _fail(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message + ": "), value))


def get_vector(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Vectors of the given keys; an unknown key is an error."""
    found = keys.select("key").join(keyed(vectors).select("key", "vec"), "key", "left")
    vec = F.when(F.col("vec").isNull(), _fail("not in vocabulary", F.col("key")).cast("array<float>"))
    return found.select("key", vec.otherwise(F.col("vec")).alias("vec"))


def parse_search_terms(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """`apple` means all its senses, `apple_1` that sense: (term, word, n_senses,
    sense, whole). A term that is itself a word is taken whole, whatever
    separators it has. An unknown word or sense is an error."""
    words = cut(senses_of_words(vectors))
    as_key = F.col("term").rlike(tx.KEY)
    split = terms.withColumn("part", F.when(as_key, tx.key_word(F.col("term")))).withColumn(
        "number", F.when(as_key, tx.key_sense(F.col("term")))
    )
    whole = words.select(F.col("word").alias("term"), F.col("n_senses").alias("whole_n"))
    known = split.join(whole, "term", "left").join(words.select(F.col("word").alias("part"), F.col("n_senses").alias("part_n")), "part", "left")
    has_sense = F.coalesce(F.col("number") < F.col("part_n"), F.lit(False))
    every = F.sequence(F.lit(0), F.col("whole_n") - 1)
    error = _fail("not in vocabulary", F.col("term")).cast("array<int>")
    taken = F.col("whole_n").isNotNull()
    senses = F.when(taken, every).when(has_sense, F.array("number")).otherwise(error)
    return known.select(
        "term", F.when(taken, F.col("term")).otherwise(F.col("part")).alias("word"), F.coalesce("whole_n", "part_n").alias("n_senses"),
        F.explode(senses).alias("sense"), taken.alias("whole"),
    )


def query_vectors(parsed: DataFrame, vectors: DataFrame) -> DataFrame:
    joined = parsed.join(vectors, ["word", "sense"])
    return joined.select("term", "whole", "n_senses", tx.sense_key(F.col("word"), F.col("sense")).alias("query"), "vec")


def _similarities(rows: np.ndarray, queries: np.ndarray, cosine: bool) -> np.ndarray:
    return (unit_rows(rows) if cosine else rows) @ unit_rows(queries).T


def _cells(vectors: DataFrame, queries: DataFrame, task, schema: str) -> DataFrame:
    """Run `task(query names, query rows, keys, rows)` for every block of queries
    with every block of stored vectors. A row goes to one cell for each block of
    the other side; nothing passes through the driver, each side is read once."""
    table = keyed(vectors).select("key", "vec")
    rows, asked = n_blocks(vectors.count(), BLOCK_ROWS), n_blocks(queries.count(), BLOCK_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both may come from one table, so each side has column names of its own.
    left = queries.select(
        F.col("query").alias("q"), F.col("vec").alias("q_vec"), block_no(F.col("query"), asked).alias("qb"), every(rows).alias("vb")
    )
    right = table.select(
        F.col("key").alias("v"), F.col("vec").alias("v_vec"), every(asked).alias("qb2"), block_no(F.col("key"), rows).alias("vb2")
    )

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"query": pa.array([], pa.string()), "key": pa.array([], pa.string()), "sim": pa.array([], pa.float64())})
        return task(q["q"], matrix(q["q_vec"]), v["v"], matrix(v["v_vec"]))

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb2", "vb2")).applyInArrow(run, schema)


PAIR = "query string, key string, sim double"


def cross_similarity(vectors: DataFrame, queries: DataFrame, dim: int, cosine: bool = True) -> DataFrame:
    """Similarity of every stored vector with every query: (query, key, sim)."""

    def task(names, q, keys, rows):
        sims = _similarities(rows, q, cosine)
        row, col = np.divmod(np.arange(sims.size), sims.shape[1])
        return pa.table({"query": names.take(pa.array(col)), "key": keys.take(pa.array(row)), "sim": sims.ravel()})

    return _cells(vectors, queries, task, PAIR)


def top_k_neighbors(vectors: DataFrame, queries: DataFrame, k: int, dim: int, cosine: bool = True) -> DataFrame:
    """The k+1 most similar rows per query (the query itself is among them):
    (query, rank, key, sim), ties by key. Every cell keeps its best k+1 only, so
    the ranking of a query sees k+1 rows for each block of stored vectors."""
    keep = k + 1

    def task(names, q, keys, rows):
        sims = _similarities(rows, q, cosine)
        if len(sims) > keep:
            edge = np.partition(sims, len(sims) - keep, axis=0)[len(sims) - keep]
            row, col = np.nonzero(sims >= edge)
        else:
            row, col = np.divmod(np.arange(sims.size), sims.shape[1])
        near = pa.table({"q": col, "key": keys.take(pa.array(row)), "sim": sims[row, col]})
        near = near.sort_by([("q", "ascending"), ("sim", "descending"), ("key", "ascending")])
        at = near["q"].to_numpy()
        best = np.arange(len(at)) - np.searchsorted(at, at, side="left") < keep
        near = near.filter(pa.array(best))
        return pa.table({"query": names.take(near["q"].combine_chunks()), "key": near["key"], "sim": near["sim"]})

    order = Window.partitionBy("query").orderBy(F.desc("sim"), "key")
    ranked = _cells(vectors, queries, task, PAIR).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= keep).select("query", "rank", "key", "sim")


def distinct_neighbors(neighbors: DataFrame) -> DataFrame:
    """The keys near any query."""
    return neighbors.select("key").distinct()


def neighbors_per_word(neighbors: DataFrame) -> DataFrame:
    """Per query word the keys near any of its senses."""
    return neighbors.select(tx.key_word(F.col("query")).alias("query_word"), "key").distinct()


def sense_similarity_matrix(vectors: DataFrame) -> DataFrame:
    """Cosine between every two senses of a word: (word, sense_a, sense_b, sim).
    A word has fewer senses than the packing constant."""
    a = vectors.select("word", F.col("sense").alias("sense_a"), F.col("vec").alias("a"))
    b = vectors.select("word", F.col("sense").alias("sense_b"), F.col("vec").alias("b"))
    return a.join(b, "word").select("word", "sense_a", "sense_b", fv.cosine(F.col("a"), F.col("b")).alias("sim"))


def neighbors_report(vectors: DataFrame, terms: DataFrame, k: int, dim: int, cosine: bool = True) -> DataFrame:
    """Per search term the matrix of its senses (if several) and the neighbours
    of each: (term, part, query, rank, other, sim). The sense is left out of a
    query's name if the term is a one-sense word, and of a neighbour's if its
    word has one sense."""
    queries = query_vectors(parse_search_terms(terms, vectors), vectors)
    # two terms may ask for the same sense
    near = top_k_neighbors(vectors, queries.dropDuplicates(["query"]), k, dim, cosine)
    words = senses_of_words(vectors)
    first = tx.key_word(F.col("key"))
    named = near.join(words.select(F.col("word").alias("nb_word"), F.col("n_senses").alias("nb_n")), first == F.col("nb_word"))
    plain = F.col("whole")
    header = F.when(plain & (F.col("n_senses") == 1), F.col("term")).otherwise(F.col("query"))
    lists = queries.drop("vec").join(named, "query").select(
        "term", F.lit("neighbor").alias("part"), header.alias("query"), "rank",
        F.when(F.col("nb_n") == 1, F.col("nb_word")).otherwise(F.col("key")).alias("other"), "sim",
    )
    several = queries.where(plain & (F.col("n_senses") > 1))
    right = several.select("term", F.col("query").alias("other"), F.col("vec").alias("other_vec"))
    sense = tx.key_sense(F.col("other"))
    senses = several.join(right, "term").select(
        "term", F.lit("senses").alias("part"), "query", sense.alias("rank"), "other",
        fv.cosine(F.col("vec"), F.col("other_vec")).alias("sim"),
    )
    return lists.unionByName(senses)
