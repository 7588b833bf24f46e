"""Writers of the text formats. Ordered outputs are sorted by range, so that
the part files in name order are the ordered file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.functions import text as tx
from polysem.operators.ordering import number_rows


def _floats(vec: Column) -> Column:
    return F.array_join(F.transform(vec, lambda x: x.cast("float").cast("string")), " ")


def _write(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def write_word_index(vocab: DataFrame, path: str) -> None:
    """`word_id_nsenses` per word, by id."""
    line = F.concat_ws(tx.KEY_SEPARATOR, "word", "word_id", "n_senses")
    _write(vocab.orderBy("word_id").select(line.alias("value")), path)


def named_rows(model: DataFrame, vocab: DataFrame, mat: int) -> DataFrame:
    """Vectors of one matrix with their words: (word_id, word, sense, vec)."""
    return model.where(F.col("mat") == mat).join(vocab.select("word_id", "word"), "word_id")


def write_sense_vectors(rows: DataFrame, path: str, *order: str) -> None:
    """`word sense f1 .. fD` per word-sense; the first sense of a word first."""
    line = F.concat_ws(" ", "word", F.col("sense").cast("string"), _floats(F.col("vec")))
    _write(rows.orderBy(*(order or ("word", "sense"))).select(line.alias("value")), path)


def w2v_lines(rows: DataFrame, dim: int) -> DataFrame:
    """Header `rows D`, then `word_sense f1 .. fD`: (ord, word, sense, value)."""
    header = rows.agg(F.concat_ws(" ", F.count("*").cast("string"), F.lit(str(dim))).alias("value")).select(
        F.lit(0).alias("ord"), F.lit("").alias("word"), F.lit(0).alias("sense"), "value"
    )
    line = F.concat_ws(" ", tx.sense_key(F.col("word"), F.col("sense")), _floats(F.col("vec")))
    return header.unionByName(rows.select(F.lit(1).alias("ord"), "word", "sense", line.alias("value")))


def write_w2v_text(rows: DataFrame, dim: int, path: str) -> None:
    _write(w2v_lines(rows, dim).orderBy("ord", "word", "sense").select("value"), path)


def write_flat_model(rows: DataFrame, index_path: str, vectors_path: str) -> None:
    """`key idx` lines, and the vectors in index order: one line each, as one
    line for all of them could not be written by many tasks."""
    numbered, _ = number_rows(rows.select("word", "sense", "vec"), "word", "sense", column="idx")
    key = tx.sense_key(F.col("word"), F.col("sense"))
    _write(numbered.select("idx", F.concat_ws(" ", key, "idx").alias("value")).orderBy("idx").select("value"), index_path)
    _write(numbered.select("idx", _floats(F.col("vec")).alias("value")).orderBy("idx").select("value"), vectors_path)


def write_history(history: DataFrame, path: str) -> None:
    """One row per iteration; zeros where nothing was validated."""
    filled = history.select(
        "it", F.coalesce("vali_loss", F.lit(0.0)).alias("vali_loss"), F.coalesce("vali_adjust", F.lit(0.0)).alias("vali_adjust")
    )
    filled.orderBy("it").write.option("sep", " ").option("header", True).csv(path)


def write_tagged_corpus(tagged: DataFrame, path: str) -> None:
    _write(tagged.select(F.col("text").alias("value")), path)


def write_neighbor_lists(per_word: DataFrame, path: str) -> None:
    """`word<tab>key` lines by word under `per_word`, and under `all` every key
    near any word once."""
    line = F.concat_ws("\t", "query_word", "key")
    _write(per_word.orderBy("query_word", "key").select(line.alias("value")), f"{path}/per_word")
    write_key_list(per_word.select("key").distinct(), f"{path}/all")


def write_key_list(keys: DataFrame, path: str) -> None:
    _write(keys.select(F.col("key").alias("value")), path)


def write_scores(scores: DataFrame, path: str) -> None:
    """`id,score`: the pair a score belongs to stays known."""
    scores.select("id", "score").write.csv(path)
