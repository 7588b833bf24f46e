"""Readers of the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysem.session import cut


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "text")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A text corpus, one sentence per line, keyed like a line of a document. The
    key is the number of the line in file order, however the files are split."""
    lines, _ = numbered_lines(spark, path)
    return lines.select(F.col("line_no").alias("doc_id"), F.lit(0).alias("line"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Lines of one or more text files with their dense number in file order.
    Within a block of a file rows come in order, so counting the rows of each
    block is enough and nothing is sorted."""
    lines = cut(
        spark.read.text(path).select(
            "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    blocks = lines.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    rows, offsets = 0, []
    for b in blocks.orderBy("_file", "_start").collect():  # one row for each block of a file
        offsets.append((b["_file"], b["_start"], rows - b["first"]))
        rows += b["n"]
    table = spark.createDataFrame(offsets, "_file string, _start bigint, _shift bigint")
    numbered = lines.join(F.broadcast(table), ["_file", "_start"])
    return numbered.select((F.col("_at") + F.col("_shift")).alias("line_no"), "value"), rows


def read_eval_words(spark: SparkSession, path: str) -> DataFrame:
    """The set of words of a file with one word per line."""
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()


def read_sense_vectors(spark: SparkSession, path: str) -> DataFrame:
    """`word sense f1 .. fD` lines -> (line_no, word, sense, vec). The width is
    that of the first line; a line of another width is an error."""
    lines, _ = numbered_lines(spark, path)
    parts = F.split(F.rtrim("value"), " ")
    lines = lines.withColumn("parts", parts)
    width = lines.agg(F.min_by(F.size("parts"), "line_no").alias("w")).scalar()
    floats = F.slice("parts", 3, F.size("parts") - 2).cast("array<float>")
    vec = F.when(
        F.size("parts") != width,
        F.raise_error(F.concat(F.lit("line of another width: "), F.col("line_no").cast("string"))).cast("array<float>"),
    ).otherwise(floats)
    return lines.select(
        "line_no", F.element_at("parts", 1).alias("word"), F.element_at("parts", 2).cast("int").alias("sense"), vec.alias("vec")
    )


def read_word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """`word1,word2[,..]` lines -> (id, word1, word2)."""
    lines, _ = numbered_lines(spark, path)
    parts = F.split("value", ",", -1)
    return lines.select(F.col("line_no").alias("id"), parts[0].alias("word1"), parts[1].alias("word2"))


def read_context_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Four tab-separated fields -> (id, word1, word2, context1, context2)."""
    lines, _ = numbered_lines(spark, path)
    parts = F.split("value", "\t", -1)
    names = ("word1", "word2", "context1", "context2")
    return lines.select(F.col("line_no").alias("id"), *[parts[k].alias(name) for k, name in enumerate(names)])


def read_series(spark: SparkSession, path: str, name: str = "x") -> DataFrame:
    """One number per line -> (idx, x)."""
    lines, _ = numbered_lines(spark, path)
    return lines.select(F.col("line_no").alias("idx"), F.col("value").cast("double").alias(name))


def read_word_index(spark: SparkSession, path: str) -> DataFrame:
    """`word_id_nsenses` lines."""
    field = lambda k: F.regexp_extract("value", "^(.*)_([0-9]+)_([0-9]+)$", k)
    return spark.read.text(path).select(
        field(1).alias("word"), field(2).cast("int").alias("word_id"), field(3).cast("int").alias("n_senses")
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    schema = "it INT, vali_loss DOUBLE, vali_adjust DOUBLE"
    return spark.read.schema(schema).option("sep", " ").option("header", True).csv(path)
