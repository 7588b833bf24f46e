"""From raw documents to clean training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents. A stage judges what its predecessor kept, and nothing
else: statistics, copies and passages are those of its own input. Python gets
small Arrow batches, as workers and their memory outlive a stage.

Defined cases: documents without letters, and those whose n-grams no set of learnt
languages explains better than chance, are rejected (without any labelled training
document all stay; mixtures of learnt languages stay). Of equal texts and of a
class of near copies the smallest id stays, null ids last; documents without words are
their own class. Repeated rows count as copies. Null texts count as empty. An
empty table gives an empty result of the same columns, an empty benchmark drops nothing.
Other columns of documents pass the first four stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysem.llm import bpe, decontaminate, exact, langid, minhash
from polysem.llm.chars import lean
from polysem.llm.queries import TOKEN_RANKS, table
from polysem.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in no language that was learnt."""
    lean(spark)
    return langid.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts."""
    lean(spark)
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near copies."""
    lean(spark)
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    lean(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with the digests of ids and decoded bytes."""
    lean(spark)
    return bpe.digests(docs, public_tokenizers.path(TOKEN_RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

# Mixtures, near copies, edits and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
