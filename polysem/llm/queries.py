"""The registered queries of the subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysem.llm import bpe, decontaminate, exact, extract, hardneg, langid, lexical, licenses, minhash, privacy, sharding, toxicity, warc

TOKEN_RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_log(pages: DataFrame) -> DataFrame:
    """An archive in which every page was captured once in full and visited three
    times more: with an entity tag (every fifth page has changed by then), with
    a date, and with a payload digest. Times follow from the id of the page."""
    time = lambda add: (F.col("page_id") * 7919 + add) % 1_000_000
    tag = F.concat(F.lit('"'), F.substring(F.md5("body"), 1, 16), F.lit('"'))
    digest = F.concat(F.lit("sha256:"), F.sha2("body", 256))
    changed = F.col("page_id") % 5 == 0
    text = lambda c: c.cast("string")

    def record(k: int, add: int, kind: str, status: int, **headers) -> F.Column:
        named = [x for n, v in headers.items() for x in (F.lit(n.replace("_", "-")), v)]
        return F.struct(
            (F.col("page_id") * 4 + k).alias("record_id"), "url", time(add).alias("ts"), F.lit(kind).alias("kind"),
            F.lit(status).alias("status"), F.create_map(*named).alias("headers"),
        )

    date = lambda add: F.concat(F.lit("t"), text(time(add)))
    rows = F.array(
        record(
            0, 0, "response", 200, etag=tag, last_modified=date(0), date=date(0), warc_payload_digest=digest,
            content_length=text(F.octet_length("body")), cache_control=F.lit("max-age=60"),
        ),
        record(
            1, 250_007, "revisit", 304, date=date(250_007), content_length=F.lit("0"), expires=date(260_007),
            etag=F.when(changed, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), tag)),
        ),
        record(2, 500_009, "revisit", 304, date=date(500_009), last_modified=date(0), cache_control=F.lit("no-cache")),
        record(3, 750_011, "revisit", 200, date=date(750_011), warc_payload_digest=digest),
    )
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("body"))
    return body.select(F.explode(rows).alias("r")).select("r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(capture_log(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("merged", F.array_join(lines, "\n"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.find(table(spark, sf_dir, "documents")).drop("row_key")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find(table(spark, sf_dir, "documents"))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.protect(table(spark, sf_dir, "documents"), with_text=False)
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op5_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKEN_RANKS), public_tokenizers.PATTERN
    )


def op10_shard_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_revisits, op2_dart_minhash, op3_exact_dedup, op4_disclosure, op5_toxic_neighbours, op6_language_mixture, op7_decontamination, op8_line_blocks, op9_byte_bpe, op10_shard_minimax, op11_hard_negatives, op12_license_index, op13_best_position)}
