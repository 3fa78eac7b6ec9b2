"""The operators bound to the test tables, with production parameters, and their SQL forms where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import (
    bpe,
    byte_bpe,
    hamming,
    hard_negatives,
    hilbert,
    jaccard_join,
    licenses,
    mixing,
    quality,
    spotsigs,
    suffix_dedup,
    toxicity,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]
#: Rows per Arrow batch: long texts would make the default's batches too large for a worker.
ARROW_ROWS = "512"


def vocabulary() -> str:
    """Default path of the tokenizer file, on every worker's own installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> tuple[str, str]:
    """Default path of the rank file, on every worker's own installation, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_repeats(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest_fingerprints(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.held_out(0, 5)
    weights = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score_quality(docs, weights, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest_mix(table(spark, sf_dir, "documents"))


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    rows = rows.select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.search(rows, rows.filter("vec_id % 50 = 0"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest_components(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest_licenses(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.held_out(1, 3)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score_toxicity(docs, model, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.digest_shards(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine_hard_negatives(rows, F.expr("vec_id % 100 = 0"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(table(spark, sf_dir, "documents"), *byte_vocabulary())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_document_fingerprints,
        op3_bpe,
        op4_quality_classifier,
        op5_mixing,
        op6_hamming_topk,
        op7_ngram_jaccard_join,
        op8_license_scan,
        op9_toxicity,
        op10_hilbert_shards,
        op11_hard_negatives,
        op12_byte_bpe,
        op13_vector_codes,
    )
}
SQL: dict[str, str] = {
    "op5_mixing": mixing.mix_sql(),
    "op6_hamming_topk": hamming.search_sql(),
    "op11_hard_negatives": hard_negatives.negatives_sql(),
    "op13_vector_codes": vector_codes.codes_sql(),
}
