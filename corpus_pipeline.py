"""The corpus pipeline: quality, near copies, repeated passages, mixture, tokens.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame, all but the
last with the columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import bpe, jaccard_join, mixing, quality, queries, suffix_dedup
from studyloom.session import cut_lineage

#: The stages are trained models and iterative searches, which SQL does not express.
ORACLE_SQL = None
#: Words of the shortest repeated passage that is cut.
PASSAGE_WORDS = 51


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score under 0.3)."""
    return quality.keep_quality(docs, queries.table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 80 percent of its five-word shingles."""
    return jaccard_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of more than 50 words that occur more than once; n_chars follows the text."""
    cut = suffix_dedup.remove_repeats(docs, PASSAGE_WORDS, words=True)
    cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as weights calibrated to the target shares of source, language and topic say."""
    return mixing.sample_mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document, and the text they decode to."""
    return bpe.encode_documents(docs, queries.vocabulary(), keep_text=False)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("mixing", mixed),
    ("BPE", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage")
    return docs
