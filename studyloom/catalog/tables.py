"""Reading the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread_for_cpu


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents spread over the cores: the columns computed from ``text`` are CPU-bound."""
    return spread_for_cpu(table(spark, sf_dir, "documents"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, ref, hyp): a user turn and the assistant turn that answers it."""
    conv = spread_for_cpu(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ref"))
    answers = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp")
    )
    joined = users.join(answers, ["conv_id", "turn"])
    return joined.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "ref", "hyp")


PAIRS_SQL = """pairs AS (
  SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS ref, a.text AS hyp
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def ordered_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Lines with the part columns of a diagnosis: code (brand) and description (name)."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", *extra
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name", "p_type"
    )
    return lines.join(parts, "l_partkey", "left")


LINE_TIE = ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
