"""Streaming queries, run to completion over the bound files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import scratch_path
from ..sources import readers
from ..streaming import jobs as J
from . import query
from .tables import PAIRS_SQL, pairs, table
from .texts import ROUTED_SQL, raw_report

GAP, DELAY = "30 minutes", "2 hours"

_SESSION_SQL = """e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e),
g AS (SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 1800000000 AS closed_us, count(*) AS n_images, string_agg(event_id, ',' ORDER BY ts, event_id) AS images
  FROM b GROUP BY user_id, s)"""


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    base = scratch_path(spark, name)
    return J.run_available(stream, f"{base}/out", f"{base}/checkpoint")


@query("stream_clean", f"WITH {ROUTED_SQL} SELECT doc_id, status, CASE WHEN status = 'valid' THEN r1 END AS report FROM routed")
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = J.read_parquet_stream(spark, sf_dir, "documents.parquet")
    raw = docs.select("doc_id", raw_report(F.col("doc_id"), F.col("text")).alias("report_raw"))
    return _run(spark, J.clean_stream(raw), "stream-clean").select("doc_id", "status", "report")


def _rows(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _shown(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "user_id",
        F.unix_micros("first_at").alias("first_us"),
        F.unix_micros("closed_at").alias("closed_us"),
        F.size("images").cast("bigint").alias("n_images"),
        F.concat_ws(",", F.transform("images", lambda x: x["event_id"].cast("string"))).alias("images"),
    )


@query("session_images", f"WITH {_SESSION_SQL} SELECT * FROM g")
def session_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(J.group_images(_rows(table(spark, sf_dir, "events")), "user_id", "ts", GAP, ["event_id"]))


@query("stream_session", f"WITH {_SESSION_SQL} SELECT * FROM g")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies closed by the watermark in a first run, and those still open by an end mark in a second."""
    base = scratch_path(spark, "stream-session")
    rows = _rows(table(spark, sf_dir, "events"))
    for end in (False, True):
        if end:
            J.end_mark(rows, "ts", f"{base}/marks", "1 day")
        stream = J.with_end_marks(_rows(J.read_parquet_stream(spark, sf_dir, "events.parquet")), "ts", f"{base}/marks")
        closed = J.run_available(J.closed_studies(stream, "user_id", "ts", GAP, DELAY), f"{base}/out", f"{base}/checkpoint")
    return _shown(J.with_images(closed, rows, "user_id", "ts", ["event_id"]))


@query("stream_dedup", "SELECT user_id AS study_id, min(epoch_us(ts)) AS first_us, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run twice over the same files with checkpoints of their own: the second run appends nothing."""
    base = scratch_path(spark, "stream-dedup")
    for run in (1, 2):
        rows = _rows(J.read_parquet_stream(spark, sf_dir, "events.parquet")).withColumnRenamed("user_id", "study_id")
        kept = J.append_new(rows, f"{base}/out", f"{base}/checkpoint{run}", "study_id", ["ts", "event_id"])
    return kept.select("study_id", F.unix_micros("ts").alias("first_us"), "event_id")


@query(
    "prediction_append",
    f"""WITH {PAIRS_SQL} SELECT CAST(pair_id AS VARCHAR) AS study_id, ref AS real_report, hyp AS generated_report, 'first' AS selected_method FROM pairs""",
)
def prediction_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction lines of two runs: the second finds all studies done and adds none."""
    base = scratch_path(spark, "predictions")
    made = pairs(spark, sf_dir).select(F.col("pair_id").cast("string").alias("study_id"), F.col("ref").alias("real_report"), F.col("hyp").alias("generated_report"))
    for run in ("first", "second"):
        made.withColumn("selected_method", F.lit(run)).write.parquet(f"{base}/in/{run}")
        stream = spark.readStream.schema(schemas.PREDICTION).parquet(f"{base}/in/{run}")
        J.append_new(stream, f"{base}/out", f"{base}/{run}", "study_id", ["generated_report"], "json")
    return readers.read_json_lines(spark, f"{base}/out/*")[0]
