"""Streaming forms: continuous cleaning, grouping of a study's images, deduplication on append."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import route_reports


def read_parquet_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over the Parquet files of a folder, schema taken from what is there.

    ``pattern`` matches files and folders of part files alike.
    """
    path = f"{folder.rstrip('/')}/{pattern}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a stream takes a plain path for a folder; a pattern may be a file or a folder
    return reader.parquet(path if any(c in pattern for c in "*?[{") else f"{folder.rstrip('/')}/{{{pattern}}}")


def clean_stream(reports: DataFrame, raw: str = "report_raw") -> DataFrame:
    """Stateless: the batch expressions on a stream."""
    return route_reports(reports, raw)


def group_images(images: DataFrame, key: str, ts: str, gap: str, payload: Sequence[str]) -> DataFrame:
    """Batch form: one row per study, its images (payload) ordered by time; a study ends ``gap`` after its last image."""
    grouped = images.groupBy(key, F.session_window(ts, gap).alias("session")).agg(
        F.array_sort(F.collect_list(F.struct(ts, *payload))).alias("images")
    )
    return grouped.select(key, F.col("session.start").alias("first_at"), F.col("session.end").alias("closed_at"), "images")


def closed_studies(images: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Stream form: (key, first_at, closed_at, n_images) of every study that the watermark has closed.

    State per open study is its span and a count, whatever its number of images; these stay in their table until
    ``with_images`` fetches those of closed studies.
    """
    grouped = images.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("session"))
    spans = grouped.agg(F.count(F.lit(1)).alias("n_images"))
    return spans.select(key, F.col("session.start").alias("first_at"), F.col("session.end").alias("closed_at"), "n_images")


def with_images(studies: DataFrame, images: DataFrame, key: str, ts: str, payload: Sequence[str]) -> DataFrame:
    """``studies`` plus ``images``, in order of time, for closed studies.

    Both sides meet by key and day, so a key that owns a third of all images spreads over its days.
    """
    day = lambda t: F.floor(F.unix_seconds(t) / 86400)
    days = F.sequence(day(F.col("first_at")), day(F.col("closed_at")))
    spans = studies.select(key, "first_at", "closed_at", F.explode(days).alias("__day"))
    rows = images.select(key, F.col(ts).alias("__ts"), F.struct(ts, *payload).alias("__row")).withColumn("__day", day(F.col("__ts")))
    inside = spans.join(rows, [key, "__day"]).filter((F.col("__ts") >= F.col("first_at")) & (F.col("__ts") < F.col("closed_at")))
    return inside.groupBy(key, "first_at", "closed_at").agg(F.array_sort(F.collect_list("__row")).alias("images"))


def with_end_marks(images: DataFrame, ts: str, folder: str) -> DataFrame:
    """The stream with the rows of ``folder``, where ``end_mark`` writes times that close what is still open."""
    schema = images.schema
    images.sparkSession.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    return images.unionByName(images.sparkSession.readStream.schema(schema).parquet(folder))


def end_mark(images: DataFrame, ts: str, folder: str, after: str) -> None:
    """Writes a row without key, ``after`` the last time in ``images`` (a batch), at the end of a stream.

    The next run moves the watermark there, and all studies that are still open are closed and returned.
    """
    last = images.agg((F.max(ts) + F.expr(f"interval {after}")).alias(ts))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in images.schema if f.name != ts]
    last.select(*nulls, F.col(ts).cast(images.schema[ts].dataType)).select(*images.columns).write.mode("append").parquet(folder)


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str, order: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Appends the first row (by ``order``) of every key that the target does not have, and returns the target.

    The target is the memory: a batch is compared with what other batches have appended, so no key is kept in
    state and none is ever forgotten. A batch writes a folder of its own, named by the checkpoint and its number;
    after a failure the same batch writes the same rows there again, so a replay adds nothing, and a job with a new
    checkpoint adds only what is missing. Rows of a null key are left out.
    """
    spark, schema = stream.sparkSession, stream.schema
    spark.createDataFrame([], schema).write.mode("ignore").format(fmt).save(f"{target}/batch=none")
    run = f"{zlib.crc32(checkpoint.encode()):08x}"

    def write(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.schema(f"`{key}` {schema[key].dataType.simpleString()}, batch string").format(fmt).load(target)
        known = known.filter(F.col("batch") != f"{run}-{number}").select(key).distinct()
        rest = [c for c in schema.names if c != key]
        first = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
        fresh = first.select(key, "r.*").join(known, key, "left_anti")
        fresh.select(*schema.names).write.mode("overwrite").format(fmt).save(f"{target}/batch={run}-{number}")

    job = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(schema).format(fmt).load(target).select(*schema.names)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is there, appends it to Parquet and returns the table.

    The checkpoint makes the job resumable: finished files are never read again.
    """
    job = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
