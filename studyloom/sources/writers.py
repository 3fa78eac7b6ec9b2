"""Sinks. Every writer leaves the data distributed; nothing is gathered first."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.scale import by_key

#: Names the file of the rows without a key, as in Spark's folders.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_studies(studies: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Study table as Parquet with nested columns, or as CSV with nested columns in JSON."""
    if fmt == "csv":
        flat = [
            F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in studies.dtypes
        ]
        studies.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        studies.write.mode(mode).parquet(path)


def align_metrics(rows: DataFrame, columns: Sequence[str] = schemas.METRIC_COLUMNS, unknown: Sequence[str] = ()) -> DataFrame:
    """Metric rows in the fixed column order, four decimals, missing metrics 0, those in ``unknown`` null."""
    out = []
    for c in columns:
        if c in ("eval_timestamp", "report_file"):
            out.append(F.col(f"`{c}`").alias(c) if c in rows.columns else F.lit("").alias(c))
        else:
            none = F.lit(None).cast("double") if c in unknown else F.lit(0.0)
            value = F.coalesce(F.col(f"`{c}`").cast("double"), none) if c in rows.columns else none
            out.append(F.round(value, 4).alias(c))
    return rows.select(*out)


def union_metrics(old: DataFrame, new: DataFrame, columns: Sequence[str] = schemas.METRIC_COLUMNS) -> DataFrame:
    """Old and new rows with the columns lined up by name."""
    return align_metrics(old.unionByName(new, allowMissingColumns=True), columns)


def append_metrics(rows: DataFrame, path: str) -> None:
    align_metrics(rows).write.mode("append").option("header", True).csv(path)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines, appended: a resumed run adds files and never rewrites finished ones."""
    predictions.write.mode("append").json(path)


def write_ids_by_prefix(rows: DataFrame, col: str, path: str) -> None:
    """Distinct ids as text, one folder per two-character prefix."""
    ids = rows.select(F.col(col).cast("string").alias("value")).filter(F.length("value") >= 2).distinct()
    named = ids.withColumn("prefix", F.concat(F.lit("p"), F.substring("value", 1, 2)))
    named.sortWithinPartitions("prefix", "value").write.mode("errorifexists").partitionBy("prefix").text(path)


def write_text_files(rows: DataFrame, path: str, key: str, text: str) -> None:
    """One file per ``key`` below ``path``, as ``<key>=<value>.txt``, percent-encoded; rows of one key are lines of its file.

    In a mounted folder (``file:``, the same for all executors as for every step written there) tasks write the files
    themselves, one folder per task: Spark's writer needs a folder, a checksum and two started processes for each, and its
    reader a listing task for each. In other stores Spark writes, a folder ``<key>=<value>`` per file.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    # the number of tasks is explicit, as files cost time and few bytes; rows of one key meet in one
    dealt = by_key(rows.select(F.col(key), F.col(text).alias("value")), key)
    if uri.getScheme() != "file":
        # tasks put their files in place themselves; by default the driver renames them one by one at the end
        in_tasks = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
        dealt.write.options(**in_tasks).partitionBy(key).text(path)
        return
    root = uri.getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a repeated task writes the same names again
        folder, files = f"{root}/part-{TaskContext.get().partitionId():05d}", 0
        os.makedirs(folder, exist_ok=True)
        lines = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns)))
        for name, group in groupby(lines, lambda x: x[0]):
            shown = NO_NAME if name is None else quote(name, safe="")
            with open(f"{folder}/{key}={shown}.txt", "wb") as file:
                file.writelines(value + b"\n" for _, value in group)
            files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]}, pa.schema([("files", pa.int64())]))

    lines = dealt.select(F.col(key).cast("string").alias("key"), F.col("value").cast("binary").alias("value"))
    lines.sortWithinPartitions("key").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def save_knowledge_base(entities: DataFrame, relations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    entities.write.mode(mode).parquet(f"{path}/kb_entity")
    relations.write.mode(mode).parquet(f"{path}/kb_relation")


def load_knowledge_base(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/kb_entity"), spark.read.parquet(f"{path}/kb_relation")
