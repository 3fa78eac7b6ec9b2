"""Readers for the tables, text files, graphs and vectors a study dataset is built from."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ids import study_of_path
from ..session import cut_lineage


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """Repartitions only where the scan yields fewer tasks than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_csv(
    spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, multiline: bool = False
) -> DataFrame:
    """CSV with header and an explicit schema; columns are found by name, unused ones are not parsed.

    ``multiline`` is for files whose texts hold line breaks; such a file is one task.
    """
    header = spark.read.option("header", True).csv(path).columns if not multiline else None
    reader = spark.read.option("header", True).option("escape", '"')
    if header is None:
        df = reader.option("multiLine", True).schema(schema).csv(path)
        return df.select(*columns) if columns else df
    types = dict(part.strip().split(" ", 1) for part in schema.split(","))
    full = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    return reader.schema(full).csv(path).select(*(columns or types))


def read_json_lines(spark: SparkSession, path: str, schema: str = schemas.PREDICTION) -> tuple[DataFrame, DataFrame]:
    """(good, bad): parsed rows, and the text of lines that are no JSON. Blank lines are neither.

    A field that holds an object where text is expected arrives as its JSON text.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.filter(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("r.*").drop("_bad")
    bad = parsed.filter(F.col("r").isNull() | F.col("r._bad").isNotNull()).select(F.col("value").alias("line"))
    return good, bad


def relative_path(path: Column, root: str) -> Column:
    """Part of a file path or URI below the folder ``root``."""
    return F.substring_index(path, root.rstrip("/") + "/", -1)


def merge_tasks(df: DataFrame, per_core: int = 16, together: int = 16) -> DataFrame:
    """Reads small files in fewer tasks than Spark's planner makes, which counts some MB for opening each.

    A number of tasks per core stays, and one for every ``together`` planned ones: those hold a bounded number of bytes.
    """
    planned = df.rdd.getNumPartitions()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism * per_core, planned // together)
    return df.coalesce(wanted) if planned > wanted else df


def read_text_files(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text): one row per file below ``root``, path relative to it."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = merge_tasks(reader.text(root, wholetext=True).select("_metadata.file_path", "value"))
    return files.select(relative_path(F.col("file_path"), root).alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("size"))


#: In a file of report graphs every graph has this key once, and no text can hold it unescaped.
_GRAPH_KEY = '"entities":'
#: The name of an object whose fields, up to the end of the text, are plain values.
_TAIL_NAME = r'"((?:[^"\\]|\\.)*)"\s*:\s*\{\s*(?:"(?:[^"\\]|\\.)*"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^{}\[\]",]+)\s*,\s*)*$'


def _graph_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, entities): the JSON text of every graph's entities in files of one object each.

    A file is cut at the key of the entities, which Spark's text reader does by byte ranges, so a large object is
    read by many tasks. A piece begins with a graph's entities and ends with the name of the next graph; a piece's
    own name stands in the piece before it, in the same range or, for a range's first, at the end of the last one.
    """
    pieces = spark.read.option("lineSep", _GRAPH_KEY).text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    )
    named = cut_lineage(pieces.withColumn("next", F.regexp_extract("value", _TAIL_NAME, 1)), "pieces")
    inner = Window.partitionBy("file", "start").orderBy("at")
    rows = named.withColumn("name", F.lag("next").over(inner)).withColumn("place", F.row_number().over(inner))
    # one row per byte range
    ends = named.groupBy("file", "start").agg(F.max_by("next", "at").alias("last"))
    before = ends.select("file", "start", F.lag("last").over(Window.partitionBy("file").orderBy("start")).alias("carried"))
    rows = rows.join(before, ["file", "start"]).withColumn("key", F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("name")))
    return rows.filter("key is not null").select("key", F.col("value").alias("entities"))


def read_report_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of ``{path: {entities: {...}}}`` objects, one object per file.

    Other fields of a graph are skipped; those before its entities must be plain values. Keys without a study number
    are dropped.
    """
    # the parser takes the first object and ignores what follows it
    parsed = F.from_json("entities", schemas.REPORT_ENTITIES)
    graphs = _graph_texts(spark, path).select(study_of_path(F.col("key")).alias("case_id"), parsed.alias("entities"))
    nodes = graphs.filter("case_id is not null").select("case_id", F.posexplode("entities").alias("eid", "name", "e"))
    nodes = cut_lineage(nodes, "graphs")
    entities = nodes.select("case_id", "eid", "name", F.col("e.tokens").alias("tokens"), F.col("e.label").alias("entity_type"))
    links = nodes.select("case_id", "eid", F.posexplode("e.relations").alias("rel_ord", "r"))
    targets = entities.select("case_id", F.col("eid").alias("target"), "name")
    relations = links.withColumn("name", F.element_at("r", 2)).join(targets, ["case_id", "name"])
    return entities, relations.select("case_id", "eid", "rel_ord", F.element_at("r", 1).alias("rel_type"), "target")


def read_vector_files(spark: SparkSession, root: str, pattern: str = "*.npy") -> tuple[DataFrame, DataFrame]:
    """(good, dropped) of ``<study>.npy`` files: (study_id, vec, dtype, shape) and (path, problem).

    A leading axis of one is dropped. Files are read in tasks, each from its own content; Spark's file scan passes over
    files of length 0, so these are in neither table.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                study, vec, kind, shape, problem = None, None, None, None, None
                try:
                    array = np.load(io.BytesIO(content), allow_pickle=False)
                    kind, shape = str(array.dtype), str(array.shape)
                    vec = (array.squeeze(0) if array.ndim == 2 else array).astype(np.float32)
                    if vec.ndim != 1:
                        raise ValueError(f"shape {shape}")
                    study = int(path.rsplit("/", 1)[-1].removesuffix(".npy"))
                except (ValueError, EOFError, TypeError) as error:
                    vec, problem = None, str(error) or type(error).__name__
                rows.append((path, study, vec, kind, shape, problem))
            yield pd.DataFrame(rows, columns=["path", "study_id", "vec", "dtype", "shape", "problem"]).astype({"study_id": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root).select("path", "content")
    read = files.mapInPandas(load, f"path string, {schemas.VECTOR}, dtype string, shape string, problem string")
    good = read.filter("problem is null").select("study_id", "vec", "dtype", "shape")
    return good, read.filter("problem is not null").select(relative_path(F.col("path"), root).alias("path"), "problem")


def read_vectors(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """(study_id, vec) of the readable files; ``read_vector_files`` also tells which are not."""
    return read_vector_files(spark, root, pattern)[0].select("study_id", "vec")


def parse_history(text: Column) -> Column:
    """Nested history from its JSON text; null, '', '[]' and broken text give an empty array."""
    return F.coalesce(F.from_json(text, schemas.HISTORY), F.array().cast(schemas.HISTORY))
