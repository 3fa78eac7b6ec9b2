"""Sharding along a Hilbert curve over document metadata.

Source, language and size are quantised to ``BITS`` bits each and give a place on the curve; documents are sorted
by it and the order is cut into shards, so a shard covers a small box of all dimensions and readers can skip
files by any of them. Law ``rows``: shard sizes differ by one row at most. Documents of equal text take the place
of their group's smallest (source, language), so copies stand together and only cuts can part them.

No text is shuffled. The order comes from a range partitioning by (curve, text hash, id), which splits a group of
any size; a row's rank is its place in its partition plus the rows of the partitions before, and of those only
one number per partition meets in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.session import cut_lineage

BITS = 6
SIZE_STEPS = 1 << BITS


def hilbert_index(points: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Place of integer points on a Hilbert curve of ``bits`` bits per dimension.

    The transposed form of Skilling (2004): undo the excess work from the top bit down, Gray-code the result,
    then interleave the bits.
    """
    x = [np.array(p, np.int64) for p in points]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_bit, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> bit) & 1)
    return out


def _step(value: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds that a value reaches."""
    if not bounds:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda n, b: n + (value >= b).cast("int"))


def shard_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Adds __size, __crc32, __curve, __rank, __shard and __slot to doc_id, source and lang of every row.

    Null metadata are a value of their own, null texts count as empty, repeated rows get neighbouring ranks, and
    other input columns are not carried. An empty table gives an empty result; with fewer rows than shards the
    last shards stay empty.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (F.octet_length(text) + 8).cast("long").alias("__size"),
        F.crc32(text).alias("__crc32"),
        F.xxhash64(text).alias("__hash"),
    )
    bounds = rows.agg(F.approx_percentile("__size", [i / SIZE_STEPS for i in range(1, SIZE_STEPS)]).alias("b")).head()[0] or []
    groups = rows.groupBy("__crc32", "__hash").agg(F.min(F.struct(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))).alias("__first"))
    placed = rows.join(groups, ["__crc32", "__hash"])
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS)).cast("int")
    placed = placed.withColumns(
        {
            "__x": code(F.col("__first")["col1"]),
            "__y": code(F.col("__first")["col2"]),
            "__z": _step(F.col("__size"), sorted(set(bounds))),
        }
    ).drop("__first")
    names = placed.columns

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("__x", "__y", "__z")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(point, BITS), pa.int64())], [*names, "__curve"])

    curved = placed.mapInArrow(curve, placed.withColumn("__curve", F.lit(0).cast("long")).schema)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["__curve", "__crc32", "__hash", "doc_id"]
    ordered = curved.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("__id", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered.drop("__x", "__y", "__z", "__hash"), "curve")
    part, place = F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1)
    # one row per partition of the range exchange
    counts = ordered.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"), F.sum("n").over(Window.partitionBy()).alias("__all"))
    ranked = ordered.withColumn("__part", part).join(F.broadcast(counts), "__part").withColumn("__rank", F.col("__before") + place)
    least, more = F.floor(F.col("__all") / shards), F.col("__all") % shards
    large = F.col("__rank") < more * (least + 1)
    rest = F.col("__rank") - more * (least + 1)
    shard = F.when(large, F.floor(F.col("__rank") / (least + 1))).otherwise(more + F.floor(rest / F.greatest(least, F.lit(1))))
    slot = F.when(large, F.col("__rank") % (least + 1)).otherwise(rest % F.greatest(least, F.lit(1)))
    return ranked.withColumns({"__shard": shard.cast("int"), "__slot": slot.cast("long")}).drop("__id", "__part", "__before", "__all")


def digest_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), curve of every row."""
    return shard_rows(docs, shards).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__curve").alias("curve"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Writes whole documents as one Parquet folder per shard, in curve order inside the files.

    The text meets its shard by row key: rows that repeat an id and a text belong together and take the smallest
    of their ranks.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = {"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__crc32": F.crc32(text)}
    placed = shard_rows(docs, shards).groupBy(F.coalesce("doc_id", F.lit(0)).alias("__k"), "__crc32").agg(F.min(F.struct("__rank", "__shard")).alias("__at"))
    joined = docs.withColumns(keys).join(placed, ["__k", "__crc32"])
    joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__at.__shard").alias("shard"), F.col("__at.__rank").alias("__rank")).repartition(
        shards, "shard"
    ).sortWithinPartitions("shard", "__rank").drop("__rank").write.partitionBy("shard").parquet(path)
