"""Per-study vectors: fusion over views, pooling, integrity and duplicate checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from .scale import top_k

# fixed values: weights of the views in a fused vector
VIEW_WEIGHTS = {"PA": 1.2, "AP": 1.2, "LATERAL": 0.8, "LL": 0.8}


def view_weight(view: Column, weights: Mapping[str, float] = VIEW_WEIGHTS, default: float = 1.0) -> Column:
    out = None
    for name, w in weights.items():
        test = F.upper(view) == name
        out = F.when(test, w) if out is None else out.when(test, w)
    return out.otherwise(default) if out is not None else F.lit(default)


def pooled(rows: DataFrame, keys: Sequence[str], vec: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean vector per key (weights scaled to sum 1; plain mean without weights).

    Vectors are summed as a whole with map-side combine, so a key's vectors are
    never brought together. Rows without a vector are left out; the vectors of a
    key have one length.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    whole = array_to_vector(F.col(vec).cast("array<double>"))
    kept = rows.filter(F.col(vec).isNotNull()).select(*keys, w.alias("__w"), whole.alias("__x"))
    return kept.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("__x"), F.col("__w"))).alias(vec))


def integrity(rows: DataFrame, vec: str, expected_dim: Column, expected_rows: Column | None = None, n_rows: Column | None = None) -> DataFrame:
    """Adds ``status``: ok, missing, missing_meta, nan, inf, bad_rows or bad_dim (first that applies)."""
    v = F.col(vec)
    status = F.when(v.isNull(), "missing").when(expected_dim.isNull(), "missing_meta")
    status = status.when(V.has_nan(v), "nan").when(V.has_inf(v), "inf")
    if expected_rows is not None and n_rows is not None:
        status = status.when(n_rows != expected_rows, "bad_rows")
    return rows.withColumn("status", status.when(F.size(v) != expected_dim, "bad_dim").otherwise("ok"))


def first_views(rows: DataFrame, key: str, order: Sequence[Column], vec: str) -> DataFrame:
    """(key, a, b): vectors of the first two views of every study that has two."""
    kept = top_k(rows, [key], order, 2, "__view")
    pair = kept.groupBy(key).agg(
        F.max_by(vec, F.when(F.col("__view") == 1, 1)).alias("a"), F.max_by(vec, F.when(F.col("__view") == 2, 1)).alias("b")
    )
    return pair.filter(F.col("b").isNotNull())


def near_duplicate_views(rows: DataFrame, key: str, order: Sequence[Column], vec: str, threshold: float = 0.95) -> DataFrame:
    """Cosine of the first two views per study and whether it exceeds the threshold."""
    pair = first_views(rows, key, order, vec)
    sim = V.dot(F.col("a"), F.col("b")) / (V.norm(F.col("a")) * V.norm(F.col("b")) + 1e-8)
    out = pair.select(key, sim.alias("similarity"))
    return out.select(key, F.round("similarity", 6).alias("similarity"), (F.col("similarity") > threshold).alias("duplicate"))


def activation_map(patches: DataFrame, keys: Sequence[str], patch: str, vec: str) -> DataFrame:
    """L2 norm per patch, scaled to [0, 1] within its view.

    Only (min, max) per view is joined back, so a view's patches stay distributed.
    """
    norms = patches.select(*keys, patch, V.norm(F.col(vec)).alias("__n"))
    span = norms.groupBy(*keys).agg(F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    value = (F.col("__n") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-8)
    return norms.join(span, list(keys)).select(*keys, patch, F.round(value, 6).alias("activation"))


def concat_views(rows: DataFrame, key: str, view: str, order: Sequence[Column], vec: str, limit: int, priority: Sequence[str]) -> DataFrame:
    """Patch vectors of the best ``limit`` views end to end, with the metadata of the cut."""
    rank = F.array_position(F.array(*[F.lit(v) for v in priority]), F.upper(F.coalesce(view, F.lit(""))))
    place = F.when(rank > 0, rank).otherwise(999)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("original_num_views"))
    kept = top_k(rows, [key], [place, *order], limit, "__rank")
    packed = F.array_sort(F.collect_list(F.struct("__rank", F.col(view).alias("view"), F.col(vec).alias("vec"))))
    joined = kept.groupBy(key).agg(packed.alias("__v")).join(counts, key)
    return joined.select(
        key,
        F.flatten(F.transform("__v", lambda x: x["vec"])).alias("features"),
        F.size("__v").alias("num_views"),
        "original_num_views",
        F.transform("__v", lambda x: F.coalesce(x["view"], F.lit("None"))).alias("views"),
        (F.col("original_num_views") > limit).alias("truncated"),
    )


def shape_counts(rows: DataFrame, shape: Column, k: int = 5) -> DataFrame:
    """The ``k`` most common feature shapes."""
    return (
        rows.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "shape").limit(k)
    )


def order_statistics(rows: DataFrame, col: str, ranks: Callable[[int], Sequence[int]]) -> dict[int, float]:
    """The values at some 0-based ranks of ``col`` (nulls left out), without sorting the rows in one task.

    The values are range partitioned, ties spread by a hash, and written once; the counts of the partitions tell
    where a rank lies, and only those partitions are read again. ``ranks`` gets the number of values. Eager.
    """
    values = rows.select(F.col(col).cast("double").alias("v"), F.xxhash64(F.monotonically_increasing_id()).alias("tie")).filter("v is not null")
    spread = values.repartitionByRange("v", "tie")
    spread = cut_lineage(spread.select("v", F.spark_partition_id().alias("part")), "ranges")
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per partition
    wanted, found, start = sorted(set(ranks(sum(r["n"] for r in counts)))), {}, 0
    spans = []
    for r in counts:
        inside = [k for k in wanted if start <= k < start + r["n"]]
        if inside:
            spans.append((r["part"], start, inside))
        start += r["n"]
    if spans:
        place = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1
        near = spread.filter(F.col("part").isin([p for p, _, _ in spans])).withColumn("place", place)
        hit = reduce(lambda a, b: a | b, [(F.col("part") == p) & F.col("place").isin([k - s for k in own]) for p, s, own in spans])
        first = {p: s for p, s, _ in spans}
        found = {first[r["part"]] + r["place"]: r["v"] for r in near.filter(hit).collect()}
    return found


def exact_median(rows: DataFrame, col: str) -> float | None:
    """Median of ``col``; the mean of the two middle values of an even number, None without values. Eager."""
    found = order_statistics(rows, col, lambda n: [(n - 1) // 2, n // 2] if n else [])
    return (min(found.values()) + max(found.values())) / 2 if found else None


def similarity_summary(sims: DataFrame, col: str = "similarity", threshold: float = 0.95) -> DataFrame:
    """One row of statistics; the median is an order statistic over range partitions. Eager."""
    s = F.col(col)
    middle = F.lit(exact_median(sims, col)).cast("double")
    return sims.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(s), 6).alias("mean"),
        F.round(middle, 6).alias("median"),
        F.round(F.stddev_pop(s), 6).alias("std"),
        F.round(F.min(s), 6).alias("min"),
        F.round(F.max(s), 6).alias("max"),
        F.count_if(s > threshold).alias("n_high"),
    )


def value_distribution(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(name, n, percent) of every value, such as view counts or data types."""
    counts = rows.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(name, "n", F.round(F.col("n") / total * 100, 6).alias("percent"))


def similarity_histogram(sims: DataFrame, low: float, high: float, col: str = "similarity", bins: int = 50) -> DataFrame:
    """Rows per equal-width bin of [low, high]; the upper edge belongs to the last bin."""
    b = F.least(F.width_bucket(F.col(col), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return sims.groupBy(b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows chosen by the md5 of key and seed: the same rows for any partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)).limit(n)
