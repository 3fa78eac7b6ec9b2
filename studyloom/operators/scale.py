"""Skew-safe building blocks shared by the operators.

Every function here keeps a key that owns a large share of the rows from ending
in one task: rows are split by (key, bucket) first, each bucket is reduced to one
row, and only those reduced rows meet in a per-key window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
#: Bucket of rows that have none; it comes before all others, as null does.
NO_BUCKET = -(2**63)


def micros(ts: Column | str) -> Column:
    """Timestamp (with or without zone) as microseconds since the epoch."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions by key into ``spark.sql.shuffle.partitions`` tasks.

    The explicit number keeps adaptive execution from merging small partitions:
    for rows that are cheap to move and costly to process.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of every key.

    The filter on ``row_number`` lets Spark place a group limit before the shuffle,
    so a hot key sends at most ``k`` rows per map task.
    """
    ranked = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank_col) <= k)


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    sums: Mapping[str, Column],
    inclusive: bool = False,
) -> DataFrame:
    """Sums over all rows of the key that come strictly before each order value.

    One output row per (keys, order). ``bucket`` must not decrease as ``order``
    grows; it only decides how the work is spread, never the result.
    """
    keys = list(keys)
    # rows without bucket go first and get no sum; a number instead of null lets both sides of the join read one shuffle
    none = F.lit(NO_BUCKET)
    points = (
        df.withColumn("__b", F.coalesce(bucket, none))
        .groupBy(*keys, "__b", order)
        .agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
    )
    inner = Window.partitionBy(*keys, "__b").orderBy(order)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    outer = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        points.groupBy(*keys, "__b")
        .agg(*[F.sum(name).alias(f"__t_{name}") for name in sums])
        .select(*keys, "__b", *[F.sum(f"__t_{name}").over(outer).alias(f"__o_{name}") for name in sums])
    )
    live = F.max("__b").over(Window.partitionBy(*keys, "__b").orderBy(order)).alias("__live")
    local = points.repartition(*keys, "__b")
    local = local.select(*keys, "__b", order, live, *[F.sum(name).over(inner).alias(name) for name in sums])
    zero = F.lit(0)
    return local.join(offsets, [*keys, "__b"]).filter(F.col("__live") != none).select(
        *keys,
        order,
        *[(F.coalesce(name, zero) + F.coalesce(f"__o_{name}", zero)).alias(name) for name in sums],
    )


def with_prefix_sum(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, value: Column, name: str) -> DataFrame:
    """``df`` plus ``name``: the sum of ``value`` over the key's rows that come strictly before the row's order value.

    The same sums as ``prefix_sums``, for rows that carry a payload: they move once, to their bucket, and only one
    reduced row per bucket meets them there. Rows without key or bucket are left out, as by its join.
    """
    keys = list(keys)
    rows = df.withColumn("__b", bucket)
    outer = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "__b").agg(F.sum(value).alias("__total"))
    offsets = offsets.select(*keys, "__b", F.sum("__total").over(outer).alias("__before"))
    upto = F.sum(value).over(Window.partitionBy(*keys, "__b").orderBy(order))
    same = F.sum(value).over(Window.partitionBy(*keys, "__b", order))
    zero = F.lit(0)
    local = rows.repartition(*keys, "__b").withColumn(name, F.coalesce(upto, zero) - F.coalesce(same, zero))
    out = local.join(offsets, [*keys, "__b"]).withColumn(name, F.col(name) + F.coalesce("__before", zero))
    return out.drop("__b", "__before")


def last_n_before(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, bucket: Column, payload: Sequence[str], n: int
) -> DataFrame:
    """The ``n`` latest rows strictly before each order value of the key.

    One output row per (keys, order) with ``previous``, an array of at most ``n``
    payload structs, oldest first. Rows sharing the order value are not included.
    """
    keys = list(keys)
    packed = F.struct(order, tie, *payload).alias("__row")
    base = df.select(*keys, order, tie, bucket.alias("__b"), packed)

    def latest(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        kept = top_k(rows, by, [F.col(order).desc(), F.col(tie).desc()], n)
        return kept.groupBy(*by).agg(F.array_sort(F.collect_list("__row")).alias("__rows"))

    def carried(window) -> Column:
        lags = [F.coalesce(F.lag("__rows", i).over(window), F.array()) for i in range(n, 0, -1)]
        return F.concat(*lags)

    points = latest(base, [*keys, "__b", order])
    inner = points.select(
        *keys, "__b", order, carried(Window.partitionBy(*keys, "__b").orderBy(order)).alias("__local")
    )
    outer = latest(base, [*keys, "__b"]).select(
        *keys, "__b", carried(Window.partitionBy(*keys).orderBy("__b")).alias("__carry")
    )
    both = F.concat("__carry", "__local")
    tail = F.when(F.size(both) > n, F.slice(both, -n, n)).otherwise(both)
    return inner.join(outer, [*keys, "__b"]).select(*keys, order, tail.alias("previous"))


def next_row(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], payload: Sequence[str]
) -> DataFrame:
    """Adds ``next``: the payload of the row that follows within the key.

    Rows are ordered by ``bucket`` ascending and then by ``order``.
    """
    keys = list(keys)
    packed = F.struct(*payload)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    rows = df.withColumn("__lead", F.lead(packed).over(inner)).withColumn("__n", F.row_number().over(inner))
    heads = rows.filter(F.col("__n") == 1).select(*keys, bucket, packed.alias("__head"))
    heads = heads.select(
        *keys, bucket, F.lead("__head").over(Window.partitionBy(*keys).orderBy(bucket)).alias("__after")
    )
    return (
        rows.join(heads, [*keys, bucket])
        .withColumn("next", F.coalesce("__lead", "__after"))
        .drop("__lead", "__n", "__after")
    )
