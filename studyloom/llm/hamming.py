"""Exact top-k search in binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments; the index has one row per segment value and code. In round r the queries that
are still open probe every segment with all values that differ in exactly r bits. After it every code nearer than
``segments * (r + 1)`` bits has been seen, by pigeonhole; a query is done when its k-th verified distance lies
below that bound. Radii grow until all queries are done, so the result is exact.

Equal codes are one row of the index with their smallest ids, of which a result can use ``k`` (and the query's own,
which is left out); a code that a third of all rows share is therefore one candidate.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.session import cut_lineage

CODE_BITS = 64


def sign_code(vector: Column) -> Column:
    """The signs of a vector's first 64 components as a long; a missing component counts as not positive."""
    bit = lambda i: F.when(F.get(vector, i) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    out = bit(0)
    for i in range(1, CODE_BITS):
        out = out.bitwiseOR(bit(i))
    return out


def _segments(code: Column, segments: int) -> Column:
    width = CODE_BITS // segments
    part = [F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(code, s * width).bitwiseAND((1 << width) - 1).alias("value")) for s in range(segments)]
    return F.explode(F.array(*part))


def _masks(width: int, radius: int) -> Column:
    """All values with ``radius`` of ``width`` bits, as one array: a text that the optimizer parses once, not a literal each."""
    masks = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """The k nearest rows of every query: query_id, rank (from 1), vec_id, distance.

    ``rows`` and ``queries`` have vec_id and code. Rows of equal distance are ranked by id; a row is no neighbour of
    a query with the same id. Null ids and codes take no part, repeated ids of one code count once, and with fewer
    rows than k a query gets all of them.
    """
    width = CODE_BITS // segments
    rows = rows.select("vec_id", "code").dropna().distinct()
    near = Window.partitionBy("code").orderBy("vec_id")
    kept = rows.withColumn("__n", F.row_number().over(near)).filter(F.col("__n") <= k + 1)
    codes = kept.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    codes = cut_lineage(codes.withColumn("first", F.col("ids")[0]), "codes")
    index = cut_lineage(codes.select("code", "first", F.size("ids").alias("n"), _segments(F.col("code"), segments).alias("s")).select("s.*", "code", "first", "n"), "segments")
    asked = cut_lineage(queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).dropna().distinct(), "queries")
    open_ = asked.select("query").distinct()
    done: list[DataFrame] = []
    best: DataFrame | None = None
    for radius in range(width + 1):
        probes = open_.select("query", _segments(F.col("query"), segments).alias("s")).select("query", "s.*")
        masks = F.explode(_masks(width, radius))
        probes = probes.select("query", "segment", "value", masks.alias("mask")).select("query", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        # the planner takes the probes for as few as their queries and would broadcast them
        found = probes.hint("merge").join(index, ["segment", "value"]).select("query", "code", "first", "n", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"))
        if best is not None:
            found = found.unionByName(best)
        found = found.distinct()
        order = Window.partitionBy("query").orderBy("distance", "first")
        # each code has a row at least, so the first k + 1 codes hold the k nearest rows other than the query
        found = found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k + 1).drop("__r")
        best = cut_lineage(found, "best")
        bound = segments * (radius + 1) - 1
        covered = best.filter(F.col("distance") <= bound).groupBy("query").agg(F.sum("n").alias("n")).filter(F.col("n") > k).select("query")
        closed = covered if radius < width else open_
        done.append(best.join(closed, "query", "left_semi"))
        if radius == width:
            break
        open_ = cut_lineage(open_.join(covered, "query", "left_anti"), "open")
        if open_.isEmpty():
            break
        best = best.join(open_, "query", "left_semi")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    pairs = asked.join(found.select("query", "code", "distance"), "query").join(codes.select("code", "ids"), "code")
    pairs = pairs.select("query_id", F.explode("ids").alias("vec_id"), F.col("distance").cast("int").alias("distance")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = pairs.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "distance")


def search_sql(k: int = 10, step: int = 50) -> str:
    """Brute force over the sign codes of the table embeddings, for every id that ``step`` divides."""
    code = " | ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN CAST(1 AS UBIGINT) << {i} ELSE CAST(0 AS UBIGINT) END)" for i in range(CODE_BITS))
    return (
        f"WITH c AS MATERIALIZED (SELECT DISTINCT vec_id, {code} code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), "
        f"p AS (SELECT q.vec_id query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) distance FROM c q, c WHERE q.vec_id % {step} = 0 AND q.vec_id <> c.vec_id), "
        "r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) rank, vec_id, distance FROM p) "
        f"SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {k}"
    )
