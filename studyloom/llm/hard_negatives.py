"""Hard-negative mining by Four-Russians scoring.

Vectors become integers and are stored as bit planes in two's complement: plane p holds bit p of every component,
eight components to a byte. For an anchor and each group of eight dimensions a table of 256 entries holds the sums
of the anchor's components over every subset of the group. A candidate's byte is an index into it, so the inner
product with one plane is a sum of one lookup per group, and the exact score is the sum over the planes, each
shifted by its place; the sign plane counts negatively.

Both scoring passes run on a grid of blocks. Candidates and anchors are dealt into blocks of a bounded number of
rows, and each cell of the grid is one task's group. The first pass finds an anchor's positives and only meets
candidates of its own label; the second finds the negatives in the score window below each positive. A cell emits
at most ``positives`` rows per anchor, then ``negatives`` rows per anchor and positive; windows rank what is left.
Rows are told apart by where they stand, not by id, so a label, id or vector that a third of all rows
share fills its blocks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.session import cut_lineage

GROUP = 8
#: Rows of a block of candidates and of anchors.
CANDIDATES, ANCHORS = 4096, 512
#: Anchors whose tables are in use at a time: 64 x 256 sums for each group stay in a core's cache.
SLICE = 64
#: A whole number's hundredth, rounded down.
_FLOOR = "({0} - pmod({0}, 100)) div 100"
PACKED = "row long, id long, label string, dims int, planes binary, anchor boolean"


def pack_planes(ints: np.ndarray) -> list[bytes]:
    """Bit planes of each row of (rows, dims) integers, lowest plane first, the sign plane last."""
    n, dims = ints.shape
    padded = np.zeros((n, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = ints
    span = np.where(padded < 0, ~padded, padded).max(axis=1, initial=0)
    width = np.array([int(x).bit_length() + 1 for x in span])
    planes = np.stack([np.packbits(((padded >> min(p, 63)) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(width.max(initial=1))], 1)
    return [planes[i, :w].tobytes() for i, w in enumerate(width)]


def stack_planes(blobs: list[bytes], dims: np.ndarray, groups: int) -> np.ndarray:
    """(planes, groups, rows) bytes: missing dimensions are zero and a shorter row repeats its sign plane."""
    own = np.maximum(1, -(-dims // GROUP))
    wide = np.array([len(b) for b in blobs]) // np.maximum(1, -(-dims // GROUP)) if len(blobs) else np.zeros(0, int)
    wide = np.where(dims == 0, 1, wide)
    out = np.zeros((max(1, int(wide.max(initial=1))), groups, len(blobs)), np.uint8)
    for w, g in {*zip(wide.tolist(), own.tolist())}:
        at = np.flatnonzero((wide == w) & (own == g) & (dims > 0))
        if len(at):
            rows = np.frombuffer(b"".join(blobs[i] for i in at), np.uint8).reshape(len(at), w, g).transpose(1, 2, 0)
            out[:w, :g, at] = rows
            out[w:, :g, at] = rows[-1]
    return out


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The integers, (groups, eight, rows), of stacked planes."""
    bits = np.unpackbits(planes[:, :, None, :], axis=2, bitorder="little").astype(np.int64)
    out = -bits[-1]
    for plane in bits[-2::-1]:
        out = (out << 1) + plane
    return out


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """(groups, 256, anchors): the sums of an anchor's (groups, eight, anchors) components over every subset."""
    groups, _, n = anchors.shape
    table = np.zeros((groups, 1, n), dtype)
    for d in range(GROUP):
        table = np.concatenate([table, table + anchors[:, d : d + 1].astype(dtype)], axis=1)
    return np.ascontiguousarray(table)


def scores(planes: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every slice of anchors its first one and the exact scores, (candidates, anchors of the slice)."""
    groups, n = planes.shape[1], planes.shape[2]
    most = int(np.abs(anchors).max(initial=0)) << (planes.shape[0] - 1)
    dtype = np.int32 if most * groups * GROUP < 2**31 else np.int64
    for first in range(0, anchors.shape[2], SLICE):
        table = subset_sums(anchors[:, :, first : first + SLICE], dtype)
        total = np.zeros((n, table.shape[2]), dtype)
        part = np.empty_like(total)
        for p in range(planes.shape[0] - 1, -1, -1):
            sign = np.subtract if p == planes.shape[0] - 1 else np.add
            total <<= 1
            for g in range(groups):
                np.take(table[g], planes[p, g], axis=0, out=part, mode="clip")
                sign(total, part, out=total)
        yield first, total


def packed_rows(rows: DataFrame, is_anchor: Column, scale: float) -> DataFrame:
    """The rows that take part, as ``PACKED``: floor(scale * component) in bit planes."""
    picked = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    picked = picked.filter("id is not null and label is not null and vec is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(3)
            flat, size = vec.flatten(), np.diff(vec.offsets.to_numpy())
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
            row = np.repeat(np.arange(len(size)), size)
            good = np.bincount(row[~np.isfinite(values)], minlength=len(size)) == 0
            ints = np.floor(np.where(np.isfinite(values), values, 0) * scale).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            blobs: list[bytes | None] = [None] * len(size)
            for d in np.unique(size[good]):
                at = np.flatnonzero(good & (size == d))
                for i, blob in zip(at, pack_planes(ints[start[at][:, None] + np.arange(d)]) if d else [b""] * len(at)):
                    blobs[i] = blob
            keep = pa.array(good)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(size, pa.int32()), pa.array(blobs, pa.binary()), batch.column(4)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["row", "id", "label", "dims", "planes", "anchor"])

    return picked.mapInArrow(run, PACKED)


class Cell:
    """The candidates and anchors of one cell, candidates in id order."""

    def __init__(self, left: pa.Table, right: pa.Table):
        dims = [t.column("dims").to_numpy().astype(np.int64) for t in (left, right)]
        groups = max(1, -(-max(int(d.max(initial=0)) for d in dims) // GROUP))
        self.row, ident = (right.column(c).to_numpy() for c in ("row", "id"))
        order = np.lexsort((self.row, ident))
        blobs = right.column("planes").to_pylist()
        self.planes = stack_planes([blobs[i] for i in order], dims[1][order], groups)
        self.row, self.id = self.row[order], ident[order]
        names = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks], pa.string()).dictionary_encode().combine_chunks()
        codes = (names.indices if isinstance(names, pa.DictionaryArray) else names.chunk(0).indices).to_numpy()
        self.own, self.label = codes[: left.num_rows], codes[left.num_rows :][order]
        self.anchors = left
        self.components = unpack_planes(stack_planes(left.column("planes").to_pylist(), dims[0], groups))

    def scored(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every anchor's place and its scores with all candidates of the cell."""
        for first, total in scores(self.planes, self.components):
            for a, column in enumerate(total.T):
                yield first + a, np.ascontiguousarray(column).astype(np.int64)


def _positives(left: pa.Table, right: pa.Table, keep: int) -> pa.Table:
    cell = Cell(left, right)
    rows, ids = left.column("row").to_numpy(), left.column("id").to_numpy()
    out: list[tuple] = []
    for a, s in cell.scored():
        at = np.flatnonzero((cell.label == cell.own[a]) & (cell.row != rows[a]))
        if len(at) > keep:  # all rows that reach the last place, then by id
            at = at[s[at] >= np.partition(s[at], len(at) - keep)[len(at) - keep]]
        at = at[np.argsort(-s[at], kind="stable")][:keep]
        out += [(rows[a], ids[a], cell.id[i], s[i]) for i in at]
    return _table(out, ("row", "anchor_id", "positive_id", "positive_score"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)})


def _negatives(left: pa.Table, right: pa.Table, keep: int) -> pa.Table:
    cell = Cell(left, right)
    rows, wanted = left.column("row").to_numpy(), left.column("wanted").to_pylist()
    out: list[tuple] = []
    for a, s in cell.scored():
        spans = [(x["lowest"], x["highest"]) for x in wanted[a]]
        at = np.flatnonzero((cell.label != cell.own[a]) & (s >= min(lo for lo, _ in spans)) & (s <= max(hi for _, hi in spans)))
        at = at[np.argsort(-s[at], kind="stable")]
        fallen = -s[at]
        for lo, hi in spans:
            first = int(np.searchsorted(fallen, -hi, "left"))
            for i in at[first : first + keep]:
                if s[i] < lo:
                    break
                out.append((rows[a], lo, hi, cell.id[i], s[i]))
    return _table(out, ("row", "lowest", "highest", "negative_id", "negative_score"))


def _dealt(df: DataFrame, block: str, blocks: int) -> DataFrame:
    return df.withColumn(block, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))


def _copied(df: DataFrame, block: str, blocks: int) -> DataFrame:
    return df.withColumn(block, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    block: tuple[int, int] = (CANDIDATES, ANCHORS),
) -> DataFrame:
    """Hard negatives of the rows that ``is_anchor`` marks, from all rows (vec_id, embedding, label).

    A component x counts as floor(scale * x), and a score is the integer inner product with the anchor, exact while
    it fits 64 bits. Higher scores come first, ties by smaller vec_id. An anchor's positives are its first
    ``positives`` other rows of the same label; for each, the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned, so a positive of negative
    score has none (with ``low`` < ``high``).

    Output: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null vec_id or label, a null vector or a null or non-finite component take no part. Components that
    a shorter vector lacks count as 0. Repeated rows are rows of their own: an anchor row excludes only itself, and
    an anchor that occurs twice has its result twice. Other columns are not read; an empty table has no result.
    """
    packed = cut_lineage(packed_rows(rows, is_anchor, scale), "planes")
    sizes = packed.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"))
    sizes = sizes.agg(*[F.coalesce(f(c), F.lit(0)).alias(f"{k}_{c}") for c in "na" for k, f in (("sum", F.sum), ("max", F.max))]).first()
    grid = lambda kind: [max(1, ceil(sizes[f"{kind}_{c}"] / b)) for c, b in zip("na", block)]
    anchors = packed.filter("anchor").select(*[F.col(c).alias(c) for c in packed.columns])  # columns of its own beside packed's
    cell = "row long, anchor_id long, positive_id long, positive_score long"

    n, a = grid("max")
    left = _copied(_dealt(anchors, "own", a), "block", n)
    right = _copied(_dealt(packed, "block", n), "own", a).join(anchors.select("label").distinct(), "label", "left_semi")
    keys = ["label", "own", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda x, y: _positives(x, y, positives), cell)
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    # the window of scores in whole numbers: 100 * negative lies between low and high times the positive score
    found = found.withColumn("lowest", F.expr(f"-({_FLOOR.format(f'-{low} * positive_score')})"))
    found = found.withColumn("highest", F.expr(_FLOOR.format(f"{high} * positive_score"))).filter("lowest <= highest")
    found = cut_lineage(found, "positives")

    n, a = grid("sum")
    wanted = found.groupBy("row").agg(F.collect_set(F.struct("lowest", "highest")).alias("wanted"))
    left = _copied(_dealt(anchors.join(wanted, "row"), "own", a), "block", n)
    right = _copied(_dealt(packed, "block", n), "own", a)
    cell = "row long, lowest long, highest long, negative_id long, negative_score long"
    missed = left.groupBy("own", "block").cogroup(right.groupBy("own", "block")).applyInArrow(lambda x, y: _negatives(x, y, negatives), cell)
    order = Window.partitionBy("row", "lowest", "highest").orderBy(F.desc("negative_score"), "negative_id")
    missed = missed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    result = found.join(missed, ["row", "lowest", "highest"])
    return result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def negatives_sql(positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, step: int = 100, move: int = 7) -> str:
    """The same from all scores of the anchors, for vectors of one length."""
    return (
        f"WITH w AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % {move} = 0 THEN (label + 1) % 10 ELSE label END label, "
        f"list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {scale})) v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "s AS MATERIALIZED (SELECT a.vec_id anchor_id, c.vec_id, a.label = c.label same, CAST(list_inner_product(a.v, c.v) AS BIGINT) score "
        f"FROM w a JOIN w c ON a.vec_id % {step} = 0 AND a.vec_id <> c.vec_id), "
        "p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same "
        f"QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives}) "
        "SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) rank, "
        "vec_id negative_id, positive_score, score negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same "
        f"AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score QUALIFY rank <= {negatives}"
    )
