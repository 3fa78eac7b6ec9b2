"""N-gram Jaccard join with count-vector R-trees.

A document's set holds the hashes of its distinct word shingles; equal sets are one vertex. All shingles have one
common order, rare ones first, and a set's join keys are its first shingles in it: two sets that link share so many
shingles that at least one of the shared ones is among the first few of both (prefix filter), whatever the order
is. Tokens are also hashed into groups, which gives every set a point of ``GROUPS`` counts. Sets that share a key
are looked up in an R-tree over these points: the sum of the coordinate minima of two points - or of a point and
the upper corner of a box - bounds their overlap from above, boxes and points below the needed overlap are pruned,
and surviving pairs are verified on the sets themselves.

The order comes from counts of all shingles of all texts in ``2 ** order_bits`` hashed cells, a table of fixed size:
shingles that share a cell share a count, which moves some keys and loses no link. It keeps lines and passages that
many documents share out of the keys.

Families of near copies share many keys, so not all pairs are made. First every key's members are compared with
the one member that shares most keys, as the original of a family does. Only members that are then still in
different components are looked up in the R-tree of their key; keys with many members are split into blocks, and
blocks meet pairwise in tasks of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.arrays import chunks, lower_table, mix, space_table, word_bounds, word_hashes
from studyloom.llm.suffix_dedup import keyed
from studyloom.session import cut_lineage

GROUPS = 256
LEAF = 16
BLOCK_MEMBERS = 2048
#: Pairs of points compared at once.
STEP = 1 << 13
ORDER_BITS = 22
CELL_BLOCK = 1 << 16
#: A byte that belongs to a word.
NOT_SPACE = r"[^\x20\x09-\x0D]"
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the rows' offsets in them."""
    starts, ends, rows = word_bounds(data, offsets, space_table())
    n = len(offsets) - 1
    words = word_hashes(lower_table()[data], starts, ends, seed=23)
    count = np.bincount(rows, minlength=n)
    few = (count > 0) & (count < size)
    last = max(len(words) - size + 1, 0)
    whole = rows[:last] == rows[size - 1 :] if last else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        joined = words[:last].copy()
        for i in range(1, size):
            joined = mix(joined * _A + words[i : last + i])
        joined, owner = joined[whole], rows[:last][whole]
        short = []
        for row in np.flatnonzero(few):
            at = np.searchsorted(rows, row)
            value = np.uint64(count[row])
            for word in words[at : at + count[row]]:
                value = mix(np.array([value * _B + word]))[0]
            short.append(value)
    joined = np.concatenate([joined, np.array(short, np.uint64)])
    owner = np.concatenate([owner, np.flatnonzero(few)])
    order = np.lexsort((joined, owner))
    joined, owner = joined[order], owner[order]
    new = np.ones(len(joined), bool)
    new[1:] = (joined[1:] != joined[:-1]) | (owner[1:] != owner[:-1])
    joined, owner = joined[new], owner[new]
    return joined, np.searchsorted(owner, np.arange(n + 1))


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap with which sets of sizes a and b link."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's n shingles, in the common order, are join keys; 0 if only an equal set can link.

    Of two linked sets of a <= b shingles the smaller misses at most a - needed(a, a) of the shared ones, the larger
    at most b - needed(least a, b); one more than the larger number is enough for every set in either role.
    """
    if 100 * n < percent * (n + 1):
        return 0
    least = -((-percent * n) // 100)
    return n - int(needed(least, n, percent)) + 1


def keys_of(found: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of one set: its rarest shingles by ``count``, ties by hash."""
    return found[np.lexsort((found, count))[: prefix_length(len(found), percent)]]


def point_of(found: np.ndarray) -> bytes:
    """Counts per group, in two bytes each where all fit, else in four."""
    counts = np.bincount((found & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes()


def points_from(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), GROUPS), np.uint32)
    for i, row in enumerate(rows):
        out[i] = np.frombuffer(row, np.uint16 if len(row) == 2 * GROUPS else np.uint32)
    return out


class CountTree:
    """Packed R-tree over count points; a box keeps its upper corner and the smallest set size in it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # packing order: by size, then by the counts, so that boxes stay thin where pruning needs it
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []
        upper, least, most = self.points, self.sizes, self.sizes
        while len(upper) > 1:
            cut = np.arange(0, len(upper), LEAF)
            upper, least, most = np.maximum.reduceat(upper, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((upper, least, most))

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) whose bound reaches the needed overlap."""
        query = np.arange(len(points))
        node = np.zeros(len(points), np.int64)
        for upper, least, most in reversed(self.levels):
            fits = self._fits(points, sizes, query, upper, least, most, node, percent)
            query, node = query[fits], node[fits]
            query, node = np.repeat(query, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            inside = node < self._children(upper)
            query, node = query[inside], node[inside]
        fits = self._fits(points, sizes, query, self.points, self.sizes, self.sizes, node, percent)
        return query[fits], self.order[node[fits]]

    def _children(self, upper: np.ndarray) -> int:
        for i, level in enumerate(self.levels):
            if level[0] is upper:
                return len(self.levels[i - 1][0]) if i else len(self.points)
        return len(self.points)

    @staticmethod
    def _fits(points, sizes, query, upper, least, most, node, percent):  # noqa: ANN001
        out = np.zeros(len(query), bool)
        for i in range(0, len(query), STEP):
            q, b = query[i : i + STEP], node[i : i + STEP]
            bound = np.minimum(points[q], upper[b]).sum(1, dtype=np.int64)
            other = np.maximum(least[b], -((-percent * sizes[q]) // 100))
            out[i : i + STEP] = (other <= most[b]) & (bound >= needed(sizes[q], other, percent)) & (100 * sizes[q] >= percent * least[b])
        return out


def shingle_counts(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """In how many rows the shingles of every one of ``2 ** bits`` hash cells occur, at most 65,535.

    Cells are added up task by task, then block by block over a shuffle; ``bits`` alone bounds what comes back.
    """
    cells = 1 << bits
    block = min(cells, CELL_BLOCK)

    def batch(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts), (pa.int32(), pa.binary()))], ["block", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.uint32)
        for _, data, offsets in chunks(batches):
            np.add.at(own, (shingle_sets(data, offsets, size)[0] >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        for i in range(0, cells, block):
            if (part := own[i : i + block]).any():
                yield batch([(i // block, zlib.compress(part.tobytes(), 1))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for i, data in zip(*(c.to_pylist() for c in rows.columns)):
                part = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            yield batch([(i, zlib.compress(np.minimum(part, 65535).astype(np.uint16).tobytes(), 1))])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = keyed(docs).mapInArrow(count, "block int, data binary").repartition(parts, "block").mapInArrow(add, "block int, data binary")
    out = np.zeros(cells, np.uint16)
    for rows in summed.toArrow().to_batches():  # at most the table's own size
        for i, data in zip(*(c.to_pylist() for c in rows.columns)):
            out[i * block : (i + 1) * block] = np.frombuffer(zlib.decompress(data), np.uint16)
    return out


def _described(docs: DataFrame, size: int, percent: int, order_bits: int) -> DataFrame:
    """k1, k2, doc_id, sid (null for an empty set), n, point and join keys of every row."""
    names = ["k1", "k2", "doc_id", "sid", "n", "point", "keys"]
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, size, order_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            found, cuts = shingle_sets(data, offsets, size)
            sids: list[int | None] = []
            points, keys = [], []
            count = counts.value[(found >> np.uint64(64 - order_bits)).astype(np.int64)]
            with np.errstate(over="ignore"):
                spread = mix(found ^ _B)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    own = found[a:b]
                    name = mix(np.array([spread[a:b].sum() * _A + np.uint64(b - a)])).view(np.int64)[0]
                    sids.append(int(name) if b > a else None)
                    points.append(point_of(own))
                    keys.append(keys_of(own, count[a:b], percent).view(np.int64))
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(sids, pa.int64()), pa.array(np.diff(cuts), pa.int64())]
            columns += [pa.array(points, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, sid long, n long, point binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """sid and shingle hashes of the rows (k1, k2) that stand for the wanted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            found, cuts = shingle_sets(data, offsets, size)
            values = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["sid", "set"])

    # merged at every size: the wanted rows grow with the table, so they are never broadcast; repeated rows lie together
    found = keyed(docs).join(wanted.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return found.select("sid", "text").mapInArrow(run, "sid long, set array<long>")


def _possible(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that neither set sizes nor points rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (points_from(batch.column(i).to_pylist()) for i in (4, 5))
            bound = np.minimum(a, b).sum(1, dtype=np.int64)
            fits = bound >= needed(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(fits)) for i in (0, 1)], ["a", "b"])

    one, two = (vertices.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("point").alias(f"p{s}")) for s in "ab")
    near = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return near.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, vertices: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; only the sets of these pairs are made."""
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = vertices.select("sid", "k1", "k2").join(ends, "sid", "left_semi")
    sets = cut_lineage(_sets(docs, wanted, size), "shingles")
    one = sets.select(F.col("sid").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("sid").alias("b"), F.col("set").alias("sb"))
    overlap = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - overlap
    linked = pairs.join(one, "a").join(two, "b").filter(100 * overlap.cast("long") >= percent * union.cast("long"))
    return cut_lineage(linked.select("a", "b"), "links")


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """sid and comp, the smallest sid that links reach: minima of neighbours, then a jump to the label's label."""
    edges = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut_lineage(vertices.select("sid", F.col("sid").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["sid"]).groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(near, labels["sid"] == near["a"], "left").select("sid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        moved = cut_lineage(moved, "labels")
        if moved.filter("comp <> old").isEmpty():
            return moved.select("sid", "comp")
        jump = moved.select(F.col("sid").alias("comp"), F.col("comp").alias("further"))
        labels = cut_lineage(moved.join(jump, "comp").select("sid", F.col("further").alias("comp")), "labels")


def _looked_up(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that the R-tree of a key cannot rule out.

    ``members`` has key, place, sid, comp, n, point; ``place`` counts a set's keys in the common order from 0. A key
    that is the first shared one of a pair leaves an overlap of at most the shingles from its places on, so a pair
    for which they are too few does not leave here: it cannot link, or does leave with an earlier key. Keys with more
    than BLOCK_MEMBERS members are dealt into blocks.
    """
    many = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    placed = members.join(many, "key").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "comp", "n", "point", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch | None:
            i, j = held[0][1:3]
            comp = np.array([r[5] for r in held], np.int64)
            if len(held) < 2 or (comp == comp[0]).all():
                return None
            own, sid = np.array([r[3] for r in held]), np.array([r[4] for r in held], np.int64)
            n = np.array([r[6] for r in held], np.int64)
            points = points_from([r[7] for r in held])
            rest = n - np.array([r[8] for r in held], np.int64)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                return None
            q, m = CountTree(points[right], n[right]).search(points[left], n[left], percent)
            q, m = left[q], right[m]
            open_ = (comp[q] != comp[m]) & (np.minimum(rest[q], rest[m]) >= needed(n[q], n[m], percent))
            a, b = sid[q[open_]], sid[m[open_]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    if (found := flush()) is not None:
                        yield found
                    held.clear()
                held.append(row)
        if held and (found := flush()) is not None:
            yield found

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(docs: DataFrame, size: int = 3, percent: int = 90, order_bits: int = ORDER_BITS) -> DataFrame:
    """k1, k2, doc_id, n_shingles, component_id, label of every row.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased; a set holds the distinct runs
    of ``size`` words, a shorter text is one shingle, and null, empty and blank texts have an empty set that links
    with nothing. Sets link when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id
    that links reach (null if all are null); repeated rows and equal texts are in one component. Ids do not link, so
    components of unrelated texts may have one ``component_id``; ``label`` tells components apart (null for an empty
    set). An empty table gives an empty result; other input columns are not read. ``order_bits`` sizes the table that orders shingles and
    changes no result.
    """
    rows = cut_lineage(_described(docs, size, percent, order_bits), "sets")
    known = rows.filter("n > 0").select("sid", F.posexplode("keys").alias("place", "key"))
    shared = known.groupBy("key").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).filter("x <> y").select("key")
    members = cut_lineage(known.join(shared, "key").distinct(), "members")  # a set has each key at one place
    degree = members.groupBy("sid").agg(F.count("*").alias("degree"))
    vertices = rows.filter("n > 0").groupBy("sid").agg(F.min(F.struct("k1", "k2", "n", "point")).alias("at")).join(degree, "sid")
    vertices = cut_lineage(vertices.select("sid", "degree", "at.*"), "vertices")
    center = members.join(vertices.select("sid", "degree"), "sid").groupBy("key").agg(F.max(F.struct("degree", "sid"))["sid"].alias("center"))
    stars = members.join(center, "key").filter("sid <> center").select(*_ordered("sid", "center")).distinct()
    stars = cut_lineage(stars, "stars")
    possible = cut_lineage(_possible(stars, vertices, percent), "pairs")
    links = _verified(docs, possible, vertices, size, percent)
    comp = components(vertices, links)
    placed = members.join(comp, "sid")
    # of keys with the same members only the first in the common order can be the first shared one of a pair
    same = [F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"same{i}") for i in (0, 1)]
    unsettled = placed.groupBy("key").agg(
        F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.min("place").alias("place"), *same
    )
    unsettled = unsettled.filter("x <> y and n > 2").groupBy("n", "same0", "same1").agg(F.min(F.struct("place", "key"))["key"].alias("key"))
    left = placed.join(unsettled.select("key"), "key").join(vertices.select("sid", "n", "point"), "sid")
    pairs = cut_lineage(_looked_up(left, percent).join(stars, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        more = _verified(docs, pairs, vertices, size, percent)
        if not more.isEmpty():
            comp = components(vertices, links.unionByName(more))
    labelled = rows.join(comp, "sid", "left").withColumn("label", F.coalesce("comp", "sid"))
    least = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = labelled.join(least, "label", "left")
    return out.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "label")


def digest_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, for 3-word shingles and 90 percent."""
    return linked(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents, the one of the smallest id, with its columns as they were.

    Repeated rows count as a group; documents without words are all kept, repeated rows too. Only texts link: equal or
    null ids join no group.
    """
    found = linked(docs, size, percent).select("k1", "k2", "n_shingles", "label", F.col("doc_id").alias("__id"))
    best = found.filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "k2")).alias("best"))
    chosen = best.select(F.coalesce("best.__id", F.lit(0).cast("long")).alias("k1"), F.col("best.k2").alias("k2"))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    has_words = F.coalesce(F.col("text").cast("string").rlike(NOT_SPACE), F.lit(False))
    names = {"__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "__k2": F.xxhash64(text, F.col("doc_id").isNull())}
    rows = docs.filter(has_words).withColumns(names)
    rows = rows.join(chosen.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left_semi")
    kept = rows.dropDuplicates(["__k1", "__k2"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.filter(~has_words))
