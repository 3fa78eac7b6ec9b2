"""Vector code compression: product codes whose codebooks are searched through memoised grid cells.

Vectors of whole numbers are cut into equal parts, and each part position has a codebook of at most ``entries``
rows. To find a part's nearest entry, its components are rounded down to multiples of ``2 ** cell_bits``: the coarse
cell. Over the cell's box every entry has a least and a greatest squared distance, sums of one term per component; an
entry whose least distance exceeds another's greatest is nowhere nearest in the box. The others are remembered
under the cell's coordinates, for the codebook at hand, and only they are compared exactly. Equal and
close parts, and a vector that a third of all rows share, thus find their few entries without bounds of their own.

A round of training is one job: tasks assign their rows' parts and return one partial sum per entry that they used,
which Spark adds up; the driver gets one row per entry. Nothing grows with the table but the assigned rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from studyloom.session import cut_lineage

#: Cells that a worker remembers per part position; beyond that it starts anew.
MEMO_CELLS = 1 << 14
#: Cells whose bounds are computed together.
BOUND_CELLS = 256


@dataclass(frozen=True)
class Codebooks:
    """One (entries, width) array of whole numbers per part position; ``scale`` is that of the components."""

    books: tuple[np.ndarray, ...]
    scale: float

    @property
    def dims(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def sha256(self) -> str:
        """Of all decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


class CellSearch:
    """Nearest entries of one codebook."""

    def __init__(self, book: np.ndarray, cell_bits: int, memo_cells: int = MEMO_CELLS):
        self.book, self.bits, self.memo_cells = book, cell_bits, memo_cells
        self.memo: dict[bytes, np.ndarray] = {}

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that may be nearest to a point of its box, in index order."""
        out: list[np.ndarray] = []
        for first in range(0, len(cells), BOUND_CELLS):
            part = cells[first : first + BOUND_CELLS]
            least, most = (np.zeros((len(part), len(self.book)), np.int64) for _ in range(2))
            for d in range(part.shape[1]):
                # a cell's term depends on one coordinate only, of which a slice has few values
                coordinate, at = np.unique(part[:, d], return_inverse=True)
                low = coordinate[:, None] << self.bits
                high = low + ((1 << self.bits) - 1)
                own = self.book[None, :, d]
                least += (np.maximum(np.maximum(low - own, own - high), 0) ** 2)[at]
                most += (np.maximum(np.abs(own - low), np.abs(own - high)) ** 2)[at]
            keep = least <= most.min(axis=1, keepdims=True)
            entry = np.nonzero(keep)[1].astype(np.int32)
            out += np.split(entry, np.cumsum(keep.sum(axis=1))[:-1])
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row (the lowest of equally near ones) and its squared distance."""
        n, width = parts.shape
        if not n or not width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        cells = np.ascontiguousarray(parts >> self.bits)
        _, first, inverse = np.unique(cells.view(f"V{8 * width}").ravel(), return_index=True, return_inverse=True)
        cells = cells[first]
        keys = [c.tobytes() for c in cells]
        found = [self.memo.get(k) for k in keys]
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            if len(self.memo) + len(missing) > self.memo_cells:
                self.memo.clear()
            for i, entries in zip(missing, self.undominated(cells[missing])):
                found[i] = entries
                if len(self.memo) < self.memo_cells:
                    self.memo[keys[i]] = entries.copy()
        lists = [found[i] for i in inverse]
        size = np.array([len(x) for x in lists])
        start = np.cumsum(size) - size
        entry, row = np.concatenate(lists), np.repeat(np.arange(n), size)
        distance = np.zeros(len(row), np.int64)
        for d in range(width):
            distance += (parts[row, d] - self.book[entry, d]) ** 2
        best = np.minimum.reduceat(distance, start)
        hit = np.flatnonzero(distance == best[row])
        hit = hit[np.concatenate([[True], row[hit[1:]] != row[hit[:-1]]])]  # entries are in index order
        return entry[hit].astype(np.int64), best


def whole_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, label and ``whole`` array<long>: floor(scale * component).

    Rows with a null vector or a null or non-finite component are left out; an empty vector stays.
    """
    picked = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")).filter("vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return picked.filter(finite).select("vec_id", "label", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale)))).alias("whole"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims); what a shorter vector lacks is 0, what a longer one has more is not used."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[place < dims], place[place < dims]] = flat[place < dims]
    return out


def _assigned(books: Codebooks, cell_bits: int, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Every batch with (parts, entries, distances) for each part position."""
    searches = [CellSearch(b, cell_bits) for b in books.books]
    for batch in batches:
        matrix = _matrix(batch.column(batch.schema.get_field_index(column)), books.dims)
        found, at = [], 0
        for search in searches:
            parts = np.ascontiguousarray(matrix[:, at : at + search.book.shape[1]])
            at += search.book.shape[1]
            found.append((parts, *search.nearest(parts)))
        yield batch, found


def _moved(whole: DataFrame, books: Codebooks, cell_bits: int) -> Codebooks:
    """The codebooks after one round: every entry that was used becomes the rounded down mean of its parts."""
    width = books.books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books.books]
        used = [np.zeros(len(b), np.int64) for b in books.books]
        for _, found in _assigned(books, cell_bits, batches, "whole"):
            for p, (parts, entry, _) in enumerate(found):
                np.add.at(sums[p], entry, parts)
                used[p] += np.bincount(entry, minlength=len(used[p]))
        for p, n in enumerate(used):
            at = np.flatnonzero(n)
            columns = [pa.array(np.full(len(at), p), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(sums[p][at]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    partial = whole.select("whole").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = [F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)]]
    moved = [b.copy() for b in books.books]
    for r in partial.groupBy("part", "entry").agg(*added).collect():
        moved[r.part][r.entry] = [r[f"s{d}"] // r.n for d in range(width)]
    return Codebooks(tuple(moved), books.scale)


def fit_codebooks(whole: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, cell_bits: int = 5, scale: float = 1024.0) -> Codebooks:
    """Codebooks of the table ``whole`` (see ``whole_vectors``).

    They start as the parts of the ``entries`` rows of smallest vec_id (equal ids in order of their vectors; fewer
    rows make fewer entries) and move ``rounds`` times; unused entries stay. Dimensions are those of the longest
    vector, filled up to a multiple of ``parts``; shorter vectors count as filled with 0. An empty table has
    codebooks without entries. Sums are exact while they fit 64 bits.
    """
    dims = whole.agg(F.max(F.size("whole"))).first()[0] or 0
    width = -(-dims // parts)
    first = [r.whole for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()]
    start = np.array([r + [0] * (parts * width - len(r)) for r in first], np.int64).reshape(len(first), parts * width)
    books = Codebooks(tuple(np.ascontiguousarray(start[:, p * width : (p + 1) * width]) for p in range(parts)), scale)
    for _ in range(rounds if len(first) and width else 0):
        books = _moved(whole, books, cell_bits)
    return books


def encode_vectors(whole: DataFrame, books: Codebooks, cell_bits: int = 5) -> DataFrame:
    """Adds ``code`` (one byte per part as two hex digits, so at most 256 entries) and ``error`` to every row.

    ``whole`` itself is dropped and other columns of these names are replaced. ``error`` is the sum of the squared
    distances of all parts. Codebooks without entries give null codes and errors.
    """
    if not len(books.books[0]):
        return whole.withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")}).drop("whole")
    kept = [c for c in whole.columns if c not in ("whole", "code", "error")]
    added = StructType.fromDDL("code string, error long").fields
    schema = StructType([*whole.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *added])
    packed = whole.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _assigned(books, cell_bits, batches, "whole"):
            code = np.stack([entry for _, entry, _ in found], 1).astype(np.uint8)
            error = sum(distance for _, _, distance in found)
            columns = [*[batch.column(i) for i in range(len(kept))], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return packed.mapInArrow(run, schema)


def decode_codes(coded: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """Adds ``vector`` array<double>, the entries that ``code`` names, back at the scale of the input.

    A null code gives null. A column ``vector`` is replaced, all others stay.
    """
    kept = [c for c in coded.columns if c != "vector"]
    schema = StructType([*coded.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *StructType.fromDDL("vector array<double>").fields])
    packed = coded.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{code}`").alias("code"))
    values = [b / books.scale for b in books.books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [None if c is None else bytes.fromhex(c) for c in batch.column(len(kept)).to_pylist()]
            found = [None if c is None else np.concatenate([v[k] for v, k in zip(values, c)]) for c in codes]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(found, pa.list_(pa.float64()))], schema.fieldNames())

    return packed.mapInArrow(run, schema)


def digest_codes(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, cell_bits: int = 5, scale: float = 1024.0) -> DataFrame:
    """Codes of all rows: vec_id, code, error, label_error (sum over equal labels, nulls together), codebooks_sha256.

    Rows are those of ``whole_vectors``. Repeated rows stay repeated; an empty table has an empty result.
    """
    whole = cut_lineage(whole_vectors(rows, scale), "whole")
    books = fit_codebooks(whole, parts, entries, rounds, cell_bits, scale)
    coded = cut_lineage(encode_vectors(whole, books, cell_bits), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by comparing every part with every entry, for vectors of one length that ``parts`` divides."""
    out = (
        f"WITH w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) whole "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        f"p AS MATERIALIZED (SELECT vec_id, part, whole[part * len(whole) // {parts} + 1 : (part + 1) * len(whole) // {parts}] v "
        f"FROM w, (SELECT unnest(range({parts})) part)), "
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 entry, v FROM p QUALIFY entry < {entries}), "
    )
    near = (
        "a{0} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) best FROM (SELECT p.vec_id, p.part, b.entry, "
        "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d FROM p JOIN b{0} b USING (part)) GROUP BY ALL), "
    )
    for r in range(rounds):
        out += near.format(r) + (
            f"m{r} AS (SELECT part, entry, list(c ORDER BY i) v FROM (SELECT p.part, a.best.entry entry, i, CAST(floor(sum(p.v[i]) / count(*)) AS BIGINT) c "
            f"FROM p JOIN a{r} a USING (vec_id, part), (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM p))) i) GROUP BY ALL) GROUP BY ALL), "
            f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) v FROM b{r} b LEFT JOIN m{r} m USING (part, entry)), "
        )
    return out + near.format(rounds) + (
        "c AS (SELECT vec_id, string_agg(printf('%02x', CAST(best.entry AS INTEGER)), '' ORDER BY part) code, CAST(sum(best.d) AS BIGINT) error "
        f"FROM a{rounds} GROUP BY vec_id) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, "
        f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) codebooks_sha256 FROM c JOIN w USING (vec_id)"
    )
