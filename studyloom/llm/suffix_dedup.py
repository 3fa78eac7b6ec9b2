"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Which suffixes have to meet is decided first. The *anchor* of a window of ``length`` bytes is the leftmost of its
``ANCHOR`` byte grams with the smallest hash; equal windows have equal anchors at equal places. Neighbouring
windows with one anchor form a *run*, a piece of text with the anchor's hash as its key. A window can only repeat
among the runs of its key, so keys that occur once are done (most of the corpus), and runs that are equal as a
whole are counted and kept once. What is left is shuffled by key and indexed:

* a batch of runs gets a suffix array of its window starts: ordered by the first eight bytes, and among equal
  ones by the name of the whole window. Names are doubled as in prefix doubling (8, 16, ... bytes, then
  ``length``), but by hashing instead of ranking, so the names of two arrays compare without rebuilding;
* the batch's array is merge-scanned against every level of the index; a suffix that finds an equal one there
  (a match of at least ``length`` bytes) is marked on both sides;
* the batch becomes a level; levels of about equal size are merged, so there are only logarithmically many. A
  level whose keys lie before the present batch can match nothing more and is retired.

The same works on words: a text is then the sequence of its words' 64-bit hashes, windows are counted in words, and an
anchor is the least of a window's ``WORD_ANCHOR``-word grams.

Rows travel through Spark joins and aggregates only: counts are combined before the shuffle, and equal runs of a
hot passage meet as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from studyloom.llm.arrays import byte_keys, chunks, free_name, mix, space_table, word_bounds, word_hashes
from studyloom.session import cut_lineage

ANCHOR = 32
WORD_ANCHOR = 6
PLACE_BITS = 24
BATCH_BYTES = 1 << 21
#: Runs per key above which the key's windows are dealt out by the place of their anchor.
HOT_RUNS = 20_000
#: Window starts by which a level must outgrow the next one to stay apart from it.
GROWTH = 2


def _doubled(data: np.ndarray, length: int) -> np.ndarray:
    """Name of ``data[p : p + length]`` (bytes or word hashes) for every p, by doubling."""
    names = byte_keys(29)[data] if data.dtype == np.uint8 else data
    size, step = 1, 0
    with np.errstate(over="ignore"):
        while size < length:
            shift = min(size, length - size)
            n = len(names) - shift
            if n <= 0:
                return np.zeros(0, np.uint64)
            odd = np.uint64((0x9E3779B97F4A7C15 * (2 * step + 1)) & (2**64 - 1) | 1)
            left = names[:n] * odd
            left ^= left >> np.uint64(31)
            left += names[shift : shift + n]
            names = left
            size, step = size + shift, step + 1
        return mix(names)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, one row after the other, and the rows' offsets in them."""
    starts, ends, rows = word_bounds(data, offsets, space_table())
    return word_hashes(data, starts, ends, seed=31), np.searchsorted(rows, np.arange(len(offsets)))


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Row, first window (byte or word in the row), windows, anchor's byte or word and key of every run of the rows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    found: list[tuple[np.ndarray, ...]] = []
    room = (1 << PLACE_BITS) - length
    for base in range(0, len(data) - length + 1, room):
        piece = data[base : base + room + length - 1]
        grams = _doubled(piece, gram)
        low = np.uint64((1 << PLACE_BITS) - 1)
        keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = _least(keyed, length - gram + 1)
        windows = np.arange(len(least)) + base
        row = np.searchsorted(offsets, windows, "right") - 1
        inside = windows + length <= offsets[row + 1]
        windows, row, least = windows[inside], row[inside], least[inside]
        if not len(windows):
            continue
        head = np.ones(len(windows), bool)
        head[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(head)
        anchor = (least[first] & low).astype(np.int64)
        start = offsets[row[first]]
        found.append(
            (row[first], windows[first] - start, np.diff(np.append(first, len(windows))), anchor + base - start, grams[anchor])
        )
    if not found:
        return none, none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(parts) for parts in zip(*found))


class SuffixLevels:
    """Logarithmic index of window starts; every batch is scanned against all earlier ones it can match."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        self.repeated = np.zeros(0, bool)

    def _array(self, data: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix array: heads (first eight bytes or first word), names and ids of the window starts, in order."""
        heads = np.zeros(len(starts), np.uint64) if data.dtype == np.uint8 else data[starts]
        for i in range(8 if data.dtype == np.uint8 else 0):
            heads = (heads << np.uint64(8)) | data[starts + i].astype(np.uint64)
        names = _doubled(data, self.length)[starts]
        order = np.lexsort((names, heads))
        return heads[order], names[order], ids[order]

    def _mark(self, heads: np.ndarray, names: np.ndarray, ids: np.ndarray) -> None:
        """Marks every suffix that equals a neighbour in a merged order."""
        same = (heads[1:] == heads[:-1]) & (names[1:] == names[:-1])
        self.repeated[ids[1:][same]] = True
        self.repeated[ids[:-1][same]] = True

    @staticmethod
    def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heads, names, ids = (np.concatenate(x) for x in zip(a, b))
        order = np.lexsort((names, heads))
        return heads[order], names[order], ids[order]

    def add(self, data: np.ndarray, starts: np.ndarray, key: int, last_key: int) -> None:
        """Indexes a batch of window starts whose keys go from ``key`` to ``last_key``."""
        ids = np.arange(len(self.repeated), len(self.repeated) + len(starts))
        self.repeated = np.concatenate([self.repeated, np.zeros(len(starts), bool)])
        self.levels = [level for level in self.levels if level[3] >= key]
        new = self._array(data, starts, ids)
        self._mark(*new)
        for level in self.levels:
            self._scan(new, level[:3])
        self.levels.append((*new, last_key))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < GROWTH * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append((*self._merged(a[:3], b[:3]), max(a[3], b[3])))

    def _scan(self, new: tuple[np.ndarray, ...], level: tuple[np.ndarray, ...]) -> None:
        """Merge scan: the range of equal heads of each suffix, then its name in that range."""
        left = np.searchsorted(level[0], new[0], "left")
        right = np.searchsorted(level[0], new[0], "right")
        hit = np.flatnonzero(right > left)
        lengths = (right - left)[hit]
        if lengths.sum() > 4 * (len(new[0]) + len(level[0])):  # a very common head: compare in merged order
            self._mark(*self._merged(new, level))
            return
        mine = np.repeat(hit, lengths)
        place = np.arange(len(mine)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        theirs = place + np.repeat(left[hit], lengths)
        same = new[1][mine] == level[1][theirs]
        self.repeated[new[2][mine[same]]] = True
        self.repeated[level[2][theirs[same]]] = True


def _spans(lo: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the byte spans that the windows ``lo .. lo + n - 1`` cover."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], (lo + n - 1 + length)[order]
    reach = np.maximum.accumulate(end)
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(head)
    return start[first], reach[np.append(first[1:] - 1, len(start) - 1)]


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows of (k1, k2, text as bytes, more); the keys name a row by its id and whole text."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k1"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("k2"),
        text.alias("text"),
        *more,
    )


def _runs(rows: DataFrame, length: int, words: bool) -> DataFrame:
    unit = 8 if words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "lo", "n", "anchor", "key", "content"]
        for batch, data, offsets in chunks(batches):
            if words:
                data, offsets = word_symbols(data, offsets)
            row, lo, n, anchor, key = runs_of(data, offsets, length, WORD_ANCHOR if words else ANCHOR)
            view = memoryview(data.view(np.uint8))
            begin, end = (offsets[row] + lo) * unit, (offsets[row] + lo + n + length - 1) * unit
            content = [xxhash.xxh3_64_intdigest(view[b:e]) for b, e in zip(begin.tolist(), end.tolist())]
            k1, k2 = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            columns = [k1, k2, lo.astype(np.int32), n.astype(np.int32), (anchor - lo).astype(np.int32), key.view(np.int64), np.array(content, np.uint64).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.mapInArrow(run, "k1 long, k2 long, lo int, n int, anchor int, key long, content long")


def _word_pieces(rows: DataFrame, length: int) -> DataFrame:
    """The word hashes of the windows ``wanted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "lo", "key", "many", "text", "slice"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int32()]
        for batch, data, offsets in chunks(batches):
            symbols, cuts = word_symbols(data, offsets)
            out = []
            for k1, k2, wanted, at in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), cuts.tolist()):
                for w in wanted:
                    piece = symbols[at + w["lo"] : at + w["lo"] + w["n"] + length - 1].tobytes()
                    out.append((k1, k2, w["lo"], w["key"], w["many"], piece, w["slice"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, "k1 long, k2 long, lo int, key long, many boolean, text binary, slice int")


def _index(strings: DataFrame, length: int, words: bool) -> DataFrame:
    """Window runs (k1, k2, lo, n) that the index finds repeated; input is sorted by key inside its partitions."""
    unit, kind = (8, np.uint64) if words else (1, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = SuffixLevels(length)
        names: list[tuple[int, int, int, int]] = []
        parts: list[bytes] = []
        sizes: list[int] = []
        span = [0, 0]

        def flush() -> None:
            lengths = np.array([len(p) // unit for p in parts])
            base = np.cumsum(lengths) - lengths
            n = lengths - length + 1
            starts = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            levels.add(np.frombuffer(b"".join(parts), kind), starts, *span)
            parts.clear()

        held = 0
        for batch in batches:
            for k1, k2, lo, key, many, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not parts:
                    span[0], held = key, 0
                parts.append(text)
                sizes.append(len(text) // unit - length + 1)
                names.append((k1, k2, lo, many))
                span[1] = key
                held += len(text)
                if held >= BATCH_BYTES:
                    flush()
        if parts:
            flush()
        if not names:
            return
        mark = np.concatenate([[False], levels.repeated, [False]])
        n = np.array(sizes)
        base = np.cumsum(n) - n
        edge = np.zeros(len(mark), bool)  # a run of marks ends where its string ends
        edge[base + 1] = True
        rise = np.flatnonzero(mark[1:] & (~mark[:-1] | edge[1:])) + 1
        fall = np.flatnonzero(mark[:-1] & (~mark[1:] | edge[1:]))
        owner = np.searchsorted(base, rise - 1, "right") - 1
        keep = np.array([not x[3] for x in names])[owner]
        rise, fall, owner = rise[keep], fall[keep], owner[keep]
        keys = np.array([x[:3] for x in names], np.int64)[owner]
        columns = [keys[:, 0], keys[:, 1], (keys[:, 2] + rise - 1 - base[owner]).astype(np.int32), (fall - rise + 1).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "lo", "n"])

    return strings.mapInArrow(run, "k1 long, k2 long, lo int, n int")


def repeated_windows(docs: DataFrame, length: int = 400, words: bool = False) -> DataFrame:
    """Runs of repeated windows: k1, k2 (row keys), lo (first window, byte or word of the text), n (windows).

    A window is repeated if its ``length`` bytes, or words, also start elsewhere in the table, in the same row or
    another.
    """
    rows = keyed(docs)
    runs = cut_lineage(_runs(rows, length, words), "runs")
    place = F.struct("k1", "k2", "lo", "n", "anchor").alias("first")
    strings = runs.groupBy("key", "content").agg(F.count("*").alias("times"), F.min(place).alias("first"))
    keys = runs.groupBy("key").agg(F.count("*").alias("times"), F.min("content").alias("a"), F.max("content").alias("b"))
    slices = F.least(F.ceil(F.col("times") / HOT_RUNS), F.lit(length)).cast("int").alias("slices")
    keys = keys.filter("times > 1").select("key", (F.col("a") != F.col("b")).alias("mixed"), slices)
    keys = cut_lineage(keys, "keys")
    strings = cut_lineage(
        strings.join(keys, "key").filter("mixed or times > 1").select("key", "content", "times", "first.*", "mixed", "slices"),
        "strings",
    )
    # equal runs: every window of each of them is repeated
    whole = runs.join(strings.filter("times > 1"), ["key", "content"], "left_semi").select("k1", "k2", "lo", "n")
    # windows of a hot key are dealt out by the anchor's place in them, which equal windows share
    slice_no = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    width = F.ceil(F.lit(length) / F.col("slices")).cast("int")
    sliced = strings.filter("mixed").select("*", slice_no)
    begin = F.greatest(F.lit(0), F.col("anchor") - (F.col("slice") + 1) * width + 1)
    end = F.least(F.col("n") - 1, F.col("anchor") - F.col("slice") * width)
    sliced = sliced.select("k1", "k2", "key", "slice", (F.col("lo") + begin).alias("lo"), (end - begin + 1).alias("n"), (F.col("times") > 1).alias("many"))
    wanted = (
        sliced.filter("n > 0").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n", "key", "slice", "many")).alias("wanted"))
    )
    joined = rows.join(wanted, ["k1", "k2"])
    piece = F.substring("text", F.col("w.lo") + 1, F.col("w.n") + length - 1).alias("text")
    if words:
        pieces = _word_pieces(joined.select("k1", "k2", "text", "wanted"), length)
    else:
        pieces = joined.select("k1", "k2", "text", F.explode("wanted").alias("w"))
        pieces = pieces.select("k1", "k2", "w.lo", "w.key", "w.many", piece, "w.slice")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(parts, "key", "slice").sortWithinPartitions("key", "slice").drop("slice")
    indexed = _index(pieces, length, words)
    return whole.unionByName(indexed)


def _joined(docs: DataFrame, length: int, words: bool = False) -> tuple[DataFrame, str]:
    """Every row with its repeated windows (null if it has none), and the name of their column."""
    spans, k1, k2 = (free_name(docs.columns, c) for c in ("__spans", "__k1", "__k2"))
    found = repeated_windows(docs, length, words)
    per_row = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "n")).alias(spans))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    keyed = docs.withColumns(
        {
            k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")),
            k2: F.xxhash64(text, F.col("doc_id").isNull()),
        }
    )
    per_row = per_row.withColumnsRenamed({"k1": k1, "k2": k2})
    return keyed.join(per_row, [k1, k2], "left").drop(k1, k2), spans


def _cut(text: bytes, windows: list[dict] | None, length: int, whole_chars: bool) -> tuple[bytes, list[tuple[int, int]]]:
    if not windows:
        return text, []
    lo = np.array([w["lo"] for w in windows], np.int64)
    n = np.array([w["n"] for w in windows], np.int64)
    spans = list(zip(*(x.tolist() for x in _spans(lo, n, length))))
    if whole_chars:
        inner = []
        for start, end in spans:
            while start < end and text[start] & 0xC0 == 0x80:
                start += 1
            while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
                end -= 1
            inner.append((start, end))
        spans = [s for s in inner if s[0] < s[1]]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]]), spans


def _cut_words(text: bytes, windows: list[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    if not windows:
        return text, []
    starts, ends, _ = word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]), space_table())
    lo = np.array([w["lo"] for w in windows], np.int64)
    n = np.array([w["n"] for w in windows], np.int64)
    first, last = _spans(lo, n, length)
    spans = list(zip(starts[first].tolist(), ends[last - 1].tolist()))
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]]), spans


def remove_repeats(docs: DataFrame, length: int = 400, words: bool = False) -> DataFrame:
    """Texts without the bytes that a repeated string of ``length`` bytes covers.

    With ``words`` they lose what a repeated sequence of ``length`` words covers, from its first word's first byte to
    its last word's last byte. Words are runs of bytes other than ASCII white space and are compared byte by byte; the
    white space between them is not compared.

    Output: the input columns with ``text`` cut, and ``removed_spans`` array<struct<start, end>> (bytes of the
    input text, whole characters only: a character that a span cuts stays). Null texts stay null, texts shorter
    than ``length`` stay as they are, repeated rows lose all of a text that is long enough; other columns are kept
    whatever their names, but for an input column named removed_spans, which is replaced.
    """
    names = [c for c in docs.columns if c != "removed_spans"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("removed_spans array<struct<start:long,end:long>>").fields])
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, windows = batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()
            part = (lambda t, w: _cut_words(t, w, length)) if words else (lambda t, w: _cut(t, w, length, True))
            cut = [(None, []) if t is None else part(t.encode(), w) for t, w in zip(texts, windows)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[place] = pa.array([None if c[0] is None else c[0].decode() for c in cut], pa.string())
            spans = pa.array([[{"start": a, "end": b} for a, b in c[1]] for c in cut], kind)
            yield pa.RecordBatch.from_arrays([*columns, spans], [*names, "removed_spans"])

    joined, spans = _joined(docs, length, words)
    return joined.select(*[F.col(f"`{c}`") for c in names], spans).mapInArrow(run, schema)


def digest_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """What removal does to every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Works on bytes: null counts as empty, spans may cut characters. One row per input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for doc_id, text, windows in zip(*(c.to_pylist() for c in batch.columns)):
                kept, spans = _cut(text, windows, length, False)
                out.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    text: Column = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    joined, windows = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)
    return joined.select("doc_id", text.alias("text"), windows).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
