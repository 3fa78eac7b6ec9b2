"""Texts of an Arrow batch as byte arrays, and hashes of their words, without Python objects per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK_BYTES = 1 << 21
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def byte_keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``CHUNK_BYTES`` of text each, their bytes and row offsets.

    A longer text forms a slice of its own and is not cut; null counts as empty.
    """
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null(b"" if pa.types.is_binary(text.type) else "")
        if not len(text):
            continue
        width = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
        offsets = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            last = min(last, len(text))
            cut = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[cut[0] : cut[-1]], cut - cut[0]
            first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes inside one row, and the row of each."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    base = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(base)) - base
    where = np.repeat(starts, lengths) + place
    longest = int(lengths.max())
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat(byte_keys(seed)[data[where]] * powers[place], np.cumsum(lengths) - lengths)
        return mix(sums + lengths.astype(np.uint64))


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    """True for bytes that are not ASCII white space."""
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """True for ASCII letters and digits and for every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def with_scores(docs: DataFrame, name: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Adds a double column that ``score(bytes, row offsets)`` gives for the rows of a slice of texts.

    An input column of that name is replaced; rows are independent and stay in their partitions.
    """
    names = [c for c in docs.columns if c != name]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score(data, offsets), pa.float64())], [*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
