"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A text's features are its word uni- and bigrams and the uni- and bigrams of its word shapes (letters, capitals
and digits folded, a mark where a word repeats the one before it), hashed into ``2 ** bits`` slots. A feature's
value is its share of the words, so a text's score is one sparse dot product with the weights.

Training reads a bounded sample of labelled rows (``max_rows``): the ids are drawn by hash before any text moves,
so what is broadcast is at most that many ids. The sample is dealt to ``shards`` tasks; each runs FTRL-proximal
over its rows, and the weights are averaged slot by slot. The weights have a fixed size and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.arrays import chunks, mix, row_sums, space_table, with_scores, word_bounds, word_hashes

SCALE = 8.0


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3


def _shapes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[97:123] = table[128:] = 97
    table[65:91] = 65
    table[48:58] = 48
    return table


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and row of every n-gram occurrence, and the number of words of every row."""
    starts, ends, rows = word_bounds(data, offsets, space_table())
    n = np.bincount(rows, minlength=len(offsets) - 1)
    if not len(starts):
        return np.zeros(0, np.int64), rows, n
    words = word_hashes(data, starts, ends)
    # shapes: runs of one kind of character count once
    shape = _shapes()[data]
    kept = np.zeros(len(data), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[starts] = True
    kept &= space_table()[data]
    at = np.cumsum(kept)
    first = at[starts] - 1
    shapes = word_hashes(shape[kept], first, at[ends - 1], seed=13)
    joined = rows[1:] == rows[:-1]
    with np.errstate(over="ignore"):
        again = np.concatenate([[False], joined & (words[1:] == words[:-1])])
        shapes = mix(shapes + again.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        pairs = [mix(x[:-1][joined] * np.uint64(0x9FB21C651E98DF25) + x[1:][joined]) for x in (words, shapes)]
    slots = np.concatenate([words, shapes, *pairs]) >> np.uint64(64 - bits)
    late = rows[1:][joined]
    return slots.astype(np.int64), np.concatenate([rows, rows, late, late]), n


def _train(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, how: Ftrl) -> np.ndarray:
    """Weights of one pass order; the last slot beyond the features is the constant."""
    size = (1 << bits) + 1
    z, squares = np.zeros(size), np.zeros(size)

    def weights(slots: np.ndarray) -> np.ndarray:
        part = z[slots]
        return -np.sign(part) * np.maximum(np.abs(part) - how.l1, 0) / ((how.beta + np.sqrt(squares[slots])) / how.alpha + how.l2)

    for epoch in range(how.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            slots, values, label = rows[i]
            w = weights(slots)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values
            old = squares[slots]
            squares[slots] = old + g * g
            z[slots] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / how.alpha * w
    return weights(np.arange(size))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """doc_id, text, label of at most about ``max_rows`` labelled rows for which ``keep`` holds.

    Ids are drawn by hash; several labels of one id are averaged, null ids and labels are left out.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.avg("label").alias("label"))
    )
    n = ids.count()
    if n > max_rows:
        ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(ids), "doc_id")  # at most about max_rows ids


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    keep: Column,
    label: str = "quality",
    bits: int = 18,
    max_rows: int = 16_000,
    shards: int = 8,
    how: Ftrl = Ftrl(),
) -> np.ndarray:
    """Weights of the classifier, the constant last; all zero (score 0.5) where nothing is labelled."""
    sample = labelled_sample(docs, labels, label, keep, max_rows)
    sample = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        rows: list[tuple[np.ndarray, np.ndarray, float]] = []
        for batch, data, offsets in chunks(iter(table.to_batches())):
            slots, owner, n = features(data, offsets, bits)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(offsets)))
            for i, y in enumerate(batch.column(batch.schema.get_field_index("label")).to_pylist()):
                own, counts = np.unique(slots[order[cuts[i] : cuts[i + 1]]], return_counts=True)
                rows.append((np.append(own, 1 << bits), np.append(counts * (SCALE / max(n[i], 1)), 1.0), y))
        w = _train(rows, bits, how)
        used = np.flatnonzero(w)
        return pa.table({"slot": used.astype(np.int32), "weight": w[used] / shards})

    parts = sample.groupBy("shard").applyInArrow(train, "slot int, weight double")
    out = np.zeros((1 << bits) + 1)
    for row in parts.groupBy("slot").agg(F.sum("weight").alias("weight")).toArrow().to_batches():
        out[row.column(0).to_numpy()] = row.column(1).to_numpy()
    return out


def score_quality(docs: DataFrame, weights: np.ndarray, name: str = "quality_score") -> DataFrame:
    """Adds the probability of label 1 to every row.

    Null and empty texts have no features and get the score of the constant alone. Texts are read whole; the score
    depends on the text only.
    """
    bits = (len(weights) - 1).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        slots, rows, n = features(data, offsets, bits)
        dots = row_sums(held.value[slots], rows, len(offsets) - 1) * SCALE / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(dots + float(held.value[-1]), -35, 35)))

    return with_scores(docs, name, score)


def held_out(remainder: int, folds: int, doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id, as text, leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == remainder, F.lit(False))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows that score at least ``threshold``, with their columns as they were."""
    weights = fit_quality(docs, labels, ~held_out(0, 5))
    scored = score_quality(docs, weights, "__score")
    return scored.filter(F.col("__score") >= threshold).drop("__score")
