"""Toxicity by class-conditional Kneser-Ney models.

Words and word pairs of toxic and ordinary labelled texts are counted apart. Each class has its own discounted
estimate and gives the mass that the discount frees to a continuation model that both classes share: a word is as
likely as the number of different words that it follows. So a rare expression that one class has not seen costs
both classes the same, and only what was counted speaks. A word's evidence is the difference of its log
probabilities, alone and given the word before it; a text is described by length-normalised evidence, over all
its words and over its densest short windows, and a logistic calibration turns that into a score.

Counting covers every labelled row outside the held-out fold. Counts live in hashed tables of fixed size
(``word_bits``, ``pair_bits``), are added up task by task, then block by block over a shuffle, and the sums - of a
size that the parameters bound - are broadcast for scoring. No count is clipped. The different words before a word
are counted from the distinct pairs by 64-bit hash, in a Spark aggregate that grows with the input. The calibration compares texts with models of the
other half of the labelled rows, so no text is judged by its own counts; it is fitted on at most ``max_rows``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.arrays import chunks, letter_table, lower_table, mix, row_sums, with_scores, word_bounds, word_hashes
from studyloom.session import cut_lineage

BLOCK = 1 << 14
DISCOUNT = 0.75
WINDOWS = (1, 3, 8)
FLOOR = 2.0
NAMES = ("word0", "word1", "pair0", "pair1")
#: Bits by which texts without a label are mostly told before the join: 2 MB, whatever the number of labels.
ID_BITS = 24


@dataclass(frozen=True)
class Size:
    word_bits: int = 20
    pair_bits: int = 22

    def empty(self) -> dict[str, np.ndarray]:
        words, pairs = 1 << self.word_bits, 1 << self.pair_bits
        return {name: np.zeros(words if name.startswith("word") else pairs, np.uint64) for name in NAMES}


def words_of(data: np.ndarray, offsets: np.ndarray, size: Size) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its slot, the slot and the hash of the pair with the word before it, its row.

    The first word of a row pairs with a start mark.
    """
    starts, ends, rows = word_bounds(data, offsets, letter_table())
    hashes = word_hashes(lower_table()[data], starts, ends, seed=17)
    before = np.zeros(len(hashes), np.uint64)
    before[1:] = np.where(rows[1:] == rows[:-1], hashes[:-1], np.uint64(0))
    with np.errstate(over="ignore"):
        pairs = mix(before * np.uint64(0x9FB21C651E98DF25) + hashes)
    shift = np.uint64(64 - size.word_bits), np.uint64(64 - size.pair_bits)
    return (hashes >> shift[0]).astype(np.int64), (pairs >> shift[1]).astype(np.int64), pairs, rows


def _blocks(tables: dict[str, np.ndarray], fold: int) -> Iterator[tuple[int, str, int, bytes]]:
    for name, table in tables.items():
        for i in range(0, len(table), BLOCK):
            part = table[i : i + BLOCK]
            if part.any():
                yield fold, name, i // BLOCK, zlib.compress(part.tobytes(), 1)


def _batch(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["fold", "name", "block", "data"])


BLOCK_SCHEMA = "fold int, name string, block int, data binary"


def predecessors(train: DataFrame, size: Size) -> list[np.ndarray]:
    """Different pairs that end in a word of every slot: in either half (column ``fold``) and in both together."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            words, _, pairs, rows = words_of(data, offsets, size)
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            for f in (0, 1):
                mine = (fold == f)[rows]
                pair, at = np.unique(pairs[mine], return_index=True)
                columns = [pa.array(pair.view(np.int64)), pa.array(words[mine][at].astype(np.int32)), pa.array(np.full(len(pair), 1 << f, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["pair", "slot", "half"])

    pairs = train.mapInArrow(pairs_of, "pair long, slot int, half int").groupBy("pair", "slot").agg(F.bit_or("half").alias("halves"))
    sums = [F.sum(F.when(F.col("halves").bitwiseAND(half) > 0, 1).otherwise(0)).alias(f"n{half}") for half in (1, 2, 3)]
    found = pairs.groupBy("slot").agg(*sums).toArrow()  # at most one row per slot
    out = [np.zeros(1 << size.word_bits, np.uint64) for _ in sums]
    for table, half in zip(out, (1, 2, 3)):
        table[found.column("slot").to_numpy()] = found.column(f"n{half}").to_numpy()
    return out


def count_tables(train: DataFrame, size: Size) -> list[dict[str, np.ndarray]]:
    """Summed tables of the two halves (column ``fold``) of the labelled rows (``label`` 0 or 1), and of all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [size.empty(), size.empty()]
        for batch, data, offsets in chunks(batches):
            words, pairs, _, rows = words_of(data, offsets, size)
            label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            for f in (0, 1):
                for c in (0, 1):
                    mine = ((label == c) & (fold == f))[rows]
                    for name, slots in ((f"word{c}", words[mine]), (f"pair{c}", pairs[mine])):
                        slot, times = np.unique(slots, return_counts=True)
                        own[f][name][slot] += times.astype(np.uint64)
        for f in (0, 1):
            if rows := list(_blocks(own[f], f)):
                yield _batch(rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str, int], np.ndarray] = {}
        for batch in batches:
            for fold, name, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zlib.decompress(data), np.uint64)
                if (held := sums.get((fold, name, block))) is None:
                    sums[fold, name, block] = part.copy()
                else:
                    held += part
        for (fold, name, block), part in sums.items():
            yield _batch([(fold, name, block, zlib.compress(part.tobytes(), 1))])

    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = train.mapInArrow(count, BLOCK_SCHEMA).repartition(parts, "fold", "name", "block").mapInArrow(add, BLOCK_SCHEMA)
    out = [size.empty(), size.empty()]
    for batch in blocks.toArrow().to_batches():  # at most the tables' own size
        for fold, name, block, data in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(zlib.decompress(data), np.uint64)
            out[fold][name][block * BLOCK : block * BLOCK + len(part)] = part
    out.append({k: out[0][k] + out[1][k] for k in NAMES})
    for tables, before in zip(out, predecessors(train, size)):
        tables["before"] = before
    return out


def labelled_texts(texts: DataFrame, known: DataFrame, bits: int = ID_BITS) -> DataFrame:
    """(doc_id, text, label): the inner join of texts with labels, one per id, that moves little more than it returns.

    A bit per hashed id of a label is set in a map of fixed size. Texts whose bit is not set have no label and stay where
    they are; the others travel to the join compressed, and are written so once. Texts that share a bit with another id's label only leave in the join.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    # one 64-bit word of the map per row, so at most 2 ** (bits - 6) rows
    words = known.select(slot.alias("slot")).selectExpr("cast(slot >> 6 AS int) AS word", "shiftleft(1L, cast(slot & 63 AS int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    flags = np.zeros(1 << (bits - 6), np.uint64)
    flags[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    held = texts.sparkSession.sparkContext.broadcast(flags)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            set_ = (held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            kept = batch.filter(pa.array(set_.astype(bool)))
            packed = [None if t is None else zlib.compress(t, 1) for t in kept.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(packed, pa.binary())], ["doc_id", "text"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [None if t is None else zlib.decompress(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary()), batch.column(2)], ["doc_id", "text", "label"])

    asked = texts.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"), slot.alias("slot"))
    joined = asked.mapInArrow(pack, "doc_id long, text binary").join(known, "doc_id").select("doc_id", "text", "label")
    return cut_lineage(joined, "toxic-train").mapInArrow(unpack, "doc_id long, text binary, label int").withColumn("text", F.col("text").cast("string"))


class Models:
    """Evidence of words and pairs from summed tables."""

    def __init__(self, tables: dict[str, np.ndarray]):
        follows = tables["before"].astype(np.float64)  # different words before it
        self.shared = ((follows + 0.5) / (follows.sum() + 0.5 * len(follows))).astype(np.float32)
        words = [self._discounted(tables[f"word{c}"], self.shared) for c in (0, 1)]
        self.word = (np.log(words[1]) - np.log(words[0])).astype(np.float32)
        pairs = [tables[f"pair{c}"] for c in (0, 1)]
        self.counts = [p.astype(np.min_scalar_type(p.max(initial=0))) for p in pairs]  # as narrow as the largest count allows
        self.total = [max(1.0, float(tables[f"pair{c}"].sum())) for c in (0, 1)]
        self.freed = [max(1.0, DISCOUNT * np.count_nonzero(tables[f"pair{c}"])) / self.total[c] for c in (0, 1)]

    @staticmethod
    def _discounted(counts: np.ndarray, shared: np.ndarray) -> np.ndarray:
        total = max(1.0, float(counts.sum()))
        freed = max(1.0, DISCOUNT * np.count_nonzero(counts)) / total
        return np.maximum(counts - DISCOUNT, 0) / total + freed * shared

    def evidence(self, words: np.ndarray, pairs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Toxic minus ordinary log probability of every word, alone and given the word before it."""
        alone = self.word[words].astype(np.float64)
        head = np.ones(len(rows), bool)
        head[1:] = rows[1:] != rows[:-1]
        base = self.shared[words].astype(np.float64)
        base[1:] *= np.where(head[1:], 1.0, self.shared[words[:-1]])
        both = []
        for c in (0, 1):
            seen = np.maximum(self.counts[c][pairs] - DISCOUNT, 0) / self.total[c]
            both.append(np.log(seen + self.freed[c] * base))
        given = both[1] - both[0]
        given[1:] -= np.where(head[1:], 0.0, alone[:-1])
        return alone, given

    def describe(self, data: np.ndarray, offsets: np.ndarray, size: Size) -> np.ndarray:
        """One row of features per text: means, strong evidence, and the densest windows."""
        words, pairs, _, rows = words_of(data, offsets, size)
        n = len(offsets) - 1
        count = np.bincount(rows, minlength=n)
        out = np.zeros((n, 6 + len(WINDOWS)))
        if not len(words):
            return out
        alone, given = self.evidence(words, pairs, rows)
        per_word = np.maximum(count, 1)
        strong = np.maximum(alone - FLOOR, 0)
        out[:, 0] = row_sums(alone, rows, n) / per_word
        out[:, 1] = row_sums(given, rows, n) / per_word
        out[:, 2] = np.log1p(row_sums(strong, rows, n))
        out[:, 3] = row_sums(strong, rows, n) / per_word
        out[:, 4] = np.log1p(row_sums(alone > FLOOR, rows, n))
        out[:, 5] = np.log1p(count)
        has = np.flatnonzero(count)
        heads = np.searchsorted(rows, has)
        sums = np.concatenate([[0.0], np.cumsum(alone)])
        place = np.arange(len(rows))
        for k, width in enumerate(WINDOWS):
            left = np.maximum(place + 1 - width, np.repeat(heads, count[has]))
            mean = (sums[place + 1] - sums[left]) / width
            out[has, 6 + k] = np.maximum.reduceat(mean, heads)
        return out


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the features and logistic weights (the constant last), by Newton steps."""
    mean, spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w = np.zeros(x.shape[1] + 1)
    if not len(x):
        return mean, spread, w
    a = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    keep = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return mean, spread, w


@dataclass(frozen=True)
class Toxicity:
    models: Models
    size: Size
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = (self.models.describe(data, offsets, self.size) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", size: Size = Size(), max_rows: int = 20_000
) -> Toxicity:
    """Models of all labelled rows for which ``keep`` holds; ``keep`` may name doc_id only.

    Several labels of one id: toxic if any is. Null ids and labels are left out. Without labelled rows every score
    is one half.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(keep)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")
    known = cut_lineage(known, "toxic-labels")  # read for the map of ids and in the join
    train = labelled_texts(texts, known).withColumn("fold", fold)
    *halves, both = count_tables(train, size)
    n = train.count()
    if n > max_rows:
        train = train.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    other = train.sparkSession.sparkContext.broadcast([Models(halves[1]), Models(halves[0])])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy()
            x = np.where((fold == 0)[:, None], *(m.describe(data, offsets, size) for m in other.value))
            flat = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([flat, batch.column(batch.schema.get_field_index("label"))], ["x", "label"])

    judged = train.mapInArrow(judge, "x array<double>, label int").toArrow()  # at most about max_rows short rows
    other.destroy()  # the halves' models leave the executors' disks before the whole one comes
    x = np.array(judged.column("x").to_pylist(), float).reshape(len(judged), 6 + len(WINDOWS))
    fitted = _calibrate(x, judged.column("label").to_numpy().astype(float))
    return Toxicity(Models(both), size, *fitted)


def score_toxicity(docs: DataFrame, model: Toxicity, name: str = "toxicity") -> DataFrame:
    """Adds the probability of a toxic text to every row, from its whole text alone; null counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return with_scores(docs, name, lambda data, offsets: held.value.score(data, offsets))
