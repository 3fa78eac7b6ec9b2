"""Corpus metrics over (id, ref, hyp) token arrays.

Pairs are partitioned by id once; n-gram rows are then counted inside that
partitioning, so the exploded rows are never shuffled by n-gram for BLEU.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import ngrams
from .scale import by_key

# constants of the public BLEU scorer
TINY, SMALL = 1e-15, 1e-9
CIDER_SIGMA = 6.0


def ngram_counts(pairs: DataFrame, key: str, ref: str = "ref", hyp: str = "hyp", max_n: int = 4) -> DataFrame:
    """(key, n, gram, h, r): occurrences of every n-gram in hypothesis and reference."""

    def tagged(col: str, n: int, h: int, r: int) -> Column:
        return F.transform(
            ngrams(F.col(col), n),
            lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"), F.lit(h).alias("h"), F.lit(r).alias("r")),
        )

    grams = [tagged(c, n, h, r) for n in range(1, max_n + 1) for c, h, r in ((hyp, 1, 0), (ref, 0, 1))]
    rows = by_key(pairs, key).select(key, F.explode(F.concat(*grams)).alias("g"))
    return rows.groupBy(key, F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(
        F.sum("g.h").alias("h"), F.sum("g.r").alias("r")
    )


def _bleu(max_n: int) -> list[Column]:
    hyp_len, ref_len = F.col("c1").cast("double"), F.col("r1").cast("double")
    ratio = (hyp_len + TINY) / (ref_len + SMALL)
    brevity = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    out, product = [], F.lit(1.0)
    for k in range(1, max_n + 1):
        product = product * (F.col(f"m{k}") + TINY) / (F.col(f"c{k}") + SMALL)
        out.append(F.round(F.pow(product, F.lit(1.0 / k)) * brevity, 6).alias(f"bleu_{k}"))
    return out


def _bleu_sums(max_n: int) -> list[Column]:
    clipped = F.least("h", "r")
    sums = [F.sum(F.when(F.col("n") == 1, F.col("r")).otherwise(0)).alias("r1")]
    for k in range(1, max_n + 1):
        of_k = F.col("n") == k
        sums.append(F.sum(F.when(of_k, clipped).otherwise(0)).alias(f"m{k}"))
        sums.append(F.sum(F.when(of_k, F.col("h")).otherwise(0)).alias(f"c{k}"))
    return sums


def corpus_bleu(counts: DataFrame, max_n: int = 4) -> DataFrame:
    """One row bleu_1..bleu_n from ``ngram_counts``."""
    return counts.agg(*_bleu_sums(max_n)).select(*_bleu(max_n))


def pair_bleu(counts: DataFrame, key: str, max_n: int = 4) -> DataFrame:
    return counts.groupBy(key).agg(*_bleu_sums(max_n)).select(key, *_bleu(max_n))


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit per token of ``a``."""
    places: dict = {}
    for i, tok in enumerate(a):
        places[tok] = places.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for tok in b:
        hit = row & places.get(tok, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """LCS length of two token arrays, in Arrow batches."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_lcs(list(s), list(t)) for s, t in zip(x, y)], dtype="int32")

    return F.pandas_udf(batch, IntegerType())(a, b)


def rouge_l(pairs: DataFrame, key: str, ref: str = "ref", hyp: str = "hyp", beta: float = 1.2) -> DataFrame:
    """ROUGE-L F per pair; 0 when a side is empty or nothing is shared."""
    lcs = pairs.select(
        key, F.size(ref).alias("m"), F.size(hyp).alias("n"), lcs_length(F.col(hyp), F.col(ref)).alias("lcs")
    )
    p, r, b2 = F.col("lcs") / F.col("n"), F.col("lcs") / F.col("m"), beta * beta
    score = F.when((F.col("m") > 0) & (F.col("n") > 0) & (F.col("lcs") > 0), (1 + b2) * p * r / (r + b2 * p))
    return lcs.select(key, F.round(F.coalesce(score, F.lit(0.0)), 6).alias("rouge_l"))


def corpus_mean(scores: DataFrame, col: str) -> DataFrame:
    return scores.agg(F.round(F.avg(col), 6).alias(col))


def pair_total(pairs: DataFrame) -> Column:
    return pairs.agg(F.count(F.lit(1))).scalar()


def document_frequency(counts: DataFrame) -> DataFrame:
    """References per n-gram; n-grams of one reference weigh the same as unseen ones and are left out."""
    return (
        counts.filter(F.col("r") > 0).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    )


def with_frequency(counts: DataFrame, df: DataFrame) -> DataFrame:
    """Adds ``df`` to every n-gram row (1 where absent).

    One join for all n-grams and sizes; the partitions of frequent n-grams are left to adaptive skew splitting,
    which a left join allows on its long side.
    """
    return counts.join(df, ["n", "gram"], "left").select(*counts.columns, F.coalesce("df", F.lit(1)).alias("df"))


def cider(counts: DataFrame, key: str, total: Column, max_n: int = 4, sigma: float = CIDER_SIGMA) -> DataFrame:
    """CIDEr-D per pair from ``ngram_counts``, document frequency over the references.

    ``total`` is the number of pairs.
    """
    rows = with_frequency(counts, document_frequency(counts))
    idf = F.ln(total.cast("double")) - F.ln(F.greatest(F.col("df"), F.lit(1)).cast("double"))
    h, r = F.col("h") * F.col("idf"), F.col("r") * F.col("idf")
    per_n = (
        rows.withColumn("idf", idf)
        .groupBy(key, "n")
        .agg(
            F.sum(F.least(h, r) * r).alias("dot"),
            F.sqrt(F.sum(h * h)).alias("nh"),
            F.sqrt(F.sum(r * r)).alias("nr"),
            F.sum("h").alias("len_h"),
            F.sum("r").alias("len_r"),
        )
    )
    # the scorer takes the number of bigrams as the length of a text
    delta = F.sum(F.when(F.col("n") == 2, F.col("len_h") - F.col("len_r")).otherwise(0))
    sim = F.when((F.col("nh") > 0) & (F.col("nr") > 0), F.col("dot") / (F.col("nh") * F.col("nr"))).otherwise(0.0)
    out = per_n.groupBy(key).agg(F.sum(sim).alias("s"), delta.alias("d"))
    penalty = F.exp(-(F.col("d") * F.col("d")) / (2 * sigma * sigma))
    return out.select(key, F.round(F.col("s") / max_n * penalty * 10, 6).alias("cider"))


def graph_f1(pairs: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """Overlap F1 of two arrays of graph keys (entities or relations) per pair; row-local."""
    a, b = F.array_distinct(ref), F.array_distinct(hyp)
    common, size = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    score = F.when(size > 0, 2 * common / size).otherwise(0.0)
    return pairs.select(key, F.round(score, 6).alias("graph_f1"))


#: What counts as equal: tokens and type; also whether the entity has a relation; also every relation as a triple.
GRAPH_LEVELS = ("simple", "partial", "complete")


def graph_keys(entities: DataFrame, relations: DataFrame, key: str, level: str = "partial") -> DataFrame:
    """(key, item): the distinct facts of every report graph.

    ``entities`` has (key, eid, tokens, entity_type), ``relations`` (key, eid, rel_type, target), where ``eid`` and
    ``target`` name entities of the same key; relations to unknown ones are no facts.
    """
    if level not in GRAPH_LEVELS:
        raise ValueError(f"level must be one of {GRAPH_LEVELS}")
    named = F.concat_ws("\u0001", F.lower("tokens"), "entity_type")
    nodes = entities.select(key, "eid", named.alias("node"))
    if level == "simple":
        return nodes.select(key, F.col("node").alias("item")).distinct()
    linked = relations.select(key, "eid").distinct().withColumn("linked", F.lit("+"))
    marked = nodes.join(linked, [key, "eid"], "left")
    items = marked.select(key, F.concat_ws("\u0001", "node", F.coalesce("linked", F.lit("-"))).alias("item"))
    if level == "complete":
        target = nodes.select(key, F.col("eid").alias("target"), F.col("node").alias("other"))
        triples = relations.join(nodes, [key, "eid"]).join(target, [key, "target"])
        items = items.unionByName(triples.select(key, F.concat_ws("\u0002", "node", "rel_type", "other").alias("item")))
    return items.distinct()


def typed_graph_f1(
    ref: tuple[DataFrame, DataFrame], hyp: tuple[DataFrame, DataFrame], key: str, level: str = "partial"
) -> DataFrame:
    """(key, graph_f1): overlap F1 of the facts of two (entities, relations) tables per key.

    A key with facts on one side only has 0, a key without facts no row. Facts meet by (key, fact), so a key with
    many of them spreads over tasks; only their counts meet per key.
    """
    sides = [graph_keys(*g, key, level).withColumn("ref", F.lit(r)).withColumn("hyp", F.lit(1 - r)) for g, r in ((ref, 1), (hyp, 0))]
    facts = sides[0].unionByName(sides[1]).groupBy(key, "item").agg(F.max("ref").alias("ref"), F.max("hyp").alias("hyp"))
    sums = facts.groupBy(key).agg(F.sum(F.col("ref") * F.col("hyp")).alias("both"), F.sum(F.col("ref") + F.col("hyp")).alias("all"))
    return sums.select(key, F.round(2 * F.col("both") / F.col("all"), 6).alias("graph_f1"))


def normal_weights(weights: Mapping[str, float], available: Mapping[str, bool]) -> dict[str, float]:
    """Weights of the available metrics, scaled to sum 1; empty when none is left."""
    kept = {m: w for m, w in weights.items() if available.get(m, False)}
    total = sum(kept.values())
    return {m: w / total for m, w in kept.items() if w > 0} if total else {}


def weighted_score(weights: Mapping[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in weights.items()])
