"""Label tables: normalisation, distributions, weights and agreement scores.

Wide label columns are unpivoted to (id, label_name, value) so that everything
is keyed by label name; all reductions are plain aggregates with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import prefix_sums

MICRO = "(micro)"


def normalise(value: Column, strict: bool = False) -> Column:
    """-1 (uncertain) to 0.5, null to 0; ``strict`` also maps everything but 0, 0.5, 1 to 0."""
    v = value.cast("double")
    out = F.when(v.isNull() | F.isnan(v), 0.0).when(v == -1.0, 0.5)
    return out.when(v == 1.0, 1.0).otherwise(0.0) if strict else out.otherwise(v)


def is_known(value: Column) -> Column:
    """True where a raw label was given."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def to_long(wide: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    cast = wide.select(key, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return cast.unpivot(key, list(names), "label_name", "value")


def distribution(labels: DataFrame) -> DataFrame:
    """Positives (> 0.5) and their percentage per label, over normalised labels."""
    n, pos = F.count(F.lit(1)), F.count_if(F.col("value") > 0.5)
    return labels.groupBy("label_name").agg(
        n.alias("n"), pos.alias("positives"), F.round(pos / n * 100, 6).alias("positive_pct")
    )


def class_weights(labels: DataFrame, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Inverse-frequency weight per label, mean 1, clipped to [low, high]; 1 before scaling without positives."""
    counts = labels.groupBy("label_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0.5).alias("positives")
    )
    every = Window.partitionBy(F.lit(0))  # one row per label from here on
    n_labels = F.count(F.lit(1)).over(every)
    raw = F.when(F.col("positives") > 0, F.col("n") / (n_labels * F.col("positives"))).otherwise(1.0)
    scaled = counts.withColumn("raw", raw).withColumn("scaled", F.col("raw") / F.avg("raw").over(every))
    weight = F.least(F.greatest(F.col("scaled"), F.lit(low)), F.lit(high))
    return scaled.select("label_name", "positives", F.round(weight, 6).alias("weight"))


def abnormal_counts(labels: DataFrame, key: str, no_finding: str, threshold: float = 0.5) -> DataFrame:
    """Positive labels per study, the 'nothing found' label aside."""
    positive = (F.col("value") > threshold) & (F.col("label_name") != no_finding)
    return labels.groupBy(key).agg(F.count_if(positive).alias("n_abnormal"))


def abnormal_histogram(counts: DataFrame, upto: int = 5) -> DataFrame:
    total = F.sum("n_studies").over(Window.partitionBy(F.lit(0)))
    hist = counts.groupBy("n_abnormal").agg(F.count(F.lit(1)).alias("n_studies"))
    hist = hist.withColumn("pct", F.round(F.col("n_studies") / total * 100, 6))
    return hist.filter(F.col("n_abnormal") <= upto)


def merge_labels(studies: DataFrame, wide: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Left join; studies without labels get zeros and ``has_labels`` false."""
    marked = wide.select(key, *names, F.lit(True).alias("has_labels"))
    return studies.join(marked, key, "left").fillna({**{n: 0.0 for n in names}, "has_labels": False})


def probability_profile(scores: DataFrame) -> DataFrame:
    """Per label: mean and population variance of the probability, share in [0.4, 0.6], known rows."""
    p = F.col("prob")
    return scores.groupBy("label_name").agg(
        F.round(F.avg(p), 6).alias("prob_mean"),
        F.round(F.var_pop(p), 6).alias("prob_var"),
        F.round(F.avg(p.between(0.4, 0.6).cast("int")), 6).alias("frac_mid"),
        F.count_if(F.col("y") != 0.5).alias("n_known"),
    )


def _known_counts(scores: DataFrame) -> DataFrame:
    """(label_name, prob, pos, neg) over known rows, plus the pooled label ``MICRO``."""
    positive = F.col("y") > 0.5
    per_label = (
        scores.filter(F.col("y") != 0.5)
        .groupBy("label_name", "prob")
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )
    pooled = per_label.groupBy("prob").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return per_label.unionByName(pooled.select(F.lit(MICRO).alias("label_name"), "prob", "pos", "neg"))


def auroc(scores: DataFrame, min_known: int = 10) -> DataFrame:
    """AUROC per label and pooled; null with one class only or fewer than ``min_known`` rows.

    Equal to the average-rank formula. Rows are counted per distinct probability
    first, and negatives below a probability come from bucketed prefix sums, so no
    task ever sorts a whole label.
    """
    counts = _known_counts(scores)
    p = F.col("prob")
    logit = F.floor(F.ln((p + 1e-9) / (1 - p + 1e-9)) * 32)  # only spreads the work
    below = prefix_sums(counts, ["label_name"], "prob", logit, {"neg_below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    joined = counts.join(below, ["label_name", "prob"])
    out = joined.groupBy("label_name").agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins")
    )
    enough = (F.col("n_pos") + F.col("n_neg") >= min_known) | (F.col("label_name") == MICRO)
    valid = (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & enough
    return out.select(
        "label_name",
        (F.col("n_pos") + F.col("n_neg")).alias("n_known"),
        F.round(F.when(valid, F.col("wins") / (F.col("n_pos") * F.col("n_neg"))), 6).alias("auroc"),
    )


def best_threshold(scores: DataFrame, steps: int = 201, micro_steps: int = 401) -> DataFrame:
    """Threshold with the best F1 per label on an even grid over [0, 1]; the lowest wins on ties.

    Probabilities collapse to their grid cell before anything is sorted, so the
    cumulative counts run over at most ``micro_steps`` rows per label.
    """
    counts = _known_counts(scores)
    cells = F.when(F.col("label_name") == MICRO, micro_steps - 1).otherwise(steps - 1)
    counts = counts.withColumn("cells", cells).withColumn("step", F.lit(1.0) / F.col("cells"))
    guess = F.floor(F.col("prob") * F.col("cells"))
    at = lambda i: i * F.col("step")
    cell = F.when(at(guess + 1) <= F.col("prob"), guess + 1).when(at(guess) > F.col("prob"), guess - 1).otherwise(guess)
    binned = counts.groupBy("label_name", "cells", "step", cell.alias("cell")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    grid = binned.groupBy("label_name", "cells", "step").agg(F.sum("pos").alias("n_pos"))
    grid = grid.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells").cast("bigint"))))
    above = Window.partitionBy("label_name").orderBy(F.col("cell").desc())
    zero = F.lit(0)
    full = grid.join(binned.drop("cells", "step"), ["label_name", "cell"], "left")
    full = full.withColumn("tp", F.sum(F.coalesce("pos", zero)).over(above))
    full = full.withColumn("fp", F.sum(F.coalesce("neg", zero)).over(above))
    denominator = 2 * F.col("tp") + F.col("fp") + (F.col("n_pos") - F.col("tp"))
    f1 = F.when(denominator > 0, 2 * F.col("tp") / denominator).otherwise(0.0)
    full = full.withColumn("f1", F.round(f1, 12))
    return full.groupBy("label_name").agg(
        F.round(F.max("f1"), 6).alias("best_f1"),
        F.round(F.max_by(at(F.col("cell")), F.struct("f1", -F.col("cell"))), 6).alias("best_threshold"),
    )


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return p, r, f


def _confusion(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    t, h = F.col("truth") == 1, F.col("pred") == 1
    return pairs.groupBy(*keys).agg(
        F.count_if(t & h).alias("tp"), F.count_if(~t & h).alias("fp"), F.count_if(t & ~h).alias("fn")
    )


def micro_prf(pairs: DataFrame) -> DataFrame:
    """Micro precision, recall, F1 over (truth, pred) rows; positive means exactly 1."""
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return _confusion(pairs, []).select(
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")
    )


def pair_f1(pairs: DataFrame, key: str) -> DataFrame:
    """Binary F1 over the labels of each pair, 0 when undefined."""
    f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    return _confusion(pairs, [key]).select(key, F.round(f, 6).alias("label_f1"))
