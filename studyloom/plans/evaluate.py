"""Evaluation job: one metric row for a table of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf.keywords import FINDING_KEYWORDS
from ..functions import text as T
from ..operators import labels as L
from ..operators import metrics as M
from ..operators.findings import keyword_labels
from ..session import cut_lineage
from ..sources.writers import align_metrics


def prepare(predictions: DataFrame, key: str = "study_id", order: str | None = None, dedup: bool = True) -> DataFrame:
    """(key, ref, hyp, ref_clin, hyp_clin): merged and cleaned texts, blank pairs dropped.

    Of repeated keys the last by ``order`` is kept, for all metrics alike.
    """
    rows = predictions
    if order:
        keep = [c for c in rows.columns if c != key]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*keep), order).alias("p")).select(key, "p.*")
    merged = rows.select(
        key,
        T.merge_report(F.col("real_report"), dedup).alias("real"),
        T.merge_report(F.col("generated_report"), dedup).alias("gen"),
    )
    cleaned = merged.select(
        key,
        T.metric_clean(F.col("real")).alias("ref"),
        T.metric_clean(F.col("gen")).alias("hyp"),
        T.clinical_clean(F.col("real")).alias("ref_clin"),
        T.clinical_clean(F.col("gen")).alias("hyp_clin"),
    )
    return cleaned.filter((F.col("ref") != "") & (F.col("hyp") != ""))


def label_pairs(prepared: DataFrame, key: str, keywords: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, label_name, truth, pred) by keyword labels of both texts; row-local up to the join."""
    truth = keyword_labels(prepared.select(key, "ref_clin"), "ref_clin", keywords)
    pred = keyword_labels(prepared.select(key, "hyp_clin"), "hyp_clin", keywords)
    truth = truth.select(key, "label_name", F.col("value").alias("truth"))
    return truth.join(pred.select(key, "label_name", F.col("value").alias("pred")), [key, "label_name"])


def evaluate(
    predictions: DataFrame,
    *,
    report_file: str,
    timestamp: str,
    key: str = "study_id",
    order: str | None = None,
    keywords: Sequence[tuple[str, str]] = FINDING_KEYWORDS,
    graphs: tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """One row in the metric columns. METEOR needs an external scorer and stays 0.

    ``graphs`` are the (entities, relations) of the real and of the generated reports, keyed like the predictions;
    a pair without facts counts 0, and without ``graphs`` RadGraph_F1 is null.

    Cleaning runs once and is written; every metric is one pass over that table,
    and the single-row results meet as scalars.
    """
    base = cut_lineage(prepare(predictions, key, order))
    pairs = base.select(key, F.split("ref", " ").alias("ref"), F.split("hyp", " ").alias("hyp"))
    counts = M.ngram_counts(pairs, key)
    bleu = M.corpus_bleu(counts).select(F.struct("*")).scalar()
    rouge = M.corpus_mean(M.rouge_l(pairs, key), "rouge_l").scalar()
    cider = M.corpus_mean(M.cider(counts, key, M.pair_total(base)), "cider").scalar()
    graph = F.lit(None).cast("double")
    if graphs:
        scored = base.select(key).join(M.typed_graph_f1(*graphs, key), key, "left").fillna(0.0, ["graph_f1"])
        graph = M.corpus_mean(scored, "graph_f1").scalar()
    prf = L.micro_prf(label_pairs(base, key, keywords)).select(F.struct("*")).scalar()
    row = predictions.sparkSession.range(1).select(
        F.lit(timestamp).alias("eval_timestamp"),
        F.lit(report_file).alias("report_file"),
        *[bleu[f"bleu_{k}"].alias(f"BLEU-{k}") for k in range(1, 5)],
        rouge.alias("ROUGE-L"),
        cider.alias("CIDEr"),
        graph.alias("RadGraph_F1"),
        prf["f1"].alias("CheXpert_F1"),
        prf["precision"].alias("CheXpert_P"),
        prf["recall"].alias("CheXpert_R"),
    )
    return align_metrics(row, unknown=["RadGraph_F1"])
