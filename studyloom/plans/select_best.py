"""Best-of-N job: score candidate reports against the reference and keep the best per study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from ..operators import metrics as M
from ..operators.findings import findings_of

#: (entities, relations) of the references and of the candidates
Graphs = tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
WEIGHTS = {"graph_f1": 0.4, "label_f1": 0.4, "bleu_4": 0.2}


def score_candidates(
    candidates: DataFrame, *, key: str, text: str, reference: str, keywords: Sequence[tuple[str, str]] = (), graphs: Graphs | None = None
) -> DataFrame:
    """Adds graph_f1, label_f1 and bleu_4 to (key, cand_ord, text, reference) rows.

    ``graph_f1`` compares the entities and relations of ``graphs``, given for the references and the candidates and
    both keyed by (key, cand_ord); it is null without them. ``label_f1`` compares keyword labels.
    """
    clean = lambda c: T.metric_clean(F.col(c), drop_bare_commands=False)
    rows = candidates.withColumn("__id", F.struct(key, "cand_ord"))
    pairs = rows.select(*candidates.columns, "__id", clean(reference).alias("__r"), clean(text).alias("__h"))
    pairs = pairs.filter((F.col("__r") != "") & (F.col("__h") != ""))
    pairs = pairs.withColumn("ref", F.split("__r", " ")).withColumn("hyp", F.split("__h", " "))
    bleu = M.pair_bleu(M.ngram_counts(pairs, "__id"), "__id").select("__id", "bleu_4")
    if graphs:
        keyed = [tuple(t.withColumn("__id", F.struct(key, "cand_ord")) for t in g) for g in graphs]
        graph = M.typed_graph_f1(*keyed, "__id")
        graph = pairs.select("__id").join(graph, "__id", "left").fillna(0.0, ["graph_f1"])
    else:
        graph = pairs.select("__id", F.lit(None).cast("double").alias("graph_f1"))
    names = lambda c: F.transform(findings_of(F.col(c), keywords), lambda f: f["finding"])
    if keywords:
        labels = M.graph_f1(pairs.withColumn("a", names("__r")).withColumn("b", names("__h")), "__id", "a", "b")
        labels = labels.withColumnRenamed("graph_f1", "label_f1")
    else:
        labels = pairs.select("__id", F.lit(0.0).alias("label_f1"))
    out = rows.join(bleu, "__id", "left").join(graph, "__id", "left").join(labels, "__id", "left")
    return out.drop("__id").fillna(0.0, ["bleu_4", "label_f1", *(["graph_f1"] if graphs else [])])


def select_best(
    candidates: DataFrame,
    done: DataFrame | None = None,
    *,
    key: str = "study_id",
    keywords: Sequence[tuple[str, str]] = (),
    graphs: Graphs | None = None,
) -> DataFrame:
    """Prediction rows (key, real_report, generated_report, selected_method), ids in ``done`` left out.

    The weights of metrics that cannot be had (graphs, keywords) are shared out over the others.
    """
    todo = candidates if done is None else candidates.join(done.select(key), key, "left_anti")
    shown = todo.withColumn("text", F.concat(F.lit("FINDINGS: "), T.display_clean(F.col("text"))))
    shown = shown.withColumn("reference", T.squeeze(F.col("reference")))
    scored = score_candidates(shown, key=key, text="text", reference="reference", keywords=keywords, graphs=graphs)
    best = C.best_of_n(scored, key, WEIGHTS, {"graph_f1": graphs is not None, "label_f1": bool(keywords), "bleu_4": True})
    return best.select(
        key,
        F.col("reference").alias("real_report"),
        F.col("text").alias("generated_report"),
        F.col("method").alias("selected_method"),
    )
