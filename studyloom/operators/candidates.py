"""Prompt assembly and best-of-N selection.

Gating and injection are row-local: a study carries its label probabilities as a
map from label name to probability, so no join by position can go wrong.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import label_names as N
from ..conf import prompts as P
from ..functions.text import strip
from .metrics import normal_weights, weighted_score


def probability_map(soft_labels: DataFrame, key: str) -> DataFrame:
    """(key, probs): label name -> probability, from (key, label_name, prob)."""
    entries = F.collect_list(F.struct("label_name", "prob"))
    return soft_labels.groupBy(key).agg(F.map_from_entries(entries).alias("probs"))


def contained_label(text: Column, names: Sequence[str] = N.EVALUATION_ORDER) -> Column:
    """First label name contained in the text, ignoring case; null where there is none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(n.lower()), n) for n in names])


def label_of_finding(text: Column, names: Sequence[str] = N.EVALUATION_ORDER, fuzzy=N.FUZZY, critical=N.CRITICAL) -> Column:
    """Struct (label, critical) of a finding name: containment first, then the fuzzy table."""
    low = F.lower(text)
    exact = contained_label(text, names)
    near = F.coalesce(*[F.when(low.contains(k), F.struct(F.lit(n).alias("label"), F.lit(c).alias("critical"))) for k, n, c in fuzzy])
    hit = F.struct(exact.alias("label"), exact.isin(list(critical)).alias("critical"))
    return F.when(exact.isNotNull(), hit).otherwise(near)


def finding_lines(raw: Column, names: Sequence[str] = N.EVALUATION_ORDER) -> Column:
    """Array of (name, text): one per line holding a label name, or per comma item without line breaks."""
    entry = lambda name, text: F.struct(name.alias("name"), text.alias("text"))
    r = F.coalesce(raw, F.lit(""))
    lines = F.transform(F.split(r, "\n"), lambda x: entry(contained_label(x, names), strip(x)))
    lines = F.filter(lines, lambda x: x["name"].isNotNull())
    items = F.filter(F.transform(F.split(r, ","), strip), lambda x: x != "")
    items = F.transform(items, lambda x: entry(strip(F.substring_index(x, "[", 1)), x))
    return F.when(r.contains("\n"), lines).otherwise(items)


def gate(lines: Column, probs: Column, threshold: float = P.GATE_THRESHOLD) -> Column:
    """Lines whose label is critical, unknown, or more probable than the threshold."""

    def keep(x: Column) -> Column:
        label = label_of_finding(x["name"])
        likely = F.coalesce(F.try_element_at(probs, label["label"]), F.lit(0.0)) > threshold
        return label.isNull() | F.coalesce(label["critical"], F.lit(False)) | likely

    return F.filter(lines, keep)


def injected_labels(
    probs: Column,
    present: Column,
    names: Sequence[str] = N.EVALUATION_ORDER,
    threshold: float = P.HIGH_CONFIDENCE,
    device_threshold: float | None = P.SUPPORT_DEVICES_CONFIDENCE,
    skip: Sequence[str] = (),
) -> Column:
    """Very probable labels that no present text contains, joined by commas.

    Without ``device_threshold`` support devices are treated like any other label.
    """

    def holds(name: str):
        return lambda t: F.lower(t).contains(name.lower())

    shown = []
    for name in names:
        if name in skip:
            continue
        device = name == N.SUPPORT_DEVICES and device_threshold is not None
        bar = device_threshold if device else threshold
        likely = F.coalesce(F.try_element_at(probs, F.lit(name)), F.lit(0.0)) > bar
        absent = ~F.exists(present, holds(name))
        shown.append(F.when(likely & absent, N.SUPPORT_DEVICES_TEXT if device else name))
    return F.concat_ws(", ", F.array_compact(F.array(*shown)))


def gated_context(raw: Column, probs: Column) -> Column:
    """Struct (text, injected) of the ensemble prompts."""

    def build(kept: Column) -> Column:
        return F.struct(
            F.concat_ws("\n", F.transform(kept, lambda x: x["text"])).alias("text"),
            injected_labels(probs, F.transform(kept, lambda x: x["name"])).alias("injected"),
        )

    return F.transform(F.array(gate(finding_lines(raw), probs)), build)[0]


def gated_context_simple(raw: Column, probs: Column, threshold: float = P.GATE_THRESHOLD) -> Column:
    """Struct (text, injected) of the single-pass prompts: no critical labels, both '' for empty input."""
    r = F.coalesce(raw, F.lit(""))
    parts = F.when(r.contains("\n"), F.split(r, "\n")).otherwise(F.split(r, ","))
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")

    def keep(x: Column) -> Column:
        label = contained_label(x)
        return label.isNull() | ~(F.coalesce(F.try_element_at(probs, label), F.lit(0.0)) < threshold)

    def build(kept: Column) -> Column:
        extra = injected_labels(probs, kept, device_threshold=None, skip=(N.NO_FINDING,))
        return F.struct(F.concat_ws(", ", kept).alias("text"), F.when(r != "", extra).otherwise("").alias("injected"))

    return F.transform(F.array(F.filter(parts, keep)), build)[0]


def fill_template(template: str, **fields: Column) -> Column:
    pieces, rest = [], template
    while rest:
        at = min((rest.find("{" + f + "}") for f in fields if "{" + f + "}" in rest), default=-1)
        if at < 0:
            pieces.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(fields[name], F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def expand_strategies(studies: DataFrame, strategies=P.STRATEGIES) -> DataFrame:
    """One row per study and strategy: adds cand_ord, method, use_kg1, use_kg2."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("cand_ord"), F.lit(n).alias("method"), F.lit(a).alias("use_kg1"), F.lit(b).alias("use_kg2"))
            for i, (n, a, b) in enumerate(strategies)
        ]
    )
    return studies.select("*", F.inline(rows))


def ensemble_prompt(history: Column, kg1: Column, kg2: Column, probs: Column, use_kg1: Column, use_kg2: Column) -> Column:
    """Prompt text. History counts only with its section marker; retrieval context only without history."""
    hist = strip(F.coalesce(history, F.lit("")))
    has = (hist != "") & hist.contains(P.HISTORY_MARKER)
    shown = F.when(has, F.substring(hist, 1, 1500)).otherwise(P.NO_HISTORY)
    first = F.when(use_kg1 & ~has, F.coalesce(kg1, F.lit(""))).otherwise("")
    first = F.substring(strip(F.replace(first, F.lit(P.REFERENCE_LEAD), F.lit(""))), 1, 150)
    empty = F.struct(F.lit("").alias("text"), F.lit("").alias("injected"))
    second = F.when(use_kg2, gated_context(kg2, probs)).otherwise(empty)
    context = F.transform(F.array(second), lambda s: strip(F.concat_ws("\n", s["text"], s["injected"], first)))[0]
    return fill_template(P.ENSEMBLE_TEMPLATE, kg_context=context, history=shown)


def single_prompt(history: Column, kg1: Column, kg2: Column, probs: Column) -> Column:
    hist = F.coalesce(history, F.lit(""))
    shown = F.when(hist != "", F.substring(hist, 1, 1500)).otherwise(P.NO_HISTORY)

    def build(s: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.when(s["text"] != "", F.concat(F.lit("Similar Cases: "), s["text"])),
            F.when(s["injected"] != "", F.concat(F.lit("AI Detected: "), s["injected"])),
            F.when(kg1 != "", F.concat(F.lit("Reference: "), F.substring(kg1, 1, 200))),
        )

    context = F.transform(F.array(gated_context_simple(kg2, probs)), build)[0]
    context = F.when(context != "", context).otherwise(P.NO_CONTEXT)
    return fill_template(P.SINGLE_TEMPLATE, kg_context=context, history=shown)


def training_prompt(history: Column) -> Column:
    hist = F.coalesce(history, F.lit(""))
    shown = F.when(F.length(hist) > 5, strip(hist)).otherwise(P.NO_HISTORY_TRAINING)
    return fill_template(P.TRAINING_TEMPLATE, history=F.substring(shown, 1, 2000))


def best_of_n(candidates: DataFrame, key: str, weights: Mapping[str, float], available: Mapping[str, bool] | None = None) -> DataFrame:
    """Best candidate per key by weighted score; the first on ties.

    A ``max_by`` aggregate: one row per key and map task reaches the shuffle.
    """
    active = normal_weights(weights, available or {m: True for m in weights})
    score = weighted_score(active) if active else F.lit(0.0)
    scored = candidates.withColumn("weighted_score", score)
    keep = [c for c in scored.columns if c != key]
    order = F.struct("weighted_score", -F.col("cand_ord"))
    return scored.groupBy(key).agg(F.max_by(F.struct(*keep), order).alias("b")).select(key, "b.*")
