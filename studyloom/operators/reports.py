"""Cleaning jobs over a table of raw reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T

VALID, TOXIC, QUALITY = "valid", "rejected_toxic", "rejected_quality"


def route_reports(reports: DataFrame, raw: str = "report_raw", min_chars: int = 5) -> DataFrame:
    """Adds ``status``, ``findings_filled``, ``report`` and ``findings``.

    Rejected rows keep null texts. The cheap rejection test stands in its own
    projection, so the cascades run only on rows that pass it.
    """
    cut = T.sections(F.col(raw))
    base = reports.withColumn("__cut", cut).select(
        *reports.columns,
        T.basic_clean(F.col("__cut.findings")).alias("__f0"),
        T.basic_clean(F.col("__cut.impression")).alias("__i0"),
    )
    toxic = T.is_rejected_content(F.concat_ws(" ", "__f0", "__i0"))
    body = F.when(F.col("__f0") != "", F.col("__f0")).otherwise(F.col("__i0"))
    other = F.when(F.col("__i0") != "", F.col("__i0")).otherwise(F.col("__f0"))
    base = base.withColumn("__toxic", toxic)
    base = base.select(
        *reports.columns,
        "__toxic",
        ((F.col("__f0") == "") & (F.col("__i0") != "") & ~F.col("__toxic")).alias("findings_filled"),
        F.when(~F.col("__toxic") & (body != ""), body).alias("__f"),
        F.when(~F.col("__toxic") & (body != ""), other).alias("__i"),
    )
    joined = F.concat(F.lit("Findings: "), F.col("__f"), F.lit(" Impression: "), F.col("__i"))
    cleaned = base.select(
        *reports.columns,
        "__toxic",
        "findings_filled",
        T.repair_punctuation(T.remove_benign_noise(joined)).alias("__report"),
        T.repair_punctuation(T.remove_view_phrases(T.remove_benign_noise(F.col("__f")))).alias("__findings"),
    )
    short = F.coalesce(F.length("__findings") < min_chars, F.lit(True))
    status = F.when(F.col("__toxic"), TOXIC).when(short, QUALITY).otherwise(VALID)
    valid = F.col("status") == VALID
    return cleaned.withColumn("status", status).select(
        *reports.columns,
        "status",
        "findings_filled",
        F.when(valid, F.col("__report")).alias("report"),
        F.when(valid, F.col("__findings")).alias("findings"),
    )


def build_counters(routed: DataFrame) -> DataFrame:
    """One row of counters over routed reports."""
    return routed.agg(*_counters())


def _counters() -> list[Column]:
    is_ = lambda s: F.col("status") == s
    return [
        F.count(F.lit(1)).alias("file_verified"),
        F.count_if(is_(VALID)).alias("reports_cleaned"),
        F.count_if(is_(TOXIC)).alias("rejected_toxic"),
        F.count_if(is_(QUALITY)).alias("rejected_quality"),
        F.count_if("findings_filled").alias("findings_filled"),
        F.count_if(is_(VALID)).alias("final_records"),
    ]


def write_routed(routed: DataFrame, path: str) -> DataFrame:
    """Writes the valid reports as Parquet and returns the counters of all, measured in the same run."""
    seen = Observation("build counters")
    columns = [c for c in routed.columns if c not in ("status", "findings_filled")]
    routed.observe(seen, *_counters()).filter(F.col("status") == VALID).select(*columns).write.parquet(path)
    return routed.sparkSession.createDataFrame([tuple(seen.get.values())], ", ".join(f"{name} long" for name in seen.get))


def change_counts(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows changed by cleaning, count and percent per column; null-safe, so null to null is no change."""
    total = F.count(F.lit(1))
    out = [total.alias("total")]
    for name, (before, after) in pairs.items():
        changed = F.count_if(~before.eqNullSafe(after))
        out += [changed.alias(f"{name}_changed"), F.round(changed / total * 100, 6).alias(f"{name}_changed_pct")]
    return df.agg(*out)


def text_profile(df: DataFrame, sides: dict[str, str], short: int = 20) -> DataFrame:
    """Quality profile of text columns: empties, short texts, length statistics and a verdict."""
    lengths = {name: F.length(T.strip(F.coalesce(F.col(col), F.lit("")))) for name, col in sides.items()}
    first, last = list(sides)[0], list(sides)[-1]
    base = df.select(*[expr.alias(f"__{n}") for n, expr in lengths.items()])
    aggs = [F.count(F.lit(1)).alias("total_lines")]
    ok = F.lit(True)
    for n in sides:
        c = F.col(f"__{n}")
        ok = ok & (c > 0)
        aggs += [
            F.count_if(c == 0).alias(f"empty_{n}"),
            F.count_if((c > 0) & (c < short)).alias(f"very_short_{n}"),
            F.round(F.avg(c), 6).alias(f"mean_{n}"),
            F.median(c).alias(f"median_{n}"),
            F.min(c).cast("bigint").alias(f"min_{n}"),
            F.max(c).cast("bigint").alias(f"max_{n}"),
        ]
    aggs.append(F.count_if(ok).alias("valid_lines"))
    valid, total = F.col("valid_lines"), F.col("total_lines")
    verdict = (
        F.when(valid == 0, "no valid samples")
        .when(valid < total * 0.5, "more than half invalid")
        .when(F.col(f"very_short_{last}") > valid * 0.3, "many short generated texts")
        .otherwise("good")
    )
    return base.agg(*aggs).withColumn("verdict", verdict)
