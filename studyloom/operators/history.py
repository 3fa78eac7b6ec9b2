"""As-of history of a subject: admissions and reports that precede a study.

A subject's admissions sorted by discharge form one timeline, and the history of
a study is a contiguous slice of it. Counting and summing therefore needs no pair
join: positions come from prefix sums, and arrays are assembled from fixed-size
chunks of the timeline.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import MICROS_PER_DAY, last_n_before, micros, prefix_sums, top_k, with_prefix_sum

CHUNK_ROWS = 64


def _time_bucket(col: str, bucket_days: int) -> Column:
    return F.floor(F.col(col) / F.lit(bucket_days * MICROS_PER_DAY))


def history_totals(
    studies: DataFrame,
    admissions: DataFrame,
    *,
    subject: str,
    study_time: str,
    discharge_time: str,
    sums: Mapping[str, Column],
    window_days: int | None = None,
    bucket_days: int = 32,
) -> DataFrame:
    """``studies`` plus, per entry of ``sums``, its total over the study's history.

    The history holds admissions discharged strictly before the study; with
    ``window_days`` > 0 also at most that many whole days before it. Work and
    shuffle volume are linear in both inputs whatever the subject's size.
    """
    moves = admissions.select(
        subject, micros(discharge_time).alias("__t"), *[e.alias(n) for n, e in sums.items()]
    )
    blanks = [F.lit(0).alias(n) for n in sums]
    marks = studies.select(subject, micros(study_time).alias("__t"), *blanks)
    events = moves.unionByName(marks)
    cols = {n: F.col(n) for n in sums}
    upto = prefix_sums(events, [subject], "__t", _time_bucket("__t", bucket_days), cols)
    out = studies.withColumn("__t", micros(study_time)).join(upto, [subject, "__t"], "left")
    if window_days and window_days > 0:
        shift = (window_days + 1) * MICROS_PER_DAY
        early = studies.select(subject, (micros(study_time) - F.lit(shift)).alias("__t"), *blanks)
        before = prefix_sums(
            moves.unionByName(early), [subject], "__t", _time_bucket("__t", bucket_days), cols, inclusive=True
        )
        before = before.select(
            subject, (F.col("__t") + F.lit(shift)).alias("__t"), *[F.col(n).alias(f"__w_{n}") for n in sums]
        )
        out = out.join(before, [subject, "__t"], "left")
        for n in sums:
            out = out.withColumn(n, F.col(n) - F.coalesce(f"__w_{n}", F.lit(0))).drop(f"__w_{n}")
    return out.drop("__t")


def timeline_positions(
    admissions: DataFrame, *, subject: str, discharge_time: str, tie: str, bucket_days: int = 32, weight: str | None = None
) -> DataFrame:
    """Adds ``position``: 0-based rank in the subject's timeline by (discharge, tie).

    With ``weight``, a row takes that many positions and gets its first.
    """
    rows = admissions.withColumn("__t", micros(discharge_time))
    # the tie is unique per subject, so a struct order value holds one row
    rows = rows.withColumn("__o", F.struct("__t", tie))
    bucket = F.floor(F.col("__o.__t") / F.lit(bucket_days * MICROS_PER_DAY))
    places = F.lit(1) if weight is None else F.col(weight)
    return with_prefix_sum(rows, [subject], "__o", bucket, places, "position").drop("__t", "__o")


def attach_history(
    studies: DataFrame,
    admissions: DataFrame,
    *,
    subject: str,
    study_id: str,
    study_time: str,
    discharge_time: str,
    tie: str,
    payload: Sequence[str],
    window_days: int | None = None,
    bucket_days: int = 32,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``studies`` plus ``history``, the ordered array of earlier admissions.

    The timeline is cut in chunks of ``chunk_rows`` admissions and a study fetches
    only the chunks its slice touches, so joins run on (subject, chunk) and move
    one row per chunk, not one per admission. Studies without history keep ``[]``.
    """
    keyed = dict(subject=subject, discharge_time=discharge_time, bucket_days=bucket_days)
    chunks = (
        timeline_positions(admissions, tie=tie, **keyed)
        .withColumn("__chunk", F.floor(F.col("position") / F.lit(chunk_rows)))
        .groupBy(subject, "__chunk")
        .agg(F.array_sort(F.collect_list(F.struct("position", *payload))).alias("__part"))
    )
    spans = history_totals(studies, admissions, study_time=study_time, sums={"__end": F.lit(1)}, **keyed)
    if window_days and window_days > 0:
        spans = history_totals(
            spans, admissions, study_time=study_time, sums={"__len": F.lit(1)}, window_days=window_days, **keyed
        )
        spans = spans.withColumn("__start", F.col("__end") - F.col("__len")).drop("__len")
    else:
        spans = spans.withColumn("__start", F.lit(0))
    chunk_of = lambda at: F.floor(at / F.lit(chunk_rows))
    spans = spans.withColumn("__first", chunk_of(F.col("__start"))).withColumn("__chunk", chunk_of(F.col("__end") - 1))
    inside = F.filter(
        "__part", lambda a: (a["position"] >= F.col("__start")) & (a["position"] < F.col("__end"))
    )
    packed = lambda rows: F.transform(rows, lambda a: F.struct(*[a[p].alias(p) for p in payload]))
    # a slice of one chunk is cut where chunk and study meet; of a study that is listed more than once each copy
    # counts, as in the longer slices
    wide = (F.col("__end") > F.col("__start")) & (F.col("__chunk") > F.col("__first"))
    names = [c for c in studies.columns if c not in (subject, study_id)]
    near = spans.filter(~F.coalesce(wide, F.lit(False))).repartition(subject, "__chunk")
    copies = F.count(F.lit(1)).over(Window.partitionBy(subject, "__chunk", study_id))
    near = near.withColumn("__n", copies).join(chunks, [subject, "__chunk"], "left")
    near = near.withColumn("history", packed(F.flatten(F.array_repeat(inside, F.col("__n").cast("int")))))
    far = spans.filter(wide)
    wanted = far.select(subject, study_id, "__start", "__end", F.explode(F.sequence("__first", "__chunk")).alias("__chunk"))
    parts = (
        wanted.join(chunks, [subject, "__chunk"])
        .groupBy(study_id)
        .agg(F.array_sort(F.collect_list(F.struct("__chunk", inside.alias("rows")))).alias("__parts"))
    )
    flat = F.flatten(F.transform("__parts", lambda p: p["rows"]))
    far = far.join(parts.select(study_id, packed(flat).alias("history")), study_id, "left")
    out = [study_id, subject, *names, F.coalesce("history", F.array()).alias("history")]
    return near.select(*out).unionByName(far.select(*out))


def past_reports(
    studies: DataFrame,
    *,
    subject: str,
    study_time: str,
    study_id: str,
    text: str,
    n: int = 2,
    min_chars: int = 10,
    bucket_days: int = 32,
) -> DataFrame:
    """``studies`` plus ``past_reports``: texts of the last ``n`` earlier studies.

    The ``n`` latest are taken first and short ones dropped afterwards, so fewer
    than ``n`` may remain. Studies at the same instant do not see each other.
    """
    dated = studies.filter(F.col(study_time).isNotNull()).withColumn("__t", micros(study_time))
    prev = last_n_before(dated, [subject], "__t", study_id, _time_bucket("__t", bucket_days), [text], n)
    kept = F.filter(
        F.transform("previous", lambda r: F.trim(r[text])), lambda t: F.coalesce(F.length(t), F.lit(0)) >= min_chars
    )
    prev = prev.select(subject, "__t", kept.alias("past_reports"))
    return (
        studies.withColumn("__t", micros(study_time))
        .join(prev, [subject, "__t"], "left")
        .drop("__t")
        .withColumn("past_reports", F.coalesce("past_reports", F.array().cast("array<string>")))
    )


def admission_diagnoses(
    diagnoses: DataFrame, *, admission: str, seq: str, tie: Sequence[Column], payload: Sequence[Column], limit: int = 15
) -> DataFrame:
    """Per admission the first ``limit`` diagnoses by sequence number, as an array."""
    kept = top_k(diagnoses, [admission], [F.col(seq), *tie], limit, "__rank")
    packed = F.struct("__rank", *payload)
    names = [c for c in kept.select(packed.alias("s")).schema["s"].dataType.names if c != "__rank"]
    return kept.groupBy(admission).agg(
        F.transform(
            F.array_sort(F.collect_list(packed)), lambda d: F.struct(*[d[c].alias(c) for c in names])
        ).alias("diagnoses")
    )


def first_seen_descriptions(
    diagnoses: DataFrame, *, subject: str, description: str, seq: str, order: Sequence[str], relevant: Column
) -> DataFrame:
    """Per (subject, description) the first relevant occurrence in timeline order.

    A history is a prefix of the timeline, so one first occurrence per subject
    serves all of its studies. ``min`` over a struct is reduced before the shuffle.
    """
    return (
        diagnoses.filter(relevant & (F.coalesce(description, F.lit("")) != ""))
        .groupBy(subject, description)
        .agg(F.min(F.struct(*order, F.coalesce(seq, F.lit(999)).alias("__seq"))).alias("first_seen"))
    )


def relevant_descriptions(
    spans: DataFrame,
    firsts: DataFrame,
    *,
    subject: str,
    study_id: str,
    end: str,
    description: str,
    order: Sequence[str],
    limit: int = 30,
) -> DataFrame:
    """Per study: at most ``limit`` descriptions of its history, lowest sequence number first.

    ``end`` is the history length of the study and the first entry of ``order`` the
    timeline position. Studies with nothing relevant are absent. The lowest ``limit`` of those seen is a running
    state of the timeline, so a study never meets the descriptions of its subject.
    """
    from .timeline import prefix_lowest

    seen = [F.col(f"first_seen.{o}").alias("position" if i == 0 else f"__o{i}") for i, o in enumerate(order)]
    rows = firsts.select(subject, F.col("first_seen.__seq").alias("__seq"), *seen, F.col(description).alias("__d"))
    marks = spans.select(subject, study_id, F.col(end).cast("long").alias("end"))
    keys = ["__seq", "position", *[f"__o{i}" for i in range(1, len(order))], "__d"]
    found = prefix_lowest(rows, marks, subject=subject, order=keys, k=limit, key=study_id)
    return found.filter(F.size("lowest") > 0).select(study_id, F.transform("lowest", lambda x: x["__d"]).alias("descriptions"))


def history_context(past: Column, descriptions: Column) -> Column:
    """Context text from past report texts and diagnosis descriptions; '' when both are empty."""
    reports = F.concat_ws("\n\n", F.transform(past, lambda r: F.concat(F.lit("Past Report: "), r)))
    listing = F.concat_ws("\n", F.transform(descriptions, lambda d: F.concat(F.lit("- "), d)))
    return F.concat_ws(
        "\n\n",
        F.when(reports != "", F.concat(F.lit("[HISTORICAL IMAGING REPORTS]\n"), reports)),
        F.when(listing != "", F.concat(F.lit("[PATIENT MEDICAL HISTORY]\n"), listing)),
    )


def history_coverage(df: DataFrame, text: str = "history_text") -> DataFrame:
    """Counts and percent of studies whose context has reports, diagnoses, both or nothing."""
    has_r = F.col(text).contains("[HISTORICAL IMAGING REPORTS]")
    has_d = F.col(text).contains("[PATIENT MEDICAL HISTORY]")
    total = F.count(F.lit(1))
    flags = {"with_reports": has_r, "with_diagnoses": has_d, "with_both": has_r & has_d, "empty": F.col(text) == ""}
    out = [total.alias("total")]
    for name, flag in flags.items():
        out += [F.count_if(flag).alias(name), F.round(F.count_if(flag) / total * 100, 6).alias(f"{name}_pct")]
    return df.agg(*out)
