"""Study table from image metadata, report files and hospital admissions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import history as H
from ..operators import reports as R
from ..operators import studies as S
from ..operators.scale import by_key
from ..session import cut_lineage


@dataclass(frozen=True)
class Inputs:
    """Input tables, columns as in ``schemas``; ``report_file`` is (path, text), ``files`` (path)."""

    image_meta: DataFrame
    image_path: DataFrame
    study_list: DataFrame
    report_file: DataFrame
    admission: DataFrame
    diagnosis: DataFrame
    icd_title: DataFrame
    drg: DataFrame
    files: DataFrame | None = None


def studies_with_images(src: Inputs, prefixes: Sequence[str] | None = None) -> DataFrame:
    """(subject_id, study_id, report_path, images, study_dt), checked against the path table if given."""
    dated = src.image_meta.withColumn("taken", ids.study_timestamp(F.col("StudyDate"), F.col("StudyTime")))
    if prefixes:
        dated = S.partition_filter(dated, "subject_id", prefixes)
    dated = dated.filter(F.col("taken").isNotNull()).join(src.image_path, "dicom_id")
    keys = ["subject_id", "study_id"]
    grouped = S.images_per_study(dated, keys, "path", "ViewPosition", "taken")
    out = grouped.join(src.study_list.withColumnRenamed("path", "report_path"), keys)
    if src.files is not None:
        rewrite = lambda p: F.concat(F.lit("images/"), ids.image_path(p))
        out = S.first_image_exists(out, src.files, "images", "path", rewrite)
    return out


def admissions_with_details(src: Inputs) -> DataFrame:
    """Admissions with their first 15 diagnoses and the severity group.

    Of duplicate titles the last counts: by an ``ord`` column if the dictionary
    has one, else by the text, never by the position of a row in a partition. Titles are written once: with their size
    known, diagnoses are not dealt out by code where a broadcast does.
    """
    last = "ord" if "ord" in src.icd_title.columns else "long_title"
    titles = cut_lineage(S.unique_titles(src.icd_title, "icd_code", "long_title", [last]), "titles")
    named = S.with_title(src.diagnosis.select("hadm_id", "seq_num", "icd_code"), titles, "icd_code", "long_title")
    lists = H.admission_diagnoses(
        named,
        admission="hadm_id",
        seq="seq_num",
        tie=[F.col("icd_code")],
        payload=[F.col("seq_num"), F.col("icd_code"), F.col("long_title").alias("description")],
    )
    fields = ["description", "drg_severity", "drg_mortality"]
    grouped = S.with_severity_group(
        src.admission, src.drg, key="hadm_id", kind="drg_type", wanted="APR", fields=fields, order=fields
    )
    out = grouped.drop("drg_rows").join(lists, "hadm_id", "left")
    empty = out.schema["diagnoses"].dataType
    return out.withColumn("diagnoses", F.coalesce("diagnoses", F.array().cast(empty)))


def build_dataset(src: Inputs, window_days: int = 0, prefixes: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(studies, routed): the study table, and every report with its status for counting.

    Reports are routed before history is attached, so rejected studies cost no history. Routed reports are written once,
    as many steps read them. Images are joined only for studies that have a report, admissions described only for
    subjects of valid ones, and texts wait aside while histories are assembled.
    """
    reports = src.report_file.select(F.col("path").alias("report_path"), F.col("text").alias("report_raw"))
    listed = cut_lineage(src.study_list.join(src.report_file.select("path"), "path", "left_semi"), "listed")
    shown = src.image_meta.join(listed.select("subject_id", "study_id"), ["subject_id", "study_id"], "left_semi")
    studies = studies_with_images(replace(src, image_meta=shown, study_list=listed), prefixes)
    met = by_key(studies, "report_path").join(by_key(reports, "report_path"), "report_path")
    routed = cut_lineage(R.route_reports(met).withColumn("__row", F.monotonically_increasing_id()), "routed")
    valid = routed.filter(F.col("status") == R.VALID).withColumnRenamed("study_dt", "study_datetime")
    admission = cut_lineage(src.admission.join(valid.select("subject_id"), "subject_id", "left_semi"), "admission")
    of_these = lambda rows: rows.join(admission.select("hadm_id"), "hadm_id", "left_semi")
    needed = replace(src, admission=admission, diagnosis=of_these(src.diagnosis), drg=of_these(src.drg))
    past = H.attach_history(
        valid.select("study_id", "subject_id", "study_datetime", "__row"),
        cut_lineage(admissions_with_details(needed), "admissions"),
        subject="subject_id",
        study_id="study_id",
        study_time="study_datetime",
        discharge_time="dischtime",
        tie="hadm_id",
        payload=["hadm_id", "admittime", "dischtime", "diagnoses", "drg"],
        window_days=window_days or None,
    )
    full = valid.join(past.select("__row", "history"), "__row")
    columns = ["study_id", "subject_id", "study_datetime", "images", "history", "report", "findings", "report_raw"]
    return full.select(*columns), routed.drop("__row")
