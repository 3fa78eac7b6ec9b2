"""Identifiers, paths and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def study_timestamp(date: Column, time: Column) -> Column:
    """yyyymmdd plus hhmmss.fff (null time is midnight, fraction cut); null where it is no date."""
    clock = F.lpad(F.coalesce(time, F.lit(0)).cast("int").cast("string"), 6, "0")
    return F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), clock), F.lit("yyyyMMdd HHmmss"))


def normal_id(raw: Column) -> Column:
    """'50414267.0' -> '50414267'; text that is no number only loses '.0'; null -> '0'."""
    text = raw.cast("string")
    number = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")
    return F.when(text.isNull(), "0").otherwise(
        F.coalesce(number.cast("bigint").cast("string"), F.replace(text, F.lit(".0"), F.lit("")))
    )


def subject_prefix(subject: Column) -> Column:
    return F.substring(subject.cast("string"), 1, 2)


def image_path(path: Column, root: str = "") -> Column:
    """One leading ``files/`` or ``images/`` off, ``.dcm`` to ``.jpg``, root in front."""
    rel = F.regexp_replace(F.regexp_replace(path, "^(?:files|images)/", ""), r"\.dcm$", ".jpg")
    return F.concat(F.lit(root.rstrip("/") + "/" if root else ""), rel)


def study_of_path(path: Column) -> Column:
    """Study number of ``.../s50414267.txt``; null where the file name holds none, or zero."""
    name = F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".txt"), F.lit(""))
    number = F.replace(name, F.lit("s"), F.lit("")).try_cast("bigint")
    return F.when(number != 0, number)


def report_path(subject: Column, study: Column) -> Column:
    """files/pXX/pSUBJECT/sSTUDY.txt; null where an id is missing."""
    s = subject.try_cast("bigint").cast("string")
    return F.concat(
        F.lit("files/p"), F.substring(s, 1, 2), F.lit("/p"), s, F.lit("/s"), study.cast("string"), F.lit(".txt")
    )


def image_folder(subject: Column, study: Column) -> Column:
    s = subject.try_cast("bigint").cast("string")
    return F.concat(F.lit("images/p"), F.substring(s, 1, 2), F.lit("/p"), s, F.lit("/s"), study.cast("string"))


def months_between_calendar(earlier: Column, later: Column) -> Column:
    """Calendar months (days ignored), never negative; 0 where a date is missing."""
    months = (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))
    return F.greatest(F.coalesce(months, F.lit(0)), F.lit(0))


def severity_text(severity: Column) -> Column:
    return (
        F.when(severity >= 4, "severe")
        .when(severity >= 3, "moderate-severe")
        .when(severity >= 2, "moderate")
        .otherwise("mild")
    )


def recency_text(months: Column) -> Column:
    return (
        F.when(months < 1, "recent")
        .when(months < 6, F.concat(months.cast("int").cast("string"), F.lit("mo ago")))
        .when(months < 12, "this year")
        .when(months < 24, "1-2y ago")
        .otherwise(">2y ago")
    )
