"""History text per study: the last reports and the relevant diagnoses before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf.keywords import RELEVANCE_KEYWORDS, UNKNOWN_TITLES
from ..functions import text as T
from ..operators import history as H
from ..operators import timeline as L
from ..session import cut_lineage


def history_contexts(
    studies: DataFrame,
    admissions: DataFrame,
    *,
    subject: str = "subject_id",
    key: str = "study_id",
    study_time: str = "study_datetime",
    report: str = "report",
    admission: str = "hadm_id",
    discharge_time: str = "dischtime",
    keywords: Sequence[str] = RELEVANCE_KEYWORDS,
    unknown: Sequence[str] = UNKNOWN_TITLES,
    limit: int = 30,
    n_reports: int = 2,
) -> DataFrame:
    """(key, history_text) of every study; '' where nothing precedes it.

    ``admissions`` have ``diagnoses`` (seq_num, icd_code, description). A diagnosis counts if its description names one
    of ``keywords`` and is none of ``unknown``; of equal descriptions the first, then the lowest sequence
    numbers. Diagnoses come from the running state of the timeline, reports from the last studies of the subject.
    """
    admissions = cut_lineage(admissions.select(subject, admission, discharge_time, "diagnoses"), "admissions")
    line, sizes = L.diagnosis_timeline(admissions, subject=subject, admission=admission, discharge_time=discharge_time)
    line = cut_lineage(line, "timeline")
    marks = L.study_marks(studies, sizes, subject=subject, key=key, study_time=study_time, discharge_time=discharge_time)
    marks = cut_lineage(marks, "marks")  # read as events, as bucket ends and with the carried states
    relevant = T.contains_any(F.col("description"), keywords) & ~F.col("description").isin(*unknown)
    firsts = H.first_seen_descriptions(line, subject=subject, description="description", seq="seq_num", order=["position"], relevant=relevant)
    firsts = cut_lineage(firsts, "firsts")
    found = H.relevant_descriptions(
        marks, firsts, subject=subject, study_id=key, end="end", description="description", order=["position"], limit=limit
    )
    past = H.past_reports(studies, subject=subject, study_time=study_time, study_id=key, text=report, n=n_reports)
    both = past.select(key, "past_reports").join(found, key, "left")
    listed = F.coalesce("descriptions", F.array().cast("array<string>"))
    return both.select(key, H.history_context(F.col("past_reports"), listed).alias("history_text"))
