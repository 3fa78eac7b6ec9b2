"""Disease knowledge base from the study table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import disease_tables as D
from ..operators import knowledge as K
from ..operators.patient import history_diagnoses
from ..operators.scale import with_prefix_sum
from ..operators.timeline import BUCKET, code_marks
from ..session import cut_lineage


def build_kb(studies: DataFrame, min_support: int = 10, min_confidence: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(kb_entity, kb_relation); every study's history counts as one basket."""
    long = history_diagnoses(
        studies, key="study_id", history="history", study_time="study_datetime", severity=None
    ).select("study_id", "ord", "icd", F.col("description"))
    return K.knowledge_base(
        studies.sparkSession,
        cut_lineage(long),
        basket="study_id",
        code="icd",
        name="description",
        order=["study_id", "ord"],
        categories=D.CATEGORIES,
        relations=D.MEDICAL_RELATIONS,
        min_support=min_support,
        min_confidence=min_confidence,
    )


def build_kb_from_timelines(
    timeline: DataFrame, marks: DataFrame, *, subject: str, key: str, min_support: int = 10, min_confidence: float = 0.3,
    categories=D.CATEGORIES, relations=D.MEDICAL_RELATIONS,
) -> tuple[DataFrame, DataFrame]:
    """``build_kb`` from timelines and marks (operators.timeline), without a history per study.

    A diagnosis counts once for every study that sees it, which is the number of marks behind its position, and a
    code's baskets are the studies that have seen it. The name of a code is its first description in the history of
    the first study (by key) that has it.
    """
    codes = cut_lineage(code_marks(timeline, marks, subject=subject, key=key).select(subject, key, "icd", "ord"), "codes")
    # marks with end <= position, as a sum over the places before position + 1
    at = timeline.select(subject, "icd", (F.col("position") + 1).alias("place"), F.lit(0).alias("n"))
    stops = marks.select(subject, F.lit(None).cast("string").alias("icd"), F.col("end").alias("place"), F.lit(1).alias("n"))
    blind = with_prefix_sum(at.unionByName(stops), [subject], "place", F.floor(F.col("place") / BUCKET), F.col("n"), "blind")
    studies = marks.groupBy(subject).agg(F.count(F.lit(1)).alias("all"))
    seen = blind.filter("n = 0").join(studies, subject)
    frequency = seen.groupBy("icd").agg(F.sum(F.col("all") - F.col("blind")).alias("frequency")).filter("frequency > 0")
    first = codes.groupBy("icd").agg(F.min_by(F.struct(subject, F.col("ord").alias("position")), F.struct(key, "ord")).alias("f")).select("icd", "f.*")
    names = first.join(timeline.select(subject, "position", F.col("description").alias("name")), [subject, "position"])
    entities = names.join(frequency, "icd").select(
        "icd", "name", F.lit("disease").alias("type"), K.category_of(F.col("icd"), categories).alias("category"), "frequency"
    )
    mined = K.cooccurrence(codes, basket=key, code="icd", min_support=min_support, min_confidence=min_confidence)
    fixed = K.fixed_relations(timeline.sparkSession, relations)
    return entities, fixed.unionByName(K.cooccurrence_relations(mined, len(relations)))
