"""State of a subject's timeline at every study, without a history per study.

All diagnoses of a subject form one timeline with dense positions, and a study sees the positions below its
``end``. What a study needs of its history is a prefix of the timeline reduced by an operation that merges:
a maximum, or the lowest few of something. Such states are computed once per timeline: inside buckets of
positions first, where rows and studies (marks) are sorted together, then over one reduced row per bucket. A
bucket holds a bounded number of positions, so a subject that owns a third of all rows is spread over its buckets.

Timelines have (subject, position, icd, description, severity, month); marks have (subject, key, end, month). ``month``
counts calendar months since year 0. An admission that begins after its discharge counts as beginning then.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .history import history_totals, timeline_positions

#: Positions of a bucket.
BUCKET = 4096
#: Parts over which a subject's studies meet its codes.
SPREAD = 16
#: Positions of a bucket whose values every study of the bucket looks through.
STEPS = 256


def calendar_month(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def diagnosis_timeline(
    admissions: DataFrame, *, subject: str, admission: str, discharge_time: str, admit_time: str | None = None, severity: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(timeline, sizes) of admissions with ``diagnoses``, arrays of (icd_code, description).

    Admissions go by (discharge, admission); a diagnosis without code or description takes a position and no row. Where
    diagnoses have a ``seq_num``, it is kept.
    ``sizes`` has the admissions with ``n_diagnoses``, for ``study_marks``.
    """
    begun = F.col(discharge_time) if admit_time is None else F.least(F.col(admit_time), F.col(discharge_time))
    sized = admissions.withColumn("n_diagnoses", F.greatest(F.size(F.coalesce("diagnoses", F.array())), F.lit(0)))
    placed = timeline_positions(sized, subject=subject, discharge_time=discharge_time, tie=admission, weight="n_diagnoses")
    sev = F.lit(1.0) if severity is None else F.coalesce(severity.cast("double"), F.lit(1.0))
    rows = placed.select(
        subject, "position", calendar_month(begun).alias("month"), sev.alias("severity"), F.posexplode("diagnoses").alias("__i", "d")
    )
    rows = rows.filter((F.coalesce("d.icd_code", F.lit("")) != "") & (F.coalesce("d.description", F.lit("")) != ""))
    seq = ["d.seq_num"] if "seq_num" in admissions.schema["diagnoses"].dataType.elementType.names else []
    out = rows.select(
        subject, *seq, (F.col("position") + F.col("__i")).alias("position"), F.col("d.icd_code").alias("icd"), "d.description", "severity", "month"
    )
    return out, sized


def study_marks(
    studies: DataFrame, sizes: DataFrame, *, subject: str, key: str, study_time: str, discharge_time: str
) -> DataFrame:
    """(subject, key, end, month): how many positions of the timeline precede each study."""
    spans = history_totals(
        studies.select(subject, key, study_time), sizes, subject=subject, study_time=study_time, discharge_time=discharge_time, sums={"end": F.col("n_diagnoses")}
    )
    return spans.select(subject, key, F.coalesce("end", F.lit(0)).cast("long").alias("end"), calendar_month(F.col(study_time)).alias("month"))


def prefix_best(rows: DataFrame, marks: DataFrame, *, keys: Sequence[str], value: Column, payload: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """``marks`` (keys, end, payload) plus ``best``: the greatest ``value`` of the key's rows with position < end."""
    keys = list(keys)
    best = value.alias("best")
    kind = rows.select(best).schema["best"].dataType
    at = rows.select(*keys, F.col("position").alias("__at"), F.lit(1).alias("__row"), best)
    asks = marks.select(
        *keys, F.col("end").alias("__at"), F.lit(0).alias("__row"), F.lit(None).cast(kind).alias("best"), F.struct(*payload).alias("__mark")
    )
    both = at.withColumn("__mark", F.lit(None).cast(asks.schema["__mark"].dataType)).unionByName(asks)
    both = both.withColumn("__b", F.floor(F.col("__at") / bucket))
    # a mark comes before a row at its own position
    inner = Window.partitionBy(*keys, "__b").orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy(*keys, "__b").agg(F.max("best").alias("__top"))
    carry = carry.select(*keys, "__b", F.max("__top").over(outer).alias("__carry"))
    local = both.withColumn("best", F.max("best").over(inner)).filter("__row = 0")
    out = local.join(carry, [*keys, "__b"])
    later = F.when(F.col("best").isNull() | (F.col("__carry") > F.col("best")), F.col("__carry")).otherwise(F.col("best"))
    return out.select(*keys, "__mark.*", later.alias("best"))


def _running(frames: Iterator[pd.DataFrame], group: list[str], k: int) -> Iterator[pd.DataFrame]:
    """Streams events sorted by (group, __at, __row): rows enter the lowest ``k``, marks are answered with them."""
    current, low, names = None, [], []
    for frame in frames:
        out = []
        for values in frame[[*group, "__row", "__item", "__mark"]].itertuples(index=False, name=None):
            if values[:-3] != current:
                current, low = values[:-3], []
            if values[-3]:
                names = names or list(values[-2])
                item = tuple(values[-2].values())
                if len(low) < k or item < low[-1]:
                    insort(low, item)
                    del low[k:]
            else:
                out.append((*current, values[-1], [dict(zip(names, x)) for x in low]))
        yield pd.DataFrame(out, columns=[*group, "__mark", "__low"])


def prefix_lowest(rows: DataFrame, marks: DataFrame, *, subject: str, order: Sequence[str], k: int, key: str, bucket: int = BUCKET) -> DataFrame:
    """(subject, key, lowest): the ``k`` lowest of the subject's rows with position < end, ascending, as structs ``order``.

    ``order`` holds numbers and texts without nulls. State is ``k`` rows at any place; one row per bucket carries it on.
    """
    item = F.struct(*order)
    kind = rows.select(item.alias("i")).schema["i"].dataType
    ask = marks.schema[key].dataType.simpleString()

    def answered(events: DataFrame, group: list[str]) -> DataFrame:
        fields = [f"`{g}` {events.schema[g].dataType.simpleString()}" for g in group]
        lows = f"__low array<{kind.simpleString()}>"
        split = events.repartition(*group).sortWithinPartitions(*group, "__at", "__row")
        schema = ", ".join([*fields, "__mark string", lows])
        return split.mapInPandas(lambda frames: _running(frames, group, k), schema)

    at = rows.select(subject, F.floor(F.col("position") / bucket).alias("__b"), F.col("position").alias("__at"), F.lit(1).alias("__row"), item.alias("__item"))
    asks = marks.select(
        subject, F.floor(F.col("end") / bucket).alias("__b"), F.col("end").alias("__at"), F.lit(0).alias("__row"),
        F.lit(None).cast(kind).alias("__item"), F.col(key).cast("string").alias("__mark"),
    )
    # marks travel as text: pandas would make whole numbers beside nulls floating
    events = at.withColumn("__mark", F.lit(None).cast("string")).unionByName(asks)
    local = answered(events, [subject, "__b"])
    # the lowest of every bucket, then of all buckets before each
    place = F.row_number().over(Window.partitionBy(subject, "__b").orderBy("__item"))
    tops = at.withColumn("__r", place).filter(F.col("__r") <= k)
    moved = tops.select(subject, F.col("__b").alias("__at"), "__row", "__item", F.lit(None).cast("string").alias("__mark"))
    stops = asks.select(subject, F.col("__b").alias("__at"), "__row", "__item", F.col("__b").cast("string").alias("__mark")).distinct()
    carry = answered(moved.unionByName(stops), [subject]).select(subject, F.col("__mark").cast("long").alias("__b"), F.col("__low").alias("__carry"))
    both = F.slice(F.array_sort(F.concat("__low", "__carry")), 1, k)
    return local.join(carry, [subject, "__b"]).select(subject, F.col("__mark").cast(ask).alias(key), both.alias("lowest"))


def code_marks(timeline: DataFrame, marks: DataFrame, *, subject: str, key: str) -> DataFrame:
    """(subject, key, icd, ord, end, month): every code a study has seen, ``ord`` being its first position.

    One row per study and code, however often a code recurs. A subject's codes come in one row, copied to ``SPREAD``
    parts only where a study sees more than a bucket, and a subject's studies meet them in these parts.
    """
    firsts = timeline.groupBy(subject, "icd").agg(F.min("position").alias("ord"))
    packed = firsts.groupBy(subject).agg(F.collect_list(F.struct("icd", "ord")).alias("__c"))
    packed = packed.join(marks.groupBy(subject).agg(F.max("end").alias("__p")), subject)
    packed = packed.withColumn("__s", F.explode(F.sequence(F.lit(0), F.when(F.col("__p") <= BUCKET, 0).otherwise(SPREAD))))
    # part 0 serves the marks of the first bucket, the others all later ones
    part = F.when(F.col("end") <= BUCKET, 0).otherwise(1 + F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int"))
    met = marks.withColumn("__s", part).join(packed.drop("__p"), [subject, "__s"])
    seen = F.filter("__c", lambda c: c["ord"] < F.col("end"))
    return met.select(*[subject, "__s"], *[c for c in marks.columns if c != subject], F.inline(seen)).drop("__s")


def months_before(mark_month: Column, month: Column) -> Column:
    return F.greatest(mark_month - month, F.lit(0)).cast("double")


def primary_state(timeline: DataFrame, marks: DataFrame, *, subject: str, key: str, bucket: int = BUCKET) -> DataFrame:
    """(key, ord, icd, description, severity, months_ago): the most severe, then most recent, then earliest diagnosis."""
    value = F.struct("severity", F.col("month").alias("m"), (-F.col("position")).alias("p"), "icd", "description")
    best = prefix_best(timeline, marks, keys=[subject], value=value, payload=[key, "month"], bucket=bucket).filter("best is not null")
    months = months_before(F.col("month"), F.col("best.m")).alias("months_ago")
    return best.select(key, (-F.col("best.p")).alias("ord"), "best.icd", "best.description", "best.severity", months)


def strongest_state(
    timeline: DataFrame, marks: DataFrame, *, subject: str, key: str, decay: float = 0.1, bucket: int = STEPS
) -> DataFrame:
    """(key, icd, ord, raw): the greatest severity * exp(-decay * months ago) of every code of a study's history.

    The months of a study are a common factor of its diagnoses, so the running maximum of
    severity * exp(decay * month) serves all studies; the month is taken from a fixed origin to stay in range.
    A bucket of positions is one row of codes, each with its values inside the bucket and its maximum before it, and
    studies meet the bucket their history ends in: rows per study and code arise there and are not moved.
    """
    origin = 2000 * 12
    value = F.col("severity") * F.exp(decay * (F.col("month") - origin))
    rows = timeline.filter(F.col("icd").isNotNull()).select(subject, "icd", "position", value.alias("value"), F.floor(F.col("position") / bucket).alias("__b"))
    ends = marks.withColumn("__b", F.floor(F.col("end") / bucket))
    # what came before a bucket: only subjects whose studies see more than one have it
    later = cut_lineage(ends.filter("__b > 0").select(subject, "__b").distinct(), "later")
    tops = rows.join(later.select(subject).distinct(), subject, "left_semi").groupBy(subject, "icd", "__b")
    tops = tops.agg(F.min("position").alias("ord"), F.max("value").alias("base"))
    asks = tops.select(subject, "icd").distinct().join(later, subject).withColumns({"ord": F.lit(None).cast("long"), "base": F.lit(None).cast("double")})
    before = Window.partitionBy(subject, "icd").orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
    moved = tops.withColumn("__ask", F.lit(False)).unionByName(asks.withColumn("__ask", F.lit(True)))
    moved = moved.select(subject, "icd", "__b", "__ask", F.min("ord").over(before).alias("ord"), F.max("base").over(before).alias("base"))
    carry = moved.filter("__ask and ord is not null").select(subject, "__b", "icd", "ord", "base")
    step = F.struct("position", "value")
    here = rows.select(subject, "__b", "icd", F.col("position").alias("ord"), F.lit(None).cast("double").alias("base"), step.alias("step"))
    both = here.unionByName(carry.withColumn("step", F.lit(None).cast(here.schema["step"].dataType)))
    codes = both.repartition(subject, "__b").groupBy(subject, "__b", "icd")
    codes = codes.agg(F.min("ord").alias("ord"), F.max("base").alias("base"), F.collect_list("step").alias("steps"))
    packed = codes.groupBy(subject, "__b").agg(F.collect_list(F.struct("icd", "ord", "base", "steps")).alias("__c"))
    seen = F.filter("__c", lambda c: c["ord"] < F.col("end"))
    inside = lambda c: F.transform(F.filter(c["steps"], lambda s: s["position"] < F.col("end")), lambda s: s["value"])
    best = F.transform(seen, lambda c: F.struct(c["icd"].alias("icd"), c["ord"].alias("ord"), F.greatest(c["base"], F.array_max(inside(c))).alias("best")))
    met = ends.join(packed, [subject, "__b"]).select(key, "month", F.inline(best))
    return met.select(key, "icd", "ord", (F.col("best") * F.exp(-decay * (F.col("month") - origin))).alias("raw"))


def recurrent_state(timeline: DataFrame, marks: DataFrame, *, subject: str, key: str, k: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(key, recurrent): the first ``k`` diagnoses (ord, icd, description) whose code occurs at least twice.

    A diagnosis counts from the position where both it and its code's second occurrence have been seen; the lowest
    ``k`` of those seen is a running state.
    """
    # second occurrences: the two lowest positions per code merge, and need no window over a code
    two = timeline.groupBy(subject, "icd", F.floor(F.col("position") / bucket).alias("__b")).agg(F.slice(F.array_sort(F.collect_list("position")), 1, 2).alias("p"))
    two = two.groupBy(subject, "icd").agg(F.get(F.array_sort(F.flatten(F.collect_list("p"))), F.lit(1)).alias("second")).filter("second is not null")
    active = timeline.join(two, [subject, "icd"]).select(
        subject, F.greatest("position", "second").alias("position"), F.col("position").alias("ord"), "icd", "description"
    )
    found = prefix_lowest(active, marks, subject=subject, order=["ord", "icd", "description"], k=k, key=key, bucket=bucket)
    return found.filter(F.size("lowest") > 0).select(key, F.col("lowest").alias("recurrent"))
