"""States of a timeline against the nested history, with one subject that owns most rows and buckets of a few positions."""

import random
from datetime import datetime, timedelta
from math import exp

import pytest
from pyspark.sql import functions as F

from studyloom.operators import history as H
from studyloom.operators import timeline as L

T0 = datetime(2020, 1, 1)
KEYS = dict(subject="subject_id", key="study_id")
ADM = (
    "subject_id int, hadm_id int, admit timestamp, disch timestamp, sev double, "
    "diagnoses array<struct<icd_code:string,description:string>>"
)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    adm, stu = [], []
    for i in range(160):
        out = T0 + timedelta(hours=rng.randrange(0, 40000, 12))
        codes = [rng.choice(["A1", "B2", "C3", "D4", "", None, "E5"]) for _ in range(rng.randrange(0, 5))]
        diag = None if i % 11 == 0 else [(c, None if c == "E5" and j else f"{c} x{j}") for j, c in enumerate(codes)]
        adm.append((1 if i % 3 else i % 5 + 2, i, out - timedelta(days=rng.randrange(0, 40)), out, rng.choice([None, 1.0, 2.0, 3.0]), diag))
    for i in range(70):
        stu.append((1 if i % 3 else i % 5 + 2, 1000 + i, T0 + timedelta(hours=rng.randrange(0, 42000, 12))))
    stu += [(99, 5000, T0), (2**31 - 1, 2**53 + 1, T0)]
    return spark.createDataFrame(adm, ADM), spark.createDataFrame(stu, "subject_id int, study_id long, dt timestamp"), adm, stu


def brute(adm, stu):
    """study: its diagnoses (ord, icd, description, severity, months)."""
    out = {}
    for subject, study, t in stu:
        rows, place = [], 0
        for _, _, a, _, sev, diag in sorted([x for x in adm if x[0] == subject and x[3] < t], key=lambda x: (x[3], x[1])):
            for code, name in diag or []:
                if code and name:
                    rows.append((place, code, name, sev or 1.0, max(0, (t.year - a.year) * 12 + t.month - a.month)))
                place += 1
        out[study] = rows
    return out


@pytest.fixture(scope="module")
def states(data):
    adm, stu, *_ = data
    line, sizes = L.diagnosis_timeline(
        adm, subject="subject_id", admission="hadm_id", discharge_time="disch", admit_time="admit", severity=F.col("sev")
    )
    marks = L.study_marks(stu, sizes, study_time="dt", discharge_time="disch", **KEYS)
    return line.cache(), marks.cache()


@pytest.mark.parametrize("bucket", [4096, 7])
def test_states_equal_the_nested_history(data, states, bucket):
    want = brute(data[2], data[3])
    got = {r["study_id"]: tuple(r)[1:] for r in L.primary_state(*states, **KEYS, bucket=bucket).collect()}
    assert got == {s: min(rows, key=lambda r: (-r[3], r[4], r[0])) for s, rows in want.items() if rows}
    found = {(r["study_id"], r["icd"]): (r["ord"], r["raw"]) for r in L.strongest_state(*states, **KEYS, bucket=bucket).collect()}
    expected = {}
    for s, rows in want.items():
        for code in {r[1] for r in rows}:
            own = [r for r in rows if r[1] == code]
            expected[s, code] = own[0][0], max(r[3] * exp(-0.1 * r[4]) for r in own)
    assert found.keys() == expected.keys()
    assert all(found[k][0] == expected[k][0] and found[k][1] == pytest.approx(expected[k][1]) for k in found)
    again = {r["study_id"]: [tuple(x) for x in r["recurrent"]] for r in L.recurrent_state(*states, **KEYS, bucket=bucket).collect()}
    codes = {s: [r[1] for r in rows] for s, rows in want.items()}
    recurrent = {s: [r[:3] for r in rows if codes[s].count(r[1]) > 1][:3] for s, rows in want.items()}
    assert again == {s: r for s, r in recurrent.items() if r}


@pytest.mark.parametrize("bucket", [4096, 5])
def test_lowest_of_a_prefix_equals_sorting(spark, bucket):
    rng = random.Random(2)
    rows = [(1 if i % 4 else i % 3, i, rng.randrange(6), f"d{rng.randrange(50)}") for i in range(300)]
    marks = [(s, 2**60 + s * 1000 + e, e) for s in (0, 1, 2, 7) for e in range(0, 310, 9)]
    out = L.prefix_lowest(
        spark.createDataFrame(rows, "s int, position long, seq int, name string").repartition(5),
        spark.createDataFrame(marks, "s int, study long, end long"), subject="s", order=["seq", "position", "name"], k=4, key="study", bucket=bucket,
    )
    got = {r["study"]: [tuple(x) for x in r["lowest"]] for r in out.collect()}
    assert got == {m: sorted((q, p, n) for s2, p, q, n in rows if s2 == s and p < e)[:4] for s, m, e in marks}


def test_strongest_codes_are_not_moved_per_study_and_code(states):
    plan = L.strongest_state(*states, **KEYS)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate inline")[0]
    assert "Generate inline" in plan and not any(word in above for word in ("Join", "Window", "Aggregate", "Repartition"))


def test_strongest_codes_of_repeated_and_odd_rows(spark):
    """A study listed twice counts twice; values without number, and what lies in an earlier bucket."""
    rows = [(1, "A", 0, 2.0, 24000), (1, "A", 0, 2.0, 24000), (1, "B", 3, None, 24001), (1, "A", 5, 1.0, 24002), (1, None, 6, 9.0, 24002), (None, "A", 0, 9.0, 24000)]
    line = spark.createDataFrame(rows, "subject_id int, icd string, position long, severity double, month int")
    ends = [(1, 10, 0, 24002), (1, 11, 1, 24002), (1, 11, 1, 24002), (1, 12, 4, 24003), (1, 13, 7, 24003), (2, 14, 9, 24003), (None, 15, 9, 24003)]
    marks = spark.createDataFrame(ends, "subject_id int, study_id long, end long, month int")
    for bucket in (2, 3, 256):
        out = L.strongest_state(line, marks, **KEYS, bucket=bucket).collect()
        got = sorted((r["study_id"], r["icd"], r["ord"], None if r["raw"] is None else round(r["raw"], 6)) for r in out)
        two, three = round(2 * exp(-0.2), 6), round(2 * exp(-0.3), 6)
        assert got == [(11, "A", 0, two), (11, "A", 0, two), (12, "A", 0, three), (12, "B", 3, None), (13, "A", 0, three), (13, "B", 3, None)]


def test_no_rows_or_no_marks(states):
    line, marks = states
    for a, b in ((line.filter("false"), marks), (line, marks.filter("false"))):
        assert L.primary_state(a, b, **KEYS).collect() == L.strongest_state(a, b, **KEYS).collect() == L.recurrent_state(a, b, **KEYS).collect() == []


def test_relevant_descriptions_keep_the_first_of_equal_numbers(spark):
    lines = spark.createDataFrame([(1, 0, 3, "b"), (1, 1, 1, "a"), (1, 1, 1, "b"), (1, 2, 1, "c"), (1, 3, None, "d"), (1, 4, 1, "")], "s int, position long, seq int, name string")
    firsts = H.first_seen_descriptions(lines, subject="s", description="name", seq="seq", order=["position"], relevant=F.lit(True))
    spans = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 3), (1, 13, 9), (2, 14, 5)], "s int, study int, end long")
    out = H.relevant_descriptions(spans, firsts, subject="s", study_id="study", end="end", description="name", order=["position"], limit=3)
    assert {r["study"]: r["descriptions"] for r in out.collect()} == {11: ["b"], 12: ["a", "c", "b"], 13: ["a", "c", "b"]}


def test_history_job_computes_its_admissions_once(spark):
    from studyloom.plans.history_context import history_contexts

    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    diagnoses = "array<struct<seq_num:int,icd_code:string,description:string>>"
    adm = spark.createDataFrame(
        [(1, h, datetime(2020, 1, h + 1), [(1, "A", "heart valve"), (2, "B", f"lung {h}")]) for h in range(6)],
        f"subject_id long, hadm_id long, dischtime timestamp, diagnoses {diagnoses}",
    )
    adm = adm.withColumn("hadm_id", F.udf(touch, "long").asNondeterministic()("hadm_id"))
    studies = spark.createDataFrame([(1, 7, datetime(2020, 1, 4), "report of the first study")], "subject_id long, study_id long, study_datetime timestamp, report string")
    text = history_contexts(studies, adm).collect()[0]["history_text"]
    assert text == "[PATIENT MEDICAL HISTORY]\n- heart valve\n- lung 0\n- lung 1\n- lung 2"
    assert seen.value == 6
