import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from studyloom.operators import history as H
from studyloom.operators.scale import next_row, prefix_sums, with_prefix_sum

T0 = datetime(2020, 1, 1)


def table(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


@pytest.fixture(scope="module")
def hot(spark):
    """One subject owns most rows; many equal times."""
    rng = random.Random(3)
    adm = [(1 if i % 3 else i % 7 + 2, i, T0 + timedelta(hours=rng.randrange(0, 4000, 6))) for i in range(400)]
    stu = [(1 if i % 3 else i % 7 + 2, 1000 + i, T0 + timedelta(hours=rng.randrange(0, 4000, 6))) for i in range(150)]
    stu.append((99, 5000, T0))
    return (
        table(spark, stu, "subject_id int, study_id int, dt timestamp"),
        table(spark, adm, "subject_id int, hadm_id int, disch timestamp"),
        stu,
        adm,
    )


@pytest.mark.parametrize("window", [None, 30])
@pytest.mark.parametrize("bucket_days", [1, 32])
def test_nested_history_equals_brute_force(hot, window, bucket_days):
    studies, admissions, stu, adm = hot
    out = H.attach_history(
        studies, admissions, subject="subject_id", study_id="study_id", study_time="dt", discharge_time="disch", tie="hadm_id",
        payload=["hadm_id", "disch"], window_days=window, bucket_days=bucket_days, chunk_rows=8,
    )
    got = {r["study_id"]: [a["hadm_id"] for a in r["history"]] for r in out.collect()}
    for subject, sid, t in stu:
        prior = [a for a in adm if a[0] == subject and a[2] < t and (not window or (t - a[2]).days <= window)]
        assert got[sid] == [a[1] for a in sorted(prior, key=lambda a: (a[2], a[1]))]


def test_discharge_at_study_time_is_not_history(spark):
    s = table(spark, [(1, 1, T0)], "subject_id int, study_id int, dt timestamp")
    a = table(spark, [(1, 7, T0), (1, 8, T0 - timedelta(microseconds=1))], "subject_id int, hadm_id int, disch timestamp")
    out = H.history_totals(s, a, subject="subject_id", study_time="dt", discharge_time="disch", sums={"n": F.lit(1)})
    assert out.first()["n"] == 1


def test_past_reports_take_two_then_drop_short(spark):
    rows = [
        (1, 1, T0, "first long report"),
        (1, 2, T0 + timedelta(days=1), "short"),
        (1, 3, T0 + timedelta(days=1), "tie at same time"),
        (1, 4, T0 + timedelta(days=40), "last long report"),
        (1, 5, None, "undated report text"),
    ]
    df = table(spark, rows, "subject_id int, study_id int, dt timestamp, report string")
    out = H.past_reports(df, subject="subject_id", study_time="dt", study_id="study_id", text="report")
    got = {r["study_id"]: r["past_reports"] for r in out.collect()}
    assert got[1] == [] and got[5] == []
    assert got[2] == got[3] == ["first long report"]
    assert got[4] == ["tie at same time"]


@pytest.mark.parametrize("inclusive", [False, True])
def test_prefix_sums(spark, inclusive):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.randrange(50), rng.randrange(9)) for _ in range(300)]
    df = table(spark, rows, "k string, o int, v int")
    out = prefix_sums(df, ["k"], "o", F.floor(F.col("o") / 7), {"v": F.col("v")}, inclusive=inclusive)
    got = {(r["k"], r["o"]): r["v"] for r in out.collect()}
    for k, o in {(r[0], r[1]) for r in rows}:
        assert got[k, o] == sum(v for kk, oo, v in rows if kk == k and (oo < o or inclusive and oo == o))


def test_next_row_crosses_buckets(spark):
    rows = [("s", -5.0, 0, "a"), ("s", -5.0, 1, "b"), ("s", -2.0, 2, "c"), ("s", 0.0, 3, "d"), ("t", 0.0, 0, "x")]
    df = table(spark, rows, "k string, m double, o int, c string")
    out = next_row(df, ["k"], "m", [F.col("o")], ["c"])
    got = {r["c"]: r["next"]["c"] if r["next"] else None for r in out.collect()}
    assert got == {"a": "b", "b": "c", "c": "d", "d": None, "x": None}


def test_at_most_fifteen_diagnoses(spark):
    rows = [(1, 20 - i, f"{i:03d}") for i in range(20)]
    df = table(spark, rows, "hadm_id int, seq int, code string")
    out = H.admission_diagnoses(df, admission="hadm_id", seq="seq", tie=[F.col("code")], payload=[F.col("seq"), F.col("code")])
    assert [d["seq"] for d in out.first()["diagnoses"]] == list(range(1, 16))
    assert out.first()["diagnoses"][0]["code"] == "019"


def test_context_sections(spark):
    df = spark.createDataFrame([(["r one", "r two"], ["d"]), ([], ["d"]), ([], [])], "p array<string>, d array<string>")
    got = [r[0] for r in df.select(H.history_context(F.col("p"), F.col("d"))).collect()]
    assert got == [
        "[HISTORICAL IMAGING REPORTS]\nPast Report: r one\n\nPast Report: r two\n\n[PATIENT MEDICAL HISTORY]\n- d",
        "[PATIENT MEDICAL HISTORY]\n- d",
        "",
    ]


def test_prefix_sum_of_rows_with_a_payload(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(50)]), rng.randrange(9), f"p{i}") for i in range(300)]
    df = table(spark, rows, "k string, o int, v int, p string")
    bucket = F.floor(F.col("o") / 7)
    got = {r["p"]: r["s"] for r in with_prefix_sum(df, ["k"], "o", bucket, F.col("v"), "s").collect()}
    sums = {(r["k"], r["o"]): r["v"] for r in prefix_sums(df, ["k"], "o", bucket, {"v": F.col("v")}).collect()}
    before = lambda k, o: sum(v for kk, oo, v, _ in rows if kk == k and (oo is None or oo < o))
    want = {p: before(k, o) for k, o, _, p in rows if k is not None and o is not None}
    assert got == want
    assert sums == {(k, o): before(k, o) for k, o, *_ in rows if k is not None and o is not None}


def test_prefix_sums_shuffle_their_rows_once(spark):
    df = table(spark, [("a", 1, 2), ("b", None, 3), (None, 4, 5)], "k string, o int, v int")
    out = prefix_sums(df, ["k"], "o", F.floor(F.col("o") / 7), {"v": F.col("v")})
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {name: spark.conf.get(name) for name in plain}
    try:
        for name, value in plain.items():
            spark.conf.set(name, value)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert "ReusedExchange" in plan
