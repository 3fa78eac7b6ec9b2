"""As-of history queries. Orders stand for admissions and studies, lines for diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.scale import top_k
from . import query
from .tables import LINE_TIE, ordered_lines, table

RELEVANT_WORDS = ("ring", "bolt", "red")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")


def _studies(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("study_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("study_dt"),
    )


def _admissions(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    n_lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_diag"))
    adm = orders.select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("dischtime"),
    )
    return adm.join(n_lines, adm["hadm_id"] == n_lines["l_orderkey"], "left").select(
        "hadm_id", "subject_id", "dischtime", F.coalesce("n_diag", F.lit(0)).alias("n_diag")
    )


_ASOF_SQL = """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
adm AS (SELECT o_orderkey, o_custkey, o_orderdate, coalesce(n, 0) AS n_diag
        FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT s.o_orderkey AS study_id, s.o_custkey AS subject_id,
       count(a.o_orderkey) AS n_history,
       CAST(coalesce(sum(a.n_diag), 0) AS BIGINT) AS n_diagnoses,
       CAST(coalesce(sum(a.o_orderkey), 0) AS BIGINT) AS hadm_checksum
FROM orders s LEFT JOIN adm a ON a.o_custkey = s.o_custkey AND a.o_orderdate < s.o_orderdate {extra}
GROUP BY 1, 2"""


def _totals(spark: SparkSession, sf_dir: str, window_days: int | None) -> DataFrame:
    orders = _orders(spark, sf_dir)
    out = H.history_totals(
        _studies(orders),
        _admissions(spark, sf_dir, orders),
        subject="subject_id",
        study_time="study_dt",
        discharge_time="dischtime",
        sums={"n_history": F.lit(1).cast("bigint"), "n_diagnoses": F.col("n_diag"), "hadm_checksum": F.col("hadm_id")},
        window_days=window_days,
    )
    return out.select("study_id", "subject_id", "n_history", "n_diagnoses", "hadm_checksum")


@query("history_asof", _ASOF_SQL.format(extra=""))
def history_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir, None)


@query(
    "history_window_days",
    _ASOF_SQL.format(extra="AND floor((epoch_us(s.o_orderdate) - epoch_us(a.o_orderdate)) / 86400000000.0) <= 365"),
)
def history_window_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir, 365)


@query(
    "history_nested",
    """
WITH ranked AS (
  SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
  FROM lineitem),
d AS (
  SELECT l_orderkey, string_agg(l_linenumber || ':' || coalesce(p_brand, 'Unknown'), ',' ORDER BY rn) AS diags
  FROM ranked LEFT JOIN part ON p_partkey = l_partkey WHERE rn <= 15 GROUP BY 1)
SELECT s.o_orderkey AS study_id, count(a.o_orderkey) AS n_history,
       coalesce(string_agg(a.o_orderkey || '@' || strftime(a.o_orderdate, '%Y-%m-%d') || '[' || coalesce(d.diags, '') || ']', ';'
                ORDER BY a.o_orderdate, a.o_orderkey), '') AS history
FROM orders s
LEFT JOIN orders a ON a.o_custkey = s.o_custkey AND a.o_orderdate < s.o_orderdate
LEFT JOIN d ON d.l_orderkey = a.o_orderkey
GROUP BY 1""",
)
def history_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    diags = H.admission_diagnoses(
        ordered_lines(spark, sf_dir),
        admission="l_orderkey",
        seq="l_linenumber",
        tie=[F.col(c) for c in LINE_TIE],
        payload=[
            F.col("l_linenumber").alias("seq_num"),
            F.coalesce("p_brand", F.lit("Unknown")).alias("icd_code"),
        ],
    )
    adm = _admissions(spark, sf_dir, orders).drop("n_diag")
    adm = adm.join(diags, adm["hadm_id"] == diags["l_orderkey"], "left").drop("l_orderkey")
    nested = H.attach_history(
        _studies(orders),
        adm,
        subject="subject_id",
        study_id="study_id",
        study_time="study_dt",
        discharge_time="dischtime",
        tie="hadm_id",
        payload=["hadm_id", "dischtime", "diagnoses"],
    )
    shown = F.transform(
        "history",
        lambda a: F.concat(
            a["hadm_id"].cast("string"),
            F.lit("@"),
            F.date_format(a["dischtime"], "yyyy-MM-dd"),
            F.lit("["),
            F.concat_ws(
                ",",
                F.transform(a["diagnoses"], lambda d: F.concat(d["seq_num"].cast("string"), F.lit(":"), d["icd_code"])),
            ),
            F.lit("]"),
        ),
    )
    return nested.select(
        "study_id", F.size("history").cast("bigint").alias("n_history"), F.concat_ws(";", shown).alias("history")
    )


@query(
    "past_reports_last2",
    """
WITH r AS (
  SELECT event_id, user_id, ts,
         CASE WHEN value < 20 THEN event_type ELSE event_type || ' ' || props END AS report
  FROM events),
p AS (
  SELECT a.event_id, b.report, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS back
  FROM r a JOIN r b ON b.user_id = a.user_id AND b.ts < a.ts),
k AS (SELECT event_id, string_agg(trim(report), '|' ORDER BY back DESC) AS t, count(*) AS n
      FROM p WHERE back <= 2 AND length(trim(report)) >= 10 GROUP BY 1)
SELECT r.event_id AS study_id, coalesce(k.n, 0) AS n_reports, coalesce(k.t, '') AS past_reports
FROM r LEFT JOIN k USING (event_id)""",
)
def past_reports_last2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", "props")
    report = F.when(F.col("value") < 20, F.col("event_type")).otherwise(F.concat_ws(" ", "event_type", "props"))
    out = H.past_reports(
        events.select("event_id", "user_id", "ts", report.alias("report")),
        subject="user_id",
        study_time="ts",
        study_id="event_id",
        text="report",
        bucket_days=1,
    )
    return out.select(
        F.col("event_id").alias("study_id"),
        F.size("past_reports").cast("bigint").alias("n_reports"),
        F.concat_ws("|", "past_reports").alias("past_reports"),
    )


_HISTORY_TEXT_CTE = """
r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority AS report FROM orders),
p AS (
  SELECT a.o_orderkey AS study_id, b.report,
         row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) AS back
  FROM r a JOIN r b ON b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate),
rep AS (
  SELECT study_id, string_agg('Past Report: ' || report, chr(10) || chr(10) ORDER BY back DESC) AS t
  FROM p WHERE back <= 2 AND length(report) >= 10 GROUP BY 1),
d AS (
  SELECT s.o_orderkey AS study_id, a.o_orderdate, a.o_orderkey AS hadm, l_linenumber, p_name,
         l_partkey, l_suppkey, l_extendedprice, l_shipdate
  FROM orders s JOIN orders a ON a.o_custkey = s.o_custkey AND a.o_orderdate < s.o_orderdate
  JOIN lineitem ON l_orderkey = a.o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'red')),
f AS (
  SELECT *, row_number() OVER (PARTITION BY study_id, p_name ORDER BY o_orderdate, hadm, l_linenumber, l_partkey,
                               l_suppkey, l_extendedprice, l_shipdate) AS seen FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY l_linenumber, o_orderdate, hadm, l_partkey,
                               l_suppkey, l_extendedprice, l_shipdate, p_name) AS rn FROM f WHERE seen = 1),
dia AS (SELECT study_id, string_agg('- ' || p_name, chr(10) ORDER BY rn) AS t FROM o WHERE rn <= 30 GROUP BY 1),
ctx AS (
  SELECT r.o_orderkey AS study_id,
    CASE WHEN rep.t IS NULL THEN '' ELSE '[HISTORICAL IMAGING REPORTS]' || chr(10) || rep.t END ||
    CASE WHEN rep.t IS NOT NULL AND dia.t IS NOT NULL THEN chr(10) || chr(10) ELSE '' END ||
    CASE WHEN dia.t IS NULL THEN '' ELSE '[PATIENT MEDICAL HISTORY]' || chr(10) || dia.t END AS history_text
  FROM r LEFT JOIN rep ON rep.study_id = r.o_orderkey LEFT JOIN dia ON dia.study_id = r.o_orderkey)"""


def history_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study_id, history_text) for every order."""
    orders = _orders(spark, sf_dir)
    reports = H.past_reports(
        orders, subject="o_custkey", study_time="o_orderdate", study_id="o_orderkey", text="o_orderpriority"
    )
    adm = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    placed = H.timeline_positions(adm, subject="o_custkey", discharge_time="o_orderdate", tie="o_orderkey")
    spans = H.history_totals(
        adm, adm, subject="o_custkey", study_time="o_orderdate", discharge_time="o_orderdate", sums={"end": F.lit(1)}
    )
    lines = ordered_lines(spark, sf_dir).join(
        placed.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "position"), "l_orderkey"
    )
    relevant = F.lit(False)
    for word in RELEVANT_WORDS:
        relevant = relevant | F.lower("p_name").contains(word)
    order = ["position", "l_linenumber", *LINE_TIE]
    firsts = H.first_seen_descriptions(
        lines, subject="o_custkey", description="p_name", seq="l_linenumber", order=order, relevant=relevant
    )
    # ties of the sequence number go by first-seen order
    found = H.relevant_descriptions(
        spans,
        firsts,
        subject="o_custkey",
        study_id="o_orderkey",
        end="end",
        description="p_name",
        order=order,
    )
    return reports.join(found, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("study_id"),
        H.history_context(
            F.col("past_reports"), F.coalesce("descriptions", F.array().cast("array<string>"))
        ).alias("history_text"),
    )


@query("history_text", f"WITH {_HISTORY_TEXT_CTE} SELECT study_id, history_text FROM ctx")
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_texts(spark, sf_dir)


@query(
    "history_coverage",
    f"""WITH {_HISTORY_TEXT_CTE},
g AS (SELECT contains(history_text, '[HISTORICAL IMAGING REPORTS]') AS r,
             contains(history_text, '[PATIENT MEDICAL HISTORY]') AS d, history_text = '' AS e FROM ctx)
SELECT count(*) AS total,
  count(*) FILTER (r) AS with_reports, round(count(*) FILTER (r) * 100.0 / count(*), 6)::DOUBLE AS with_reports_pct,
  count(*) FILTER (d) AS with_diagnoses, round(count(*) FILTER (d) * 100.0 / count(*), 6)::DOUBLE AS with_diagnoses_pct,
  count(*) FILTER (r AND d) AS with_both, round(count(*) FILTER (r AND d) * 100.0 / count(*), 6)::DOUBLE AS with_both_pct,
  count(*) FILTER (e) AS empty, round(count(*) FILTER (e) * 100.0 / count(*), 6)::DOUBLE AS empty_pct
FROM g""",
)
def history_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history_coverage(history_texts(spark, sf_dir))
