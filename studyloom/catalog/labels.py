"""Label queries over ``labels`` (missing rows come from the left join on documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from . import query
from .tables import table

NAMES = ("quality", "toxic")

# raw labels: 1, 0, -1 (uncertain, every 17th document) or null
_RAW_SQL = """raw AS (SELECT d.doc_id, CASE WHEN d.doc_id % 17 = 0 THEN -1 ELSE l.quality END AS quality, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id))"""
_LONG_SQL = f"""{_RAW_SQL},
rl AS (SELECT doc_id, 'quality' AS label_name, quality AS v FROM raw UNION ALL SELECT doc_id, 'toxic', toxic FROM raw),
lab AS (SELECT doc_id, label_name, CASE WHEN v IS NULL THEN 0.0::DOUBLE WHEN v = -1 THEN 0.5 ELSE v END AS value, v IS NOT NULL AS known FROM rl)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.withColumn("quality", F.when(F.col("doc_id") % 17 == 0, -1).otherwise(F.col("quality")))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.to_long(_raw(spark, sf_dir), "doc_id", NAMES)
    return rows.select(
        "doc_id", "label_name", L.normalise(F.col("value")).alias("value"), L.is_known(F.col("value")).alias("known")
    )


@query("label_normalise", f"WITH {_LONG_SQL} SELECT doc_id, label_name, value, known FROM lab")
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir)


@query(
    "label_distribution",
    f"""WITH {_LONG_SQL} SELECT label_name, count(*) AS n, count(*) FILTER (value > 0.5) AS positives,
    round(CAST(count(*) FILTER (value > 0.5) AS DOUBLE) / count(*) * 100, 6) AS positive_pct FROM lab GROUP BY 1""",
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.distribution(_long(spark, sf_dir))


@query(
    "class_weights",
    f"""WITH {_LONG_SQL}, c AS (SELECT label_name, count(*) AS n, count(*) FILTER (value > 0.5) AS positives FROM lab GROUP BY 1),
    w AS (SELECT *, CASE WHEN positives > 0 THEN CAST(n AS DOUBLE) / ((SELECT count(*) FROM c) * positives) ELSE 1.0::DOUBLE END AS w FROM c)
    SELECT label_name, positives, round(least(greatest(w / (SELECT avg(w) FROM w), 0.5), 3.0), 6) AS weight FROM w""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.class_weights(_long(spark, sf_dir))


@query(
    "abnormal_count",
    f"""WITH {_LONG_SQL}, a AS (SELECT doc_id, count(*) FILTER (value > 0.5 AND label_name <> 'none') AS n_abnormal FROM lab GROUP BY 1)
    SELECT n_abnormal, count(*) AS n_studies, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM a) * 100, 6) AS pct
    FROM a WHERE n_abnormal <= 5 GROUP BY 1""",
)
def abnormal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.abnormal_histogram(L.abnormal_counts(_long(spark, sf_dir), "doc_id", "none"))


@query(
    "label_match",
    """SELECT count(*) AS n_studies, count(l.doc_id) AS n_matched,
    round(CAST(count(l.doc_id) AS DOUBLE) / count(*) * 100, 6) AS matched_pct, CAST(coalesce(sum(quality), 0) AS DOUBLE) AS quality_sum
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    wide = table(spark, sf_dir, "labels").select("doc_id", *[F.col(n).cast("double").alias(n) for n in NAMES])
    merged = L.merge_labels(docs, wide, "doc_id", NAMES)
    n, hit = F.count(F.lit(1)), F.count_if("has_labels")
    return merged.agg(
        n.alias("n_studies"),
        hit.alias("n_matched"),
        F.round(hit / n * 100, 6).alias("matched_pct"),
        F.sum("quality").alias("quality_sum"),
    )


_SCORE_SQL = """s AS (
SELECT doc_id, 'quality' AS label_name, CASE WHEN doc_id % 17 = 0 THEN 0.5::DOUBLE ELSE quality END AS y, ((doc_id * 37 + 11) % 100) / 100.0::DOUBLE AS prob
FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 17 = 0 THEN 0.5::DOUBLE ELSE toxic END, ((doc_id * 37 + 22) % 100) / 100.0::DOUBLE
FROM labels JOIN documents USING (doc_id))"""


def soft_labels(df: DataFrame, names=NAMES) -> DataFrame:
    """(doc_id, label_name, prob) from the document number."""
    probs = F.array(
        *[
            F.struct(F.lit(n).alias("label_name"), (((F.col("doc_id") * 37 + 11 * k) % 100) / 100.0).alias("prob"))
            for k, n in enumerate(names, 1)
        ]
    )
    return df.withColumn("__p", F.explode(probs)).select(*df.columns, "__p.label_name", "__p.prob")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    truth = L.to_long(joined, "doc_id", NAMES).withColumnRenamed("value", "y")
    truth = truth.withColumn("y", F.when(F.col("doc_id") % 17 == 0, 0.5).otherwise(F.col("y")))
    k = F.when(F.col("label_name") == "quality", 11).otherwise(22)
    return truth.withColumn("prob", ((F.col("doc_id") * 37 + k) % 100) / 100.0)


@query(
    "prob_profile",
    f"""WITH {_SCORE_SQL} SELECT label_name, round(avg(prob), 6) AS prob_mean, round(var_pop(prob), 6) AS prob_var,
    round(avg(CASE WHEN prob BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE THEN 1 ELSE 0 END), 6) AS frac_mid, count(*) FILTER (y <> 0.5) AS n_known
    FROM s GROUP BY 1""",
)
def prob_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.probability_profile(scores(spark, sf_dir))


_KNOWN_SQL = f"""{_SCORE_SQL}, k AS (SELECT label_name, y > 0.5 AS pos, prob FROM s WHERE y <> 0.5),
a AS (SELECT * FROM k UNION ALL SELECT '(micro)', pos, prob FROM k)"""


@query(
    "auroc",
    f"""WITH {_KNOWN_SQL},
r AS (SELECT *, rank() OVER (PARTITION BY label_name ORDER BY prob) + (count(*) OVER (PARTITION BY label_name, prob) - 1) / 2.0::DOUBLE AS rk FROM a),
g AS (SELECT label_name, count(*) AS n_known, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n, sum(rk) FILTER (pos) AS rs FROM r GROUP BY 1)
SELECT label_name, n_known, CASE WHEN p > 0 AND n > 0 AND (n_known >= 10 OR label_name = '(micro)')
  THEN round((rs - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) END AS auroc FROM g""",
)
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.auroc(scores(spark, sf_dir))


@query(
    "best_threshold",
    f"""WITH {_KNOWN_SQL},
t AS (SELECT label_name, CASE WHEN label_name = '(micro)' THEN 400 ELSE 200 END AS cells FROM (SELECT DISTINCT label_name FROM a)),
g AS (SELECT label_name, i, i * (1.0::DOUBLE / cells) AS thr FROM t, unnest(range(0, cells + 1)) AS u(i)),
f AS (SELECT g.label_name, g.i, g.thr, count(*) FILTER (pos AND prob >= thr) AS tp, count(*) FILTER (NOT pos AND prob >= thr) AS fp,
        count(*) FILTER (pos AND prob < thr) AS fn FROM g JOIN a ON a.label_name = g.label_name GROUP BY 1, 2, 3),
s2 AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0::DOUBLE END, 12) AS f1 FROM f),
w AS (SELECT *, row_number() OVER (PARTITION BY label_name ORDER BY f1 DESC, i) AS rn FROM s2)
SELECT label_name, round(f1, 6) AS best_f1, round(thr, 6) AS best_threshold FROM w WHERE rn = 1""",
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_threshold(scores(spark, sf_dir))


_CONFUSION_SQL = """c AS (SELECT doc_id, truth, pred FROM (
SELECT doc_id, quality AS truth, toxic AS pred FROM labels UNION ALL SELECT doc_id, 1 - quality, 1 - toxic FROM labels))"""


def _truth_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    q, t = F.col("quality"), F.col("toxic")
    both = F.array(F.struct(q.alias("truth"), t.alias("pred")), F.struct((1 - q).alias("truth"), (1 - t).alias("pred")))
    return rows.select("doc_id", F.inline(both))


@query(
    "micro_prf",
    f"""WITH {_CONFUSION_SQL}, s AS (SELECT CAST(count(*) FILTER (truth = 1 AND pred = 1) AS DOUBLE) AS tp,
      count(*) FILTER (truth <> 1 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred <> 1) AS fn FROM c)
    SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""",
)
def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.micro_prf(_truth_pred(spark, sf_dir))


@query(
    "pair_f1",
    f"""WITH {_CONFUSION_SQL}, s AS (SELECT doc_id, CAST(count(*) FILTER (truth = 1 AND pred = 1) AS DOUBLE) AS tp,
      count(*) FILTER (truth <> 1 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred <> 1) AS fn FROM c GROUP BY 1)
    SELECT doc_id, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0::DOUBLE END AS label_f1 FROM s""",
)
def pair_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pair_f1(_truth_pred(spark, sf_dir), "doc_id")
