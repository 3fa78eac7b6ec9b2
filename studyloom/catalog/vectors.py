"""Vector queries. ``embeddings`` is both the query set and the case database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import features as X
from ..operators import retrieval as R
from ..operators import studies as S
from . import query
from .labels import soft_labels
from .tables import table

MIN_SIM = 0.1
LABELS = ("a", "b", "c", "d", "e", "f")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def vector_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vec")
    )


PAIR_SQL = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS MATERIALIZED (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id)"""

_SCORING = R.Scoring(min_score=MIN_SIM)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "case_id", F.round("score", 6).alias("score"))


@query(
    "knn_topk",
    f"""WITH {PAIR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM s WHERE sim >= 0.1 AND sim <= 0.92)
SELECT q AS query_id, rank, c AS case_id, round(sim, 6) AS score FROM r WHERE rank <= 5""",
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector_cases(spark, sf_dir)
    return _shown(R.top_cases(v, v, 5, _SCORING))


@query(
    "knn_stats",
    f"""WITH {PAIR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM s WHERE sim >= 0.1 AND sim <= 0.92)
SELECT q AS query_id, count(*) AS num_retrieved, round(avg(sim), 6) AS mean_score, round(stddev_pop(sim), 6) AS std_score,
  round(min(sim), 6) AS min_score, round(max(sim), 6) AS max_score, round(avg(sim), 6) AS mean_similarity, 0.0::DOUBLE AS mean_label_score
FROM r WHERE rank <= 5 GROUP BY 1""",
)
def knn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector_cases(spark, sf_dir)
    return R.retrieval_statistics(R.top_cases(v, v, 5, _SCORING))


@query(
    "knn_cases",
    f"""WITH {PAIR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM s WHERE sim >= 0.1 AND sim <= 0.92)
SELECT q AS query_id, rank, c AS case_id, round(sim, 6) AS score, source, lang FROM r JOIN documents ON doc_id = c WHERE rank <= 3""",
)
def knn_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector_cases(spark, sf_dir)
    hits = _shown(R.top_cases(v, v, 3, _SCORING))
    payload = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return R.attach_cases(hits, payload, "doc_id").select(*hits.columns, "source", "lang")


def _mmr_sql(base: str, lam: str, pen: str, floor: bool = False) -> str:
    """Greedy re-ranking for k = 3 over ``base``(q, c, rel); ``s`` holds all pair similarities."""
    fl = "greatest({}, 0)" if floor else "{}"
    two, three = fl.format("x.sim"), fl.format("greatest(x.sim, y.sim)")
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC, c) AS o, count(*) OVER (PARTITION BY q) AS n FROM {base}),
p1 AS (SELECT q, c, rel FROM o WHERE o = 1 AND n > 3),
p2 AS (SELECT o.q, o.c, o.rel, p1.c AS c1, row_number() OVER (PARTITION BY o.q ORDER BY {lam} * o.rel - {pen} * {two} DESC, o.o) AS rn
  FROM o JOIN p1 ON p1.q = o.q AND p1.c <> o.c JOIN s x ON x.q = p1.c AND x.c = o.c),
p3 AS (SELECT o.q, o.c, o.rel, row_number() OVER (PARTITION BY o.q ORDER BY {lam} * o.rel - {pen} * {three} DESC, o.o) AS rn
  FROM o JOIN p2 ON p2.q = o.q AND p2.rn = 1 AND p2.c <> o.c AND p2.c1 <> o.c
  JOIN s x ON x.q = p2.c1 AND x.c = o.c JOIN s y ON y.q = p2.c AND y.c = o.c),
mmr AS (SELECT q, o AS rank, c, rel FROM o WHERE n <= 3
  UNION ALL SELECT q, 1, c, rel FROM p1 UNION ALL SELECT q, 2, c, rel FROM p2 WHERE rn = 1 UNION ALL SELECT q, 3, c, rel FROM p3 WHERE rn = 1)
SELECT q AS query_id, rank, c AS case_id, round(rel, 6) AS score FROM mmr"""


@query(
    "mmr_k3",
    f"WITH {PAIR_SQL}, band AS (SELECT q, c, sim AS rel FROM s WHERE sim >= 0.1 AND sim <= 0.92), {_mmr_sql('band', '0.8::DOUBLE', '0.2::DOUBLE')}",
)
def mmr_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector_cases(spark, sf_dir)
    return _shown(R.diverse_cases(v, v, 3, _SCORING))


@query(
    "mmr_k3_blocks",
    f"WITH {PAIR_SQL}, band AS (SELECT q, c, sim AS rel FROM s WHERE sim >= 0.1 AND sim <= 0.92), {_mmr_sql('band', '0.8::DOUBLE', '0.2::DOUBLE')}",
)
def mmr_k3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same selection with small blocks around few pivots."""
    v = vector_cases(spark, sf_dir)
    return _shown(R.diverse_cases(v, v, 3, _SCORING, block_rows=100, pivots=5))


# label probabilities of a vector: six labels, arithmetic on its id
_PROB = "((vec_id * 37 + 11 * k) % 100) / 100.0::DOUBLE"
_LABEL_SQL = f"""lp AS (SELECT vec_id, chr(96 + CAST(k AS INTEGER)) AS name, {_PROB} AS prob FROM v, unnest(range(1, 7)) AS t(k)),
tl AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, name) AS r FROM lp),
t3 AS (SELECT *, sum(prob) OVER (PARTITION BY vec_id ORDER BY r) AS lead FROM tl WHERE r <= 3),
m AS (SELECT a.vec_id AS q, b.vec_id AS c, sum(a.prob * b.prob) AS num, count(*) AS common FROM t3 a JOIN t3 b ON a.name = b.name GROUP BY 1, 2),
ls AS MATERIALIZED (SELECT m.q, m.c, CASE WHEN l.lead > 0 THEN num / l.lead ELSE num END AS ls FROM m JOIN t3 l ON l.vec_id = m.q AND l.r = m.common)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector_cases(spark, sf_dir)
    probs = soft_labels(v.select(F.col("id").alias("doc_id")), LABELS)
    return v.join(R.best_labels(probs, "doc_id"), v["id"] == F.col("doc_id")).drop("doc_id")


@query(
    "top_labels",
    f"WITH v AS (SELECT vec_id FROM embeddings), {_LABEL_SQL} SELECT vec_id, string_agg(name || '=' || CAST(prob AS VARCHAR), ',' ORDER BY r) AS labels FROM t3 GROUP BY 1",
)
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("labels", lambda e: F.concat(e["name"], F.lit("="), e["prob"].cast("string")))
    return _labelled(spark, sf_dir).select(F.col("id").alias("vec_id"), F.concat_ws(",", shown).alias("labels"))


_FUSED_SQL = f"""{PAIR_SQL}, {_LABEL_SQL},
fused AS (SELECT s.q, s.c, 0.6::DOUBLE * sim + 0.4::DOUBLE * coalesce(ls, 0) AS rel, sim, coalesce(ls, 0) AS ls FROM s LEFT JOIN ls USING (q, c)),
band AS MATERIALIZED (SELECT * FROM fused WHERE rel >= 0.1 AND sim <= 0.92)"""


@query("fused_retrieval", f"WITH {_FUSED_SQL}, {_mmr_sql('band', '1.0::DOUBLE', '0.2::DOUBLE', floor=True)}")
def fused_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _labelled(spark, sf_dir)
    scoring = R.Scoring(visual=0.6, label=0.4, min_score=MIN_SIM, zero_query_matches=True)
    return _shown(R.diverse_cases(v, v, 3, scoring, R.Diversity(1.0, 0.2, 0.0)))


@query(
    "hybrid_retrieval",
    f"""WITH {PAIR_SQL}, {_LABEL_SQL},
h AS (SELECT vec_id, e[33:64] || e[1:32] AS e FROM v),
hs AS (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.e, b.e) AS hsim FROM h a JOIN h b ON a.vec_id <> b.vec_id),
f AS (SELECT s.q, s.c, (0.4::DOUBLE / 1.0) * sim + (0.2::DOUBLE / 1.0) * hsim + (0.4::DOUBLE / 1.0) * coalesce(ls, 0) AS score
      FROM s JOIN hs USING (q, c) LEFT JOIN ls USING (q, c)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, c) AS rank FROM f WHERE score >= 0.1)
SELECT q AS query_id, rank, c AS case_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _labelled(spark, sf_dir)
    history = F.concat(F.slice("vec", 33, 32), F.slice("vec", 1, 32))
    scoring = R.hybrid_scoring(with_history=True, min_score=MIN_SIM)
    v = v.withColumn("history", history)
    return _shown(R.top_cases(v, v, 5, scoring))


def _views() -> Column:
    n = F.col("vec_id") % 5
    return F.when(n == 0, "PA").when(n == 1, "ap").when(n == 2, "LATERAL").when(n == 3, "LL")


_VIEW_SQL = "CASE vec_id % 5 WHEN 0 THEN 'PA' WHEN 1 THEN 'ap' WHEN 2 THEN 'LATERAL' WHEN 3 THEN 'LL' END"


@query(
    "view_fusion",
    f"""WITH v AS (SELECT label, vec_id, embedding, CASE upper(coalesce({_VIEW_SQL}, '')) WHEN 'PA' THEN 1.2::DOUBLE WHEN 'AP' THEN 1.2
      WHEN 'LATERAL' THEN 0.8 WHEN 'LL' THEN 0.8 ELSE 1.0 END AS w FROM embeddings),
x AS (SELECT label, i, w, CAST(embedding[i] AS DOUBLE) AS val FROM v, unnest(range(1, len(embedding) + 1)) AS t(i))
SELECT label, i - 1 AS position, round(sum(w * val) / sum(w), 6) AS weighted, round(avg(val), 6) AS mean FROM x GROUP BY 1, 2""",
)
def view_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    weighted = X.pooled(e, ["label"], "embedding", X.view_weight(_views()))
    mean = X.pooled(e, ["label"], "embedding").withColumnRenamed("embedding", "mean")
    both = weighted.join(mean, "label").select("label", F.posexplode(F.arrays_zip("embedding", "mean")).alias("p", "x"))
    return both.select(
        "label",
        F.col("p").cast("bigint").alias("position"),
        F.round("x.embedding", 6).alias("weighted"),
        F.round("x.mean", 6).alias("mean"),
    )


@query(
    "vector_integrity",
    """SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN embedding IS NULL OR vec_id % 50 = 0 THEN 'missing' WHEN vec_id % 41 = 0 THEN 'missing_meta'
    WHEN vec_id % 31 = 0 OR len(list_filter(embedding, lambda x: isnan(x))) > 0 THEN 'nan'
    WHEN vec_id % 29 = 0 OR len(list_filter(embedding, lambda x: isinf(x))) > 0 THEN 'inf' WHEN vec_id % 23 = 0 THEN 'bad_rows'
    WHEN vec_id % 19 = 0 OR len(embedding) <> 64 THEN 'bad_dim' ELSE 'ok' END AS status
  FROM embeddings) GROUP BY 1""",
)
def vector_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the table's vectors and of faults added by id: the metadata (width, rows) comes from the id too."""
    e, vid = embeddings(spark, sf_dir), F.col("vec_id")
    bad = lambda x: F.concat("embedding", F.array(F.lit(x).cast("float")))
    vec = F.when(vid % 50 == 0, None).when(vid % 31 == 0, bad(float("nan"))).when(vid % 29 == 0, bad(float("inf"))).otherwise(F.col("embedding"))
    rows = e.select("vec_id", vec.alias("embedding"))
    # a width that no vector has is wrong for each; the vector stays whole, so that its own numbers are checked
    dim = F.when(vid % 41 == 0, None).when(vid % 19 == 0, -1).otherwise(64)
    checked = X.integrity(rows, "embedding", dim, F.lit(1), F.when(vid % 23 == 0, 2).otherwise(1))
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_GROUPS = "vec_id // 5"


@query(
    "near_duplicate_views",
    f"""WITH v AS (SELECT CAST({_GROUPS} AS BIGINT) AS study_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY {_GROUPS} ORDER BY vec_id) AS rn FROM embeddings)
SELECT a.study_id, round(s, 6) AS similarity, s > 0.2 AS duplicate FROM (
  SELECT a.study_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-8) AS s
  FROM v a JOIN v b ON a.study_id = b.study_id AND a.rn = 1 AND b.rn = 2) a""",
)
def near_duplicate_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.near_duplicate_views(_studies(spark, sf_dir), "study_id", [F.col("vec_id")], "embedding", 0.2)


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive vectors are the views of one study."""
    e = embeddings(spark, sf_dir)
    return e.select(F.floor(F.col("vec_id") / 5).cast("bigint").alias("study_id"), "vec_id", "embedding", _views().alias("view"))


_SIM_SQL = f"""v AS (SELECT CAST({_GROUPS} AS BIGINT) AS study_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY {_GROUPS} ORDER BY vec_id) AS rn FROM embeddings),
sm AS (SELECT round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-8), 6) AS similarity
  FROM v a JOIN v b ON a.study_id = b.study_id AND a.rn = 1 AND b.rn = 2)"""


@query(
    "similarity_summary",
    f"""WITH {_SIM_SQL} SELECT count(*) AS n, round(avg(similarity), 6) AS mean, round(median(similarity), 6) AS median,
    round(stddev_pop(similarity), 6) AS std, round(min(similarity), 6) AS min, round(max(similarity), 6) AS max, count(*) FILTER (similarity > 0.2) AS n_high FROM sm""",
)
def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = X.near_duplicate_views(_studies(spark, sf_dir), "study_id", [F.col("vec_id")], "embedding", 0.2)
    return X.similarity_summary(sims, threshold=0.2)


@query(
    "similarity_histogram",
    f"""WITH {_SIM_SQL} SELECT CAST(least(floor((similarity + 1.0::DOUBLE) / 2.0 * 50) + 1, 50) AS BIGINT) AS bin, count(*) AS n FROM sm GROUP BY 1""",
)
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = X.near_duplicate_views(_studies(spark, sf_dir), "study_id", [F.col("vec_id")], "embedding", 0.2)
    return X.similarity_histogram(sims, -1.0, 1.0)


@query(
    "patch_activation",
    f"""WITH p AS (SELECT CAST({_GROUPS} AS BIGINT) AS study_id, vec_id AS patch, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) + vec_id % 3) AS n FROM embeddings)
SELECT study_id, patch, round((n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w + 1e-8), 6) AS activation FROM p WINDOW w AS (PARTITION BY study_id)""",
)
def patch_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the vectors have unit length, so one coordinate is added to tell them apart
    rows = _studies(spark, sf_dir).select(
        "study_id",
        F.col("vec_id").alias("patch"),
        F.concat(V.doubles(F.col("embedding")), F.array(F.sqrt((F.col("vec_id") % 3).cast("double")))).alias("vec"),
    )
    return X.activation_map(rows, ["study_id"], "patch", "vec")


@query(
    "concat_views",
    f"""WITH v AS (SELECT CAST({_GROUPS} AS BIGINT) AS study_id, vec_id, {_VIEW_SQL} AS view, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY CASE upper(coalesce(view, '')) WHEN 'PA' THEN 1 WHEN 'AP' THEN 2
  WHEN 'LATERAL' THEN 3 WHEN 'LL' THEN 4 ELSE 999 END, vec_id) AS p, count(*) OVER (PARTITION BY study_id) AS original_num_views FROM v)
SELECT study_id, string_agg(coalesce(view, 'None'), ',' ORDER BY p) AS views, CAST(count(*) AS INTEGER) AS num_views, original_num_views,
  CAST(sum(len(e)) AS INTEGER) AS total_tokens, round(sum(list_sum(e) * p), 6) AS checksum, original_num_views > 4 AS truncated
FROM r WHERE p <= 4 GROUP BY study_id, original_num_views""",
)
def concat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = X.concat_views(
        _studies(spark, sf_dir), "study_id", "view", [F.col("vec_id")], "embedding", 4, ("PA", "AP", "LATERAL", "LL")
    )
    place = lambda i: F.floor(i / 64) + 1
    checksum = F.aggregate(
        F.transform("features", lambda x, i: x.cast("double") * place(i)), F.lit(0.0), lambda s, x: s + x
    )
    return joined.select(
        "study_id",
        F.concat_ws(",", "views").alias("views"),
        "num_views",
        "original_num_views",
        F.size("features").alias("total_tokens"),
        F.round(checksum, 6).alias("checksum"),
        "truncated",
    )


@query(
    "shape_counts",
    """WITH v AS (SELECT CAST((vec_id + label) // 5 AS BIGINT) AS study_id, count(*) AS n FROM embeddings GROUP BY 1)
SELECT '(' || n || ', 64)' AS shape, count(*) AS n FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the label moves a view to a neighbouring study, so that studies differ in their number of views
    study = F.floor((F.col("vec_id") + F.col("label")) / 5).cast("bigint").alias("study_id")
    rows = embeddings(spark, sf_dir).groupBy(study).agg(F.count(F.lit(1)).alias("rows"))
    return X.shape_counts(rows, F.format_string("(%d, 64)", F.col("rows")))


@query(
    "view_counts",
    """WITH v AS (SELECT CAST((vec_id + label) // 5 AS BIGINT) AS study_id, count(*) AS n FROM embeddings GROUP BY 1)
SELECT n AS num_views, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 6) AS percent FROM v GROUP BY v.n""",
)
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = F.floor((F.col("vec_id") + F.col("label")) / 5).cast("bigint").alias("study_id")
    rows = embeddings(spark, sf_dir).groupBy(study).agg(F.count(F.lit(1)).alias("views"))
    return X.value_distribution(rows, F.col("views"), "num_views")


@query("seeded_sample", "SELECT vec_id, label FROM embeddings ORDER BY md5(vec_id || ':7'), vec_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.seeded_sample(embeddings(spark, sf_dir).select("vec_id", "label"), "vec_id", 50, 7)


@query(
    "extraction_summary",
    f"""SELECT count(*) AS num_images, count(DISTINCT {_GROUPS}) AS num_studies,
    round(CAST(count(*) AS DOUBLE) / count(DISTINCT {_GROUPS}), 6) AS images_per_study, max(len(embedding)) AS feature_dim FROM embeddings""",
)
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extraction_summary(_studies(spark, sf_dir), "study_id", "embedding")
