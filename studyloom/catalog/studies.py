"""Study table queries: lookups, splits, resume, prefixes, paths and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import studies as S
from . import query
from .tables import documents, table


@query(
    "study_timestamp",
    """
SELECT l_orderkey AS study_id, l_partkey AS dicom_id, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE strftime(CAST(strptime(strftime(l_shipdate, '%Y%m%d') || ' ' ||
    lpad(CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE (l_partkey % 24) * 10000 + (l_suppkey % 60) * 100 + l_linenumber END AS VARCHAR), 6, '0'),
    '%Y%m%d %H%M%S') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS study_dt
FROM lineitem WHERE l_linenumber <> 7""",
)
def study_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    n = F.col("l_linenumber")
    date = F.when(n == 7, "20209999").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    clock = F.when(n == 1, F.lit(None)).otherwise(
        (F.col("l_partkey") % 24) * 10000 + (F.col("l_suppkey") % 60) * 100 + n + F.lit(0.75)
    )
    stamped = rows.withColumn("dt", ids.study_timestamp(date, clock)).filter(F.col("dt").isNotNull())
    return stamped.select(
        F.col("l_orderkey").alias("study_id"),
        F.col("l_partkey").alias("dicom_id"),
        "l_linenumber",
        F.date_format("dt", "yyyy-MM-dd HH:mm:ss").alias("study_dt"),
    )


def _study_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as images: the ship date is the path and the return flag the view (null for 'N')."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate"
    )
    path = F.concat_ws(
        "/",
        F.date_format("l_shipdate", "yyyyMMdd"),
        F.col("l_linenumber").cast("string"),
        F.concat(F.col("l_partkey").cast("string"), F.lit(".dcm")),
    )
    view = F.when(F.col("l_returnflag") == "A", "pa").when(F.col("l_returnflag") == "R", "LATERAL")
    rows = lines.select(F.col("l_orderkey").alias("study_id"), path.alias("path"), view.alias("view"), "l_shipdate")
    images = S.images_per_study(rows, ["study_id"], "path", "view", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("study_id"), F.col("o_custkey").alias("subject_id")
    )
    return images.join(orders, "study_id")


_VIEWS_CTE = """
img AS (
  SELECT l_orderkey AS study_id, l_shipdate,
    strftime(l_shipdate, '%Y%m%d') || '/' || l_linenumber || '/' || l_partkey || '.dcm' AS path,
    CASE l_returnflag WHEN 'A' THEN 'pa' WHEN 'R' THEN 'LATERAL' END AS view
  FROM lineitem),
ord AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY path, view NULLS FIRST) AS i FROM img),
pri AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY
        CASE upper(coalesce(view, '')) WHEN 'PA' THEN 1 WHEN 'AP' THEN 2 WHEN 'LATERAL' THEN 3 WHEN 'LL' THEN 4 ELSE 999 END, i) AS p
        FROM ord)"""


@query(
    "views_array",
    f"""WITH {_VIEWS_CTE}
SELECT study_id, o_custkey AS subject_id, strftime(min(l_shipdate), '%Y-%m-%d') AS study_dt,
  string_agg(path, ',' ORDER BY i) AS image_paths, string_agg(coalesce(view, 'null'), ',' ORDER BY i) AS view_positions,
  string_agg(coalesce(view, 'None'), ',' ORDER BY p) FILTER (p <= 4) AS kept_views,
  CAST(least(count(*), 4) AS INTEGER) AS num_views, CAST(count(*) AS INTEGER) AS original_num_views, count(*) > 4 AS truncated
FROM pri JOIN orders ON o_orderkey = study_id GROUP BY 1, 2""",
)
def views_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = _study_images(spark, sf_dir).withColumn("p", S.pick_views(F.col("images")))
    return studies.select(
        "study_id",
        "subject_id",
        F.date_format("study_dt", "yyyy-MM-dd").alias("study_dt"),
        F.array_join(F.transform("images", lambda x: x["path"]), ",").alias("image_paths"),
        F.array_join(F.transform("images", lambda x: x["view"]), ",", "null").alias("view_positions"),
        F.array_join(F.transform("p.views", lambda x: x["view"]), ",", "None").alias("kept_views"),
        "p.num_views",
        "p.original_num_views",
        "p.truncated",
    )


@query(
    "first_image_exists",
    f"""WITH {_VIEWS_CTE},
known AS (SELECT DISTINCT strftime(l_shipdate, '%Y%m%d') || '/' || l_linenumber || '/' || l_partkey ||
          CASE WHEN l_linestatus = 'F' THEN '.jpg' ELSE '.png' END AS path FROM lineitem)
SELECT study_id, replace(path, '.dcm', '.jpg') AS first_path FROM ord
WHERE i = 1 AND replace(path, '.dcm', '.jpg') IN (SELECT path FROM known)
  AND study_id IN (SELECT o_orderkey FROM orders)""",
)
def first_image_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linestatus") == "F", ".jpg").otherwise(".png")
    known = lines.select(
        F.concat_ws(
            "/",
            F.date_format("l_shipdate", "yyyyMMdd"),
            F.col("l_linenumber").cast("string"),
            F.concat(F.col("l_partkey").cast("string"), kind),
        ).alias("path")
    )
    kept = S.first_image_exists(_study_images(spark, sf_dir), known, "images", "path", ids.image_path)
    return kept.select("study_id", ids.image_path(F.element_at("images", 1)["path"]).alias("first_path"))


@query(
    "icd_title_join",
    """
WITH dict AS (SELECT icd_code, title, row_number() OVER (PARTITION BY icd_code ORDER BY p_partkey DESC) AS back
              FROM (SELECT CASE WHEN p_brand = 'Brand#7' THEN 'old' ELSE p_brand END AS icd_code, p_name AS title, p_partkey FROM part))
SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, p_brand AS icd_code, coalesce(title, 'Unknown') AS description, count(*) AS n
FROM lineitem JOIN part ON p_partkey = l_partkey
LEFT JOIN dict ON dict.icd_code = p_brand AND back = 1 GROUP BY 1, 2, 3, 4""",
)
def icd_title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    code = F.when(F.col("p_brand") == "Brand#7", "old").otherwise(F.col("p_brand"))  # a code without a title
    dictionary = parts.select(
        "p_partkey", code.alias("icd_code"), F.col("p_name").alias("description")
    )
    titles = S.unique_titles(dictionary, "icd_code", "description", ["p_partkey"])
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    diags = lines.join(parts.select("p_partkey", F.col("p_brand").alias("icd_code")), "p_partkey")
    return (
        S.with_title(diags, titles, "icd_code", "description")
        .groupBy(F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber").alias("seq_num"), "icd_code", "description")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "drg_left_join",
    """
WITH g AS (SELECT l_orderkey AS hadm_id, l_linenumber AS sev, l_quantity AS mort, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'A')
SELECT o_orderkey AS hadm_id, coalesce(sev, -1) AS drg_severity, coalesce(mort, -1.0) AS drg_mortality, coalesce(n, 0) AS drg_rows
FROM orders LEFT JOIN g ON hadm_id = o_orderkey AND rn = 1""",
)
def drg_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        "l_returnflag",
        F.col("l_linenumber").alias("drg_severity"),
        F.col("l_quantity").alias("drg_mortality"),
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_extendedprice",
    )
    adm = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hadm_id"))
    out = S.with_severity_group(
        adm,
        groups,
        key="hadm_id",
        kind="l_returnflag",
        wanted="A",
        fields=["drg_severity", "drg_mortality"],
        order=["drg_severity", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
    )
    missing = [F.coalesce(f"drg.{c}", F.lit(-1)).alias(c) for c in ("drg_severity", "drg_mortality")]
    return out.select("hadm_id", *missing, "drg_rows")


_SPLIT_SQL = """split AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'train' WHEN toxic = 1 THEN 'validate' ELSE 'test' END AS split
FROM labels)"""


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("quality") == 1, "train").when(F.col("toxic") == 1, "validate").otherwise("test")
    once = table(spark, sf_dir, "labels").select("doc_id", kind.alias("split"))
    return once.unionByName(once)


@query("split_assign", f"WITH {_SPLIT_SQL} SELECT doc_id, source, split FROM documents JOIN split USING (doc_id)")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.assign_split(docs, _splits(spark, sf_dir), "doc_id")


@query(
    "split_semi",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def split_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.keep_listed(docs, _splits(spark, sf_dir).filter(F.col("split") == "train"), "doc_id")


@query("resume_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.keep_listed(docs, table(spark, sf_dir, "labels"), "doc_id", listed_only=False)


@query("ids_intersect", "SELECT c_custkey AS subject_id FROM customer INTERSECT SELECT o_custkey FROM orders")
def ids_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"))
    return S.common_ids(customers, orders, "subject_id")


@query(
    "id_profile", "SELECT o_custkey AS subject_id, count(*) AS n_rows FROM orders GROUP BY 1 ORDER BY 1"
)
def id_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.id_profile(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id")), "subject_id")


@query(
    "prefix_groups",
    """SELECT 'p' || substr(CAST(o_custkey AS VARCHAR), 1, 2) AS prefix, count(DISTINCT o_custkey) AS n_ids
       FROM orders WHERE length(CAST(o_custkey AS VARCHAR)) >= 2 GROUP BY 1""",
)
def prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ids_per_prefix(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey")


@query(
    "partition_filter",
    """SELECT o_custkey AS subject_id, count(*) AS n_studies FROM orders
       WHERE substr(CAST(o_custkey AS VARCHAR), 1, 2) IN ('10', '11', '14') GROUP BY 1""",
)
def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.partition_filter(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", ["10", "11", "14"])
    return kept.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count(F.lit(1)).alias("n_studies"))


_URL = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(
    "file_inventory",
    rf"""WITH p AS (SELECT {_URL} AS path FROM pages), s AS (SELECT string_split(path, '/') AS a FROM p),
d AS (SELECT DISTINCT depth, array_to_string(a[1:depth], '/') AS folder FROM s, unnest(range(1, len(a))) AS t(depth)),
e AS (SELECT lower(regexp_extract(a[-1], '.(\.[^.]*)$', 1)) AS ext FROM s)
SELECT 'folders' AS kind, CAST(depth AS VARCHAR) AS name, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'files', CASE WHEN ext IN ('.jpg', '.jpeg') THEN 'jpg' WHEN ext = '.txt' THEN 'txt' ELSE 'others' END, count(*)
FROM e GROUP BY 2""",
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("url")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return S.file_inventory(urls.select(path.alias("path")), "path")


@query(
    "path_rewrite",
    rf"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'files/' WHEN 1 THEN 'images/files/' ELSE '' END || {_URL} ||
      '/s' || page_id || CASE WHEN page_id % 5 = 0 THEN '.txt' ELSE '.dcm' END AS path FROM pages),
n AS (SELECT *, replace(replace(string_split(path, '/')[-1], '.txt', ''), 's', '') AS k FROM p)
SELECT page_id, 'root/' || regexp_replace(regexp_replace(path, '^(files|images)/', ''), '\.dcm$', '.jpg') AS image_path,
  coalesce(try_cast(k AS BIGINT), 0) AS study_id,
  'files/p' || substr(CAST(page_id + 10000 AS VARCHAR), 1, 2) || '/p' || (page_id + 10000) || '/s' || page_id || '.txt' AS report_path,
  'images/p' || substr(CAST(page_id + 10000 AS VARCHAR), 1, 2) || '/p' || (page_id + 10000) || '/s' || page_id AS image_folder,
  CAST(page_id AS VARCHAR) AS normal_id
FROM n""",
)
def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pid = F.col("page_id")
    path = F.concat(
        F.when(pid % 3 == 0, "files/").when(pid % 3 == 1, "images/files/").otherwise(""),
        url,
        F.lit("/s"),
        pid.cast("string"),
        F.when(pid % 5 == 0, ".txt").otherwise(".dcm"),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select(
        "page_id",
        ids.image_path(F.col("path"), "root").alias("image_path"),
        F.coalesce(ids.study_of_path(F.col("path")), F.lit(0)).alias("study_id"),
        ids.report_path(pid + 10000, pid).alias("report_path"),
        ids.image_folder(pid + 10000, pid).alias("image_folder"),
        ids.normal_id(F.concat(pid.cast("string"), F.lit(".0"))).alias("normal_id"),
    )


@query(
    "deletion_manifest",
    r"""
WITH e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'images/p10/s' || doc_id END AS target FROM documents
           WHERE trim(regexp_replace(regexp_replace(text, '[A-Za-z\s]+', '', 'g'), '[.,]+', '', 'g')) = ''),
l AS (SELECT 'images/p10/s' || conv_id AS target, count(*) AS num_files, CAST(sum(length(text)) AS BIGINT) AS bytes
      FROM conversations GROUP BY 1)
SELECT doc_id, coalesce(e.target, 'N/A') AS path, coalesce(num_files, 0) AS num_files, coalesce(bytes, 0) AS bytes,
  CASE WHEN e.target IS NULL THEN 'path_error' WHEN num_files IS NULL THEN 'not_found' ELSE 'would_delete' END AS status
FROM e LEFT JOIN l ON l.target = e.target""",
)
def deletion_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import is_report_empty

    docs = documents(spark, sf_dir).select("doc_id", "text")
    # plain words leave nothing behind, so those documents count as empty reports
    rest = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z\s]+", ""), "[.,]+", "")
    empty = docs.select("doc_id", rest.alias("rest")).filter(is_report_empty(F.col("rest")))
    listing = table(spark, sf_dir, "conversations").select(
        F.concat(
            F.lit("images/p10/s"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")
        ).alias("path"),
        F.length("text").alias("size"),
    )
    target = F.when(
        F.col("doc_id") % 7 != 0, F.concat(F.lit("images/p10/s"), F.col("doc_id").cast("string"))
    )
    return S.deletion_manifest(
        empty, listing, target=target, key=["doc_id"], path="path", size="size", folder=True
    )


@query(
    "deletion_log",
    r"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'images/p10/s' || doc_id END AS target FROM documents
           WHERE trim(regexp_replace(regexp_replace(text, '[A-Za-z\s]+', '', 'g'), '[.,]+', '', 'g')) = ''),
l AS (SELECT 'images/p10/s' || conv_id AS target, count(*) AS num_files, CAST(sum(length(text)) AS BIGINT) AS bytes FROM conversations GROUP BY 1)
SELECT '2024-01-01T00:00:00' AS timestamp, true AS dry_run, count(*) AS targets, count(num_files) AS found,
  count(e.target) - count(num_files) AS not_found, count(*) - count(e.target) AS path_errors,
  CAST(coalesce(sum(num_files), 0) AS BIGINT) AS num_files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM e LEFT JOIN l ON l.target = e.target""",
)
def deletion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import scratch_path

    return S.write_deletion_log(deletion_manifest(spark, sf_dir), scratch_path(spark, "deletion"), "2024-01-01T00:00:00")


@query(
    "case_database",
    """
SELECT vec_id AS study_id, source, len(embedding) AS feature_dim, h.n AS n_entities
FROM documents JOIN embeddings ON vec_id = doc_id
JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) h ON h.l_orderkey = doc_id""",
)
def case_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study_id"), "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("study_id"), "embedding")
    graphs = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("study_id"))
        .agg(F.count(F.lit(1)).alias("n_entities"))
    )
    cases = S.case_database(vectors, graphs, docs, "study_id")
    return cases.select("study_id", "source", F.size("embedding").cast("bigint").alias("feature_dim"), "n_entities")


@query(
    "training_table",
    """
SELECT d.doc_id AS study_id, len(e.embedding) AS length, CAST(coalesce(l.quality, 0) AS DOUBLE) AS quality,
  CAST(coalesce(l.toxic, 0) AS DOUBLE) AS toxic, coalesce(h.t, '') AS history_text,
  length(CASE WHEN length(d.source) < 5 THEN d.text ELSE d.source END) AS report_chars
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS t FROM orders) h ON h.o_orderkey = d.doc_id""",
)
def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import text_or_fallback

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study_id"), "text", "source")
    studies = docs.select(
        "study_id", F.length(text_or_fallback(F.col("source"), F.col("text"))).cast("bigint").alias("report_chars")
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("study_id"), F.size("embedding").cast("bigint").alias("length")
    )
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("study_id"), *[F.col(c).cast("double").alias(c) for c in ("quality", "toxic")]
    )
    told = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study_id"), told.alias("history_text"))
    return S.training_table(studies, vectors, labels, history, "study_id", ["quality", "toxic"])
