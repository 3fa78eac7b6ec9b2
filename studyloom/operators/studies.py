"""Assembling the study table: images per study, lookups, splits, resume and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import ids

VIEW_PRIORITY = ("PA", "AP", "LATERAL", "LL")
MAX_VIEWS = 4
STATUS_FOUND, STATUS_MISSING, STATUS_BAD_PATH = "would_delete", "not_found", "path_error"


def images_per_study(images: DataFrame, keys: Sequence[str], path: str, view: str, taken: str) -> DataFrame:
    """Per study: ``images`` array of (path, view) ordered by path, and the earliest ``study_dt``.

    Null views stay in the array. One aggregation serves both the image list and
    the first study time.
    """
    return images.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col(view).alias("view")))).alias("images"),
        F.min(taken).alias("study_dt"),
    )


def pick_views(images: Column, priority: Sequence[str] = VIEW_PRIORITY, limit: int = MAX_VIEWS) -> Column:
    """Struct (views, num_views, original_num_views, truncated): best views first, at most ``limit``."""
    order = F.array(*[F.lit(v) for v in priority])
    rank = lambda v: F.coalesce(F.array_position(order, F.upper(v)), F.lit(0))
    ranked = F.transform(
        images,
        lambda x, i: F.struct(
            F.when(rank(x["view"]) > 0, rank(x["view"])).otherwise(999).alias("rank"), i.alias("i"), x.alias("image")
        ),
    )
    best = F.transform(F.slice(F.array_sort(ranked), 1, limit), lambda r: r["image"])
    return F.struct(
        best.alias("views"),
        F.least(F.size(images), F.lit(limit)).alias("num_views"),
        F.size(images).alias("original_num_views"),
        (F.size(images) > limit).alias("truncated"),
    )


def unique_titles(titles: DataFrame, code: str, title: str, order: Sequence[str]) -> DataFrame:
    """One title per code: the last by ``order`` (duplicates may occur in the dictionary)."""
    return titles.groupBy(code).agg(F.max_by(title, F.struct(*order)).alias(title))


def with_title(diagnoses: DataFrame, titles: DataFrame, code: str, title: str, missing: str = "Unknown") -> DataFrame:
    """Left lookup of the title. Spark broadcasts the dictionary if its measured size allows it."""
    return diagnoses.join(titles.select(code, title), code, "left").withColumn(title, F.coalesce(title, F.lit(missing)))


def with_severity_group(
    admissions: DataFrame, groups: DataFrame, *, key: str, kind: str, wanted: str, fields: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Left lookup of the ``wanted`` kind of group row as struct ``drg`` (null where there is none).

    Where an admission has several rows the first by ``order`` is kept and
    ``drg_rows`` tells how many there were.
    """
    one = (
        groups.filter(F.col(kind) == wanted)
        .groupBy(key)
        .agg(
            F.min_by(F.struct(*fields), F.struct(*order)).alias("drg"),
            F.count(F.lit(1)).alias("drg_rows"),
        )
    )
    return admissions.join(one, key, "left").withColumn("drg_rows", F.coalesce("drg_rows", F.lit(0)))


def assign_split(studies: DataFrame, splits: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Adds the split of each study; studies in no split are dropped. Repeats in ``splits`` collapse first."""
    return studies.join(splits.select(key, split).distinct(), key)


def keep_listed(df: DataFrame, listed: DataFrame, key: str, listed_only: bool = True) -> DataFrame:
    """Rows whose key is (not) in ``listed``; also used to resume and to prune folders."""
    return df.join(listed.select(key), key, "left_semi" if listed_only else "left_anti")


def partition_filter(df: DataFrame, subject: str, prefixes: Sequence[str]) -> DataFrame:
    return df.filter(ids.subject_prefix(F.col(subject)).isin(list(prefixes)))


def first_image_exists(studies: DataFrame, paths: DataFrame, images: str, path: str, rewrite) -> DataFrame:
    """Studies whose first image, after ``rewrite``, is in the path table."""
    first = rewrite(F.element_at(F.col(images), 1)["path"])
    known = paths.select(F.col(path).alias("__first"))
    return (
        studies.filter(F.size(images) > 0)
        .withColumn("__first", first)
        .join(known, "__first", "left_semi")
        .drop("__first")
    )


def file_inventory(paths: DataFrame, path: str) -> DataFrame:
    """(kind, name, n): distinct folders per depth and files per extension group."""
    parts = F.split(F.col(path), "/")
    folders = paths.select(F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("depth"), parts.alias("p")).filter(
        F.col("depth") >= 1
    )
    by_depth = (
        folders.select("depth", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("folder"))
        .distinct()
        .groupBy("depth")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("folders").alias("kind"), F.col("depth").cast("string").alias("name"), "n")
    )
    ext = F.lower(F.regexp_extract(F.element_at(parts, -1), r".(\.[^.]*)$", 1))
    group = F.when(ext.isin(".jpg", ".jpeg"), "jpg").when(ext == ".txt", "txt").otherwise("others")
    by_ext = paths.groupBy(group.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by_depth.unionByName(by_ext.select(F.lit("files").alias("kind"), "name", "n"))


def deletion_manifest(
    empty: DataFrame, listing: DataFrame, *, target: Column, key: Sequence[str], path: str, size: str, folder: bool
) -> DataFrame:
    """What would be deleted for ``empty`` studies; nothing is ever deleted.

    A folder target matches every listed file below it.
    """
    place = F.regexp_replace(F.col(path), "/[^/]*$", "") if folder else F.col(path)
    found = listing.groupBy(place.alias("target")).agg(
        F.count(F.lit(1)).alias("num_files"), F.sum(size).cast("bigint").alias("bytes")
    )
    wanted = empty.select(*key, target.alias("target"))
    status = (
        F.when(F.col("target").isNull(), STATUS_BAD_PATH)
        .when(F.col("num_files").isNull(), STATUS_MISSING)
        .otherwise(STATUS_FOUND)
    )
    return wanted.join(found, "target", "left").select(
        *key,
        F.coalesce("target", F.lit("N/A")).alias("path"),
        F.coalesce("num_files", F.lit(0)).alias("num_files"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        status.alias("status"),
    )


def pick_cases(conditions: Sequence[DataFrame], key: str, n: int) -> DataFrame:
    """The first ``n`` keys, in order, that every one of ``conditions`` has a row for."""
    out = conditions[0].select(key).distinct()
    for other in conditions[1:]:
        out = out.join(other.select(key), key, "left_semi")
    return out.orderBy(key).limit(n)


def case_database(vectors: DataFrame, graphs: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """One row per study that has a vector, a report and a graph; all three join on the study key."""
    return reports.join(vectors, key).join(graphs, key)


def extraction_summary(views: DataFrame, study: str, vec: str) -> DataFrame:
    """One row: images, studies, images per study and the largest vector length of an extraction."""
    n, studies = F.count(F.lit(1)), F.countDistinct(study)
    return views.agg(
        n.alias("num_images"),
        studies.alias("num_studies"),
        F.round(n / studies, 6).alias("images_per_study"),
        F.max(F.size(vec)).cast("bigint").alias("feature_dim"),
    )


def write_deletion_log(manifest: DataFrame, path: str, timestamp: str, dry_run: bool = True) -> DataFrame:
    """Writes the manifest as JSON lines below ``path``, and the record of the run beside it; returns the record.

    (timestamp, dry_run, targets, found, not_found, path_errors, num_files, bytes), counted while the manifest is
    written. Nothing is deleted here; ``dry_run`` only says so.
    """
    is_ = lambda s: F.col("status") == s
    seen = Observation("deletion log")
    sums = {"num_files": "num_files", "bytes": "bytes"}
    counted = manifest.observe(
        seen,
        F.count(F.lit(1)).alias("targets"),
        F.count_if(is_(STATUS_FOUND)).alias("found"),
        F.count_if(is_(STATUS_MISSING)).alias("not_found"),
        F.count_if(is_(STATUS_BAD_PATH)).alias("path_errors"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for name, c in sums.items()],
    )
    counted.write.json(f"{path}/details")
    names = list(seen.get)
    record = manifest.sparkSession.createDataFrame(
        [(timestamp, dry_run, *seen.get.values())], "timestamp string, dry_run boolean, " + ", ".join(f"{n} long" for n in names)
    )
    record.coalesce(1).write.json(f"{path}/record")
    return record


def id_profile(df: DataFrame, col: str) -> DataFrame:
    """Distinct ids in order with the number of rows each has."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(col)


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def ids_per_prefix(df: DataFrame, col: str) -> DataFrame:
    """Number of distinct ids per two-character prefix (ids shorter than that are left out)."""
    text = F.col(col).cast("string")
    return (
        df.select(text.alias("id"))
        .filter(F.length("id") >= 2)
        .groupBy(F.concat(F.lit("p"), F.substring("id", 1, 2)).alias("prefix"))
        .agg(F.countDistinct("id").alias("n_ids"))
    )


def training_table(
    studies: DataFrame, vectors: DataFrame, labels: DataFrame, histories: DataFrame, key: str, label_names: Sequence[str]
) -> DataFrame:
    """One row per study with vector (required), labels (missing: zeros) and history text (missing: '').

    All inputs join on the study key, so one hash partitioning serves every join.
    """
    out = studies.join(vectors, key).join(labels, key, "left").join(histories, key, "left")
    zeros = {n: 0.0 for n in label_names}
    return out.fillna(zeros).withColumn("history_text", F.coalesce("history_text", F.lit("")))
