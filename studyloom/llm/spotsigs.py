"""Document fingerprints by SpotSigs, in SQL expressions only.

A spot signature is a common word (the anchor) and the next content words after it; the anchors of running text
sit in its prose and hardly in boilerplate. A text's fingerprint is the sorted set of the hashes of its
signatures. Two fingerprints are compared by the Jaccard index of their sets; sets whose lengths already rule a
similarity out are not intersected. ``length_band`` numbers the partition of a set's length: sets that reach the
similarity are in the same or in neighbouring bands.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of the languages at hand. Fixed values.
ANCHORS = (
    "a an and are as at be been by for from had has have in is it of on or that the this to was were which with "
    "au avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "das dem den der des die ein eine er es im ist mit nicht und von war zu "
    "al con del el ella los las lo no por se sin su una y"
)
CHAIN = 2
SIMILAR = 0.8


def _words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.concat(F.lit(" "), spaced, F.lit(" "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spots(text: Column, chain: int = CHAIN, anchors: str = ANCHORS) -> Column:
    """Sorted distinct 32-bit hashes of a text's spot signatures.

    A text with words but no complete signature has the hash of all its words instead; a text without words has
    none.
    """
    common = "|".join(sorted(set(anchors.split()), key=lambda w: (w[0], -len(w), w)))
    content = lambda t: F.substring_index(t, "_", -1)
    def signatures(z: Column) -> Column:
        parts = F.split(z["t0"], "_")
        heads = F.array_distinct(F.slice(parts, 1, F.size(parts) - 1))
        after = [content(z[f"t{i}"]) for i in range(chain)]
        complete = F.contains(z["t0"], F.lit("_"))
        for word in after:
            complete = complete & (F.coalesce(word, F.lit("")) != "")
        return F.when(complete, F.transform(heads, lambda h: F.hash(h, *after))).otherwise(F.array().cast("array<int>"))

    def of_tokens(tokens: Column) -> Column:
        following = [F.slice(tokens, i + 1, F.size(tokens)).alias(f"t{i}") for i in range(1, chain)]
        return F.array_sort(F.array_distinct(F.flatten(F.transform(F.arrays_zip(tokens.alias("t0"), *following), signatures))))

    def of_words(words: Column) -> Column:
        # every common word is glued to the word after it: "the house of a cat" is [the_house, of_a_cat]
        tokens = F.split(F.trim(F.regexp_replace(words, rf"(?<= )({common}) ", "$1_")), " ")
        whole = F.when(F.trim(words) == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(words)))
        return _let(_let(tokens, of_tokens), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))

    return _let(_words(text), of_words)


def fingerprint(found: Column) -> Column:
    """Eight hex digits per signature."""
    return F.array_join(F.transform(found, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two signature sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def alike(a: Column, b: Column, similar: float = SIMILAR) -> Column:
    """Whether two sets reach a similarity; the ratio of their lengths is tried first."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(low < similar * high, False).otherwise(likeness(a, b) >= similar)


def length_band(found: Column, similar: float = SIMILAR) -> Column:
    return F.floor(F.log(F.greatest(F.size(found), F.lit(1)).cast("double")) / F.lit(-math.log(similar))).cast("int")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds ``spots`` and ``fingerprint`` to every row; null texts count as empty, rows stay where they are."""
    rows = docs.withColumn("spots", spots(F.coalesce("text", F.lit(""))))
    return rows.withColumn("fingerprint", fingerprint(F.col("spots")))


def with_next(rows: DataFrame, order: str, columns: list[str], buckets: int) -> DataFrame:
    """Adds ``next``, a struct of ``columns`` of the row that follows by descending ``order``, cyclically.

    Rows are cut into ranges of ``order`` at quantiles, each range is one window, and the first row of every range
    is also put behind the last row of the range before it; so no row meets more than its own range. Equal order
    values are ordered by hash of the columns; nulls come last.
    """
    spark = rows.sparkSession
    cuts = rows.agg(F.approx_percentile(order, [i / buckets for i in range(1, buckets)]).alias("cuts")).head()[0] or []
    cuts = sorted(set(cuts))
    level = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (F.col(order) >= c).cast("int")) if cuts else F.lit(0)
    bucket = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(level)
    heads = rows.select(order, bucket.alias("bucket")).groupBy("bucket").agg(F.max(order).alias("head")).orderBy(F.desc("bucket")).collect()
    if not heads:
        return rows.withColumn("next", F.struct(*columns))
    # at most one short row per bucket
    follow = [(heads[(i + 1) % len(heads)]["head"], head["bucket"]) for i, head in enumerate(heads)]
    follow = spark.createDataFrame(follow, "__head long, __target int")
    ghosts = rows.join(F.broadcast(follow), F.col(order).eqNullSafe(F.col("__head"))).withColumn("__ghost", F.lit(True))
    own = rows.withColumns({"__target": bucket.cast("int"), "__ghost": F.lit(False)})
    both = own.unionByName(ghosts.drop("__head"))
    tie = F.xxhash64(*columns)
    window = Window.partitionBy("__target").orderBy("__ghost", F.desc_nulls_last(order), tie)
    return both.withColumn("next", F.lead(F.struct(*columns)).over(window)).filter(~F.col("__ghost")).drop("__target", "__ghost")


def digest_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last half of the code points replaced by as many from the start of the next document
    (descending doc_id, after the last the first). Output: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_spots, length_band. Null texts count as empty; of repeated ids
    one follows the other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("spots", spots(F.col("text")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(rows, "doc_id", ["text", "spots"], 2 * parts)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "spots", F.col("next.spots").alias("next_spots"))
    rows = rows.withColumn("edited_spots", spots(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        F.size("spots").cast("long").alias("n_spots"),
        length_band(F.col("spots")).alias("length_band"),
    )
