"""Disease knowledge base: entities, relations, co-occurrence and bounded subgraphs.

Tables: ``kb_entity`` (icd, name, type, category, frequency) and ``kb_relation``
(src, tgt, rel_type, weight, ord). ``ord`` is the position of a relation in the base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Codes of a chunk of a basket.
CHUNK_CODES = 64
RELATION_SCHEMA = "src string, tgt string, rel_type string, weight double, ord long"


def category_of(code: Column, categories: Sequence[tuple[str, str]], default: str = "Unknown") -> Column:
    """Name of the first category whose first three characters the code starts with."""
    out = None
    for cat, name in categories:
        test = code.startswith(cat.replace("-", "")[:3])
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else out.otherwise(default)


def disease_entities(
    diagnoses: DataFrame, *, code: str, name: str, order: Sequence[str], categories: Sequence[tuple[str, str]]
) -> DataFrame:
    """``kb_entity``: frequency, first-seen name and category of every code."""
    found = diagnoses.groupBy(F.col(code).alias("icd")).agg(
        F.min_by(name, F.struct(*order)).alias("name"), F.count(F.lit(1)).alias("frequency")
    )
    return found.select(
        "icd", "name", F.lit("disease").alias("type"), category_of(F.col("icd"), categories).alias("category"), "frequency"
    )


def top_diseases(entities: DataFrame, k: int = 10) -> DataFrame:
    return entities.orderBy(F.col("frequency").desc(), "icd").limit(k)


def cooccurrence(
    diagnoses: DataFrame, *, basket: str, code: str, min_support: int = 10, min_confidence: float = 0.3, chunk: int = CHUNK_CODES
) -> DataFrame:
    """Code pairs (a < b) that share at least ``min_support`` baskets.

    Confidence is support over the rarer code's baskets. Codes below the support
    cannot be part of a pair and leave first. A basket's codes are dealt into chunks of about ``chunk`` codes;
    pairs inside a chunk come from its row, pairs of two chunks from a triangular grid of cells that meet by
    (basket, chunk, chunk). So a basket of any size spreads over tasks, no array holds its pairs, and only pair
    totals are shuffled.
    """
    # a basket's distinct codes are at most all codes, so one array may hold them; as arrays they move in few bytes
    packed = lambda rows: rows.groupBy(basket).agg(F.collect_set(code).alias("__set"))
    sets = cut_lineage(packed(diagnoses.select(basket, code).filter(F.col(code).isNotNull())), "baskets")
    once = sets.select(basket, F.explode("__set").alias(code))
    counts = once.groupBy(code).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)
    counts = cut_lineage(counts, "counts")  # its size is known then, and baskets need not move to meet it
    kept = packed(once.join(counts.select(code), code, "left_semi"))
    sized = kept.select(basket, F.ceil(F.size("__set") / chunk).alias("__parts"), F.explode("__set").alias(code))
    place = F.pmod(F.xxhash64(code), F.col("__parts")).alias("__i")
    chunks = (
        sized.select(basket, code, "__parts", place)
        .groupBy(basket, "__parts", "__i").agg(F.array_sort(F.collect_set(code)).alias("codes"))
    )
    chunks = cut_lineage(chunks, "chunks")  # read for pairs inside, and on both sides of pairs across
    inside = chunks.select("codes", F.posexplode("codes").alias("__p", "a"))
    inside = inside.select("a", F.explode(F.slice("codes", F.col("__p") + 2, F.size("codes"))).alias("b"))
    wide = chunks.filter("__parts > 1")
    left = wide.filter("__i < __parts - 1").select(basket, "__i", F.explode(F.sequence(F.col("__i") + 1, F.col("__parts") - 1)).alias("__j"), F.col("codes").alias("__l"))
    right = wide.filter("__i > 0").select(basket, F.col("__i").alias("__j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__i") - 1)).alias("__i"), F.col("codes").alias("__r"))
    across = left.join(right, [basket, "__i", "__j"]).select(F.explode("__l").alias("x"), "__r").select("x", F.explode("__r").alias("y"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = inside.unionByName(across).groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))
    pairs = pairs.filter(F.col("support") >= min_support)
    left = counts.select(F.col(code).alias("a"), F.col("n").alias("n_a"))
    right = counts.select(F.col(code).alias("b"), F.col("n").alias("n_b"))
    scored = pairs.join(left, "a").join(right, "b")
    scored = scored.withColumn("confidence", F.col("support") / F.least("n_a", "n_b"))
    return scored.filter(F.col("confidence") >= min_confidence).select("a", "b", "support", "confidence")


def cooccurrence_relations(pairs: DataFrame, first_ord: int = 0) -> DataFrame:
    """Both directions of every pair as relations; ``ord`` follows the pair's codes."""
    both = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("tgt")), F.struct(F.col("b").alias("src"), F.col("a").alias("tgt"))
    )
    return pairs.select(F.inline(both), F.col("confidence").alias("weight")).select(
        "src", "tgt", F.lit("co-occurs_with").alias("rel_type"), "weight", F.lit(first_ord).cast("long").alias("ord")
    )


def fixed_relations(spark: SparkSession, relations: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(relations)], RELATION_SCHEMA)


def knowledge_base(
    spark: SparkSession,
    diagnoses: DataFrame,
    *,
    basket: str,
    code: str,
    name: str,
    order: Sequence[str],
    categories: Sequence[tuple[str, str]],
    relations: Sequence[tuple[str, str, str, float]],
    min_support: int = 10,
    min_confidence: float = 0.3,
) -> tuple[DataFrame, DataFrame]:
    """(kb_entity, kb_relation) from diagnoses and fixed relations."""
    entities = disease_entities(diagnoses, code=code, name=name, order=order, categories=categories)
    mined = cooccurrence(
        diagnoses, basket=basket, code=code, min_support=min_support, min_confidence=min_confidence
    )
    fixed = fixed_relations(spark, relations)
    return entities, fixed.unionByName(cooccurrence_relations(mined, len(relations)))


def relations_of(relations: DataFrame, codes: DataFrame, code: str, types: Sequence[str] | None = None) -> DataFrame:
    """Outgoing relations of the codes, of the given types."""
    kept = relations if types is None else relations.filter(F.col("rel_type").isin(list(types)))
    return kept.join(codes.select(F.col(code).alias("src")).distinct(), "src", "left_semi")


def knowledge_statistics(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, name, n): entities, relations and relations per type."""
    per_type = relations.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    rows = per_type.select(F.lit("relation_type").alias("kind"), F.col("rel_type").alias("name"), "n")
    for kind, df in (("entities", entities), ("relations", relations)):
        total = df.agg(F.count(F.lit(1)).alias("n"))
        rows = rows.unionByName(total.select(F.lit(kind).alias("kind"), F.lit("all").alias("name"), "n"))
    return rows


def relation_heads(links: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(head, tail): relations to the first ``n`` different targets of their source, by (ord, tgt), and the others."""
    targets = links.groupBy("src", "tgt").agg(F.min("ord").alias("__o"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("__o", "tgt"))
    first = cut_lineage(targets.withColumn("__r", rank).filter(F.col("__r") <= n).select("src", "tgt"), "heads")
    return links.join(first, ["src", "tgt"], "left_semi"), links.join(first, ["src", "tgt"], "left_anti")


def subgraph(
    seeds: DataFrame,
    entities: DataFrame,
    relations: DataFrame,
    *,
    key: str,
    code: str,
    max_hop: int = 2,
    max_entities: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """Bounded neighbourhood of each key's codes: (key, icd) and (key, src, tgt, rel_type, weight).

    Growth is hop by hop; within a hop sources go by code, a source's relations by
    ``ord`` then target, and its three-character parent comes last. A target joins
    while there is room; a source is visited only while there is room. Seeds that
    fill the limit are cut to the first codes and bring no relation. In the end
    everything is closed on codes known to the base.

    Of a source only its first ``max_entities`` targets can join, as no more of them can be members already: these
    are its head, and the only relations that meet every key. The rest of a hub's relations is asked only for pairs
    of members, of which a key has a bounded number.
    """
    # one row per key holds its members and edges while it grows: keys meet tables of codes only, and move once
    known = entities.select("icd")
    links = relations.select("src", "tgt", "rel_type", "weight", "ord")
    head, tail = relation_heads(links, max_entities)
    link = F.struct(F.lit(0).alias("last"), "ord", "tgt", "rel_type", "weight")
    outs = cut_lineage(head.groupBy("src").agg(F.collect_list(link).alias("links")), "links")
    tail = cut_lineage(tail, "tail")
    parents = known.select(F.col("icd").alias("parent")).distinct()
    has = lambda codes, x: F.coalesce(F.array_contains(codes, x), F.lit(False))
    edge = "array<struct<src:string,tgt:string,rel_type:string,weight:double>>"
    seeded = seeds.groupBy(key).agg(F.slice(F.array_sort(F.collect_set(F.struct(F.col(code).alias("icd")))), 1, max_entities).alias("m"))
    state = seeded.select(key, F.transform("m", lambda x: x["icd"]).alias("members"), F.transform("m", lambda x: x["icd"]).alias("front"))
    state = state.withColumns({"edges": F.array().cast(edge), "asks": F.array().cast("array<struct<srcs:array<string>,members:array<string>>>")})
    for _ in range(max_hop):
        room = F.when(F.col(key).isNotNull(), F.lit(max_entities) - F.size("members")).otherwise(0)
        state = state.withColumn("room", room).withColumn("front", F.when(F.col("room") > 0, F.col("front")))
        rest = ["members", "front", "edges", "asks", "room"]
        front = state.select(key, *rest, F.explode_outer("front").alias("src")).join(outs, "src", "left")
        front = front.withColumn("up", F.when(F.length("src") > 3, F.substring("src", 1, 3))).join(parents, F.col("up") == F.col("parent"), "left")
        none = F.array().cast("array<struct<last:int,ord:bigint,tgt:string,rel_type:string,weight:double>>")
        up = F.struct(F.lit(1).alias("last"), F.lit(0).cast("long").alias("ord"), F.col("parent").alias("tgt"), F.lit("is_a").alias("rel_type"), F.lit(1.0).alias("weight"))
        both = F.concat(F.coalesce("links", none), F.when(F.col("parent").isNotNull(), F.array(up)).otherwise(none))
        steps = F.transform(both, lambda x: F.struct(F.col("src"), *[x[c].alias(c) for c in ("last", "ord", "tgt", "rel_type", "weight")]))
        state = front.groupBy(key).agg(*[F.first(c).alias(c) for c in rest], F.array_sort(F.flatten(F.collect_list(steps))).alias("steps"))
        # targets in the order of the sources that bring them
        fresh = F.filter("steps", lambda x: x["tgt"].isNotNull() & ~has(F.col("members"), x["tgt"]))
        state = state.withColumn("fresh", F.array_distinct(F.transform(fresh, lambda x: x["tgt"])))
        state = state.withColumn("joined", F.slice("fresh", 1, F.greatest("room", F.lit(0))))
        # the source that fills the last free place is the last one visited
        filled = F.get(F.filter("steps", lambda x: x["tgt"] == F.get(F.col("joined"), F.col("room") - 1)), F.lit(0))["src"]
        state = state.withColumn("last_src", F.when((F.col("room") > 0) & (F.size("fresh") >= F.col("room")), filled))
        state = state.withColumn("members", F.concat("members", "joined"))
        visited = lambda src: F.col("last_src").isNull() | (src <= F.col("last_src"))
        kept = F.filter("steps", lambda x: has(F.col("members"), x["tgt"]) & visited(x["src"]))
        kept = F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("src", "tgt", "rel_type", "weight")]))
        srcs = F.filter(F.coalesce("front", F.array().cast("array<string>")), visited)
        ask = F.struct(srcs.alias("srcs"), F.col("members").alias("members"))
        state = state.select(key, "members", F.col("joined").alias("front"), F.concat("edges", kept).alias("edges"), F.concat("asks", F.array(ask)).alias("asks"))
    state = cut_lineage(state.select(key, "members", "edges", "asks"), "subgraph")
    edges = state.select(key, F.inline("edges"))
    hubs = tail.select("src").distinct()
    asked = state.select(key, F.inline("asks")).select(key, "members", F.explode("srcs").alias("src")).join(hubs, "src", "left_semi")
    beyond = asked.select(key, "src", F.explode("members").alias("tgt")).join(tail, ["src", "tgt"])
    edges = edges.unionByName(beyond.select(key, "src", "tgt", "rel_type", "weight"))
    nodes = state.select(key, F.explode("members").alias("icd")).join(known, "icd", "left_semi").select(key, "icd")
    ends = known.select(F.col("icd").alias("src")), known.select(F.col("icd").alias("tgt"))
    edges = edges.join(ends[0], "src", "left_semi").join(ends[1], "tgt", "left_semi")
    return nodes, edges.select(key, "src", "tgt", "rel_type", "weight")
