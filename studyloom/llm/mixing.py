"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic). The cells' token weights are raked to the target
shares of one dimension after the other until all margins agree; a document is then taken as often as its cell's
calibrated weight per token says: the whole part of the weight always, and once more with its fraction as the
probability, so the expected tokens of every cell are the raked ones. Only cells move through the iteration, never
documents: margins are window sums over the cells, and the lineage is cut after every few sweeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.session import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
SWEEPS_PER_STEP = 4

#: Topics by what a text contains, the first that fits; the rest is prose.
TOPICS = (
    ("legal", "(?i)(licen[cs]e|copyright|all rights reserved)"),
    ("table", r"\|"),
    ("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9]"),
    ("numeric", "[0-9]{4}"),
)
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """The topic by ``TOPICS``, whose words are looked for as such and whose signs stand before a pattern."""
    low = F.lower(text)
    legal = low.contains("license") | low.contains("licence") | low.contains("copyright") | low.contains("all rights reserved")
    tests = {"legal": legal, "table": text.contains("|")}
    tests["contact"] = text.contains("@") & text.rlike("[A-Za-z0-9._]@[A-Za-z0-9]")
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(tests.get(name, text.rlike(pattern)), name).otherwise(out)
    return F.coalesce(out, F.lit("prose"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares (value, share) of a dimension: its token shares to ``power``, normalised."""
    totals = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
    totals = totals.withColumn("raised", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(power))).otherwise(0.0))
    whole = totals.agg(F.sum("raised").alias("whole"))
    return totals.join(F.broadcast(whole)).select("value", F.when(F.col("whole") > 0, F.col("raised") / F.col("whole")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 12) -> DataFrame:
    """Calibrated ``weight`` of every cell (columns of ``targets`` and ``tokens``).

    A target is a table (value, share). The weights add up to the tokens; cells of values without a share get
    weight 0. Margins are met one after the other, so after the last sweep the last dimension agrees exactly.
    """
    total = F.broadcast(cells.agg(F.sum("tokens").cast("double").alias("__total")))  # one row
    rows = cells.withColumn("weight", F.col("tokens").cast("double")).join(total)
    for dimension, target in targets.items():
        rows = rows.join(target.select(F.col("value").alias(dimension), F.col("share").alias(f"__{dimension}")), dimension, "left")
    for sweep in range(sweeps):
        for dimension in targets:
            margin = F.sum("weight").over(Window.partitionBy(dimension))
            scaled = F.when(margin > 0, F.col("weight") * (F.col(f"__{dimension}") * F.col("__total") / margin))
            rows = rows.withColumn("weight", F.coalesce(scaled, F.lit(0.0)))
        if (sweep + 1) % SWEEPS_PER_STEP == 0 or sweep + 1 == sweeps:
            rows = cut_lineage(rows, "rake")
    return rows.drop("__total", *[f"__{d}" for d in targets])


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number from 0 to 1 that the id decides."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def described(docs: DataFrame) -> DataFrame:
    """Adds __source, __lang, __topic, __tokens (words) to every row; missing values are named ``unknown``."""
    named = {f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("source", "lang")}
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({**named, "__topic": topic_of(text), "__tokens": F.regexp_count(text, F.lit(WORD)).cast("long")})


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.7, sweeps: int = 12, rows: DataFrame | None = None
) -> DataFrame:
    """Adds the columns __source, __lang, __topic, __tokens, __weight, __prob, __kept, __copies to every row.

    ``__weight`` is the calibrated weight per token of the row's cell (1 on average) and ``__copies`` how often the
    sample has the row: ``__weight`` on average, so the copies have the target shares. ``__prob`` is the probability
    of at least one copy (``__weight``, at most 1) and ``__kept`` tells whether there is one; the kept rows alone
    do not have the target shares. Without ``targets`` each dimension's share is its present token share to ``power``. Null metadata form values of their
    own, documents without tokens are weighted as their cell is (a cell without any tokens: kept), and repeated
    rows share one decision. An empty table gives an empty result. ``rows`` is ``described(docs)`` where
    that is at hand.
    """
    rows = described(docs) if rows is None else rows
    cells = rows.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__tokens").alias("tokens"))
    cells = cut_lineage(cells, "cells")
    if targets is None:
        targets = {d: cut_lineage(tempered(cells, d, power), "target") for d in DIMENSIONS}
    weighted = rake(cells, targets, sweeps).withColumn("__weight", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    prob = F.coalesce(F.least(F.lit(1.0), F.col("__weight")), F.lit(1.0))
    weighted = weighted.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], "__weight", prob.alias("__prob"))
    weighted = cut_lineage(weighted, "weights")  # its size is known, so the planner can tell whether to broadcast it
    joined = rows.join(weighted, [f"__{d}" for d in DIMENSIONS])
    drawn, weight = uniform(F.col("doc_id")), F.coalesce("__weight", F.lit(1.0))
    copies = F.floor(weight) + (drawn < weight - F.floor(weight)).cast("long")
    return joined.withColumns({"__kept": drawn < F.col("__prob"), "__copies": copies.cast("int")})


def sample_mix(docs: DataFrame, power: float = 0.7) -> DataFrame:
    """The documents as often as their calibrated weights say, with their columns as they were."""
    rows = mix(docs, power=power).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest_mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, prob, kept of every row (weight and prob to 9 digits)."""
    # texts are read once: cells and result come from what was found in them
    rows = cut_lineage(described(docs.select("doc_id", "source", "lang", "text")).drop("text"), "described")
    rows = mix(rows, rows=rows)
    return rows.select(
        "doc_id",
        F.col("__source").alias("source"),
        F.col("__lang").alias("lang"),
        F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 9).alias("weight"),
        F.round("__prob", 9).alias("prob"),
        F.col("__kept").alias("kept"),
    )


def mix_sql(power: float = 0.7, sweeps: int = 12, dimensions: Sequence[str] = DIMENSIONS) -> str:
    """The same in SQL, with the sweeps written out."""
    cases = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [
        "d AS MATERIALIZED (SELECT doc_id, coalesce(source, 'unknown') source, coalesce(lang, 'unknown') lang, "
        f"CASE {cases} ELSE 'prose' END topic, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) n_tokens "
        "FROM (SELECT *, coalesce(text, '') t FROM documents))",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) tokens, CAST(sum(n_tokens) AS DOUBLE) w FROM d GROUP BY ALL)",
    ]
    for dim in dimensions:
        parts.append(
            f"t_{dim} AS MATERIALIZED (SELECT {dim}, r / sum(r) OVER () share FROM (SELECT {dim}, pow(sum(w), {power}) r FROM c0 GROUP BY 1))"
        )
    last = "c0"
    for step in range(sweeps * len(dimensions)):
        dim = dimensions[step % len(dimensions)]
        parts.append(
            f"c{step + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN m.s > 0 THEN c.w * (t.share * n.total / m.s) ELSE 0 END w "
            f"FROM {last} c JOIN (SELECT {dim}, sum(w) s FROM {last} GROUP BY 1) m USING ({dim}) JOIN t_{dim} t USING ({dim}), "
            "(SELECT sum(w) total FROM c0) n)"
        )
        last = f"c{step + 1}"
    parts.append(f"f AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN w / tokens END weight FROM {last})")
    parts.append(
        "p AS MATERIALIZED (SELECT source, lang, topic, weight, coalesce(least(1.0, weight), 1.0) prob FROM f)"
    )
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) weight, round(prob, 9) prob, "
        "CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < prob kept "
        "FROM d JOIN p USING (source, lang, topic)"
    )
