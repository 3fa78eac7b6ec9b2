"""Corpus metric queries over the conversation pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..session import cut_lineage
from . import query
from .tables import PAIRS_SQL, pairs
from .texts import metric_sql


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, ref, hyp) as metric tokens; pairs with an empty side are dropped."""
    cleaned = pairs(spark, sf_dir).select(
        "pair_id", T.metric_clean(F.col("ref")).alias("ref"), T.metric_clean(F.col("hyp")).alias("hyp")
    )
    kept = cleaned.filter((F.col("ref") != "") & (F.col("hyp") != ""))
    return kept.select("pair_id", F.split("ref", " ").alias("ref"), F.split("hyp", " ").alias("hyp"))


TOKENS_SQL = f"""{PAIRS_SQL},
clean AS (SELECT pair_id, {metric_sql('ref')} AS r, {metric_sql('hyp')} AS h FROM pairs),
tok AS (SELECT pair_id, string_split(r, ' ') AS ref, string_split(h, ' ') AS hyp FROM clean WHERE r <> '' AND h <> '')"""

COUNTS_SQL = f"""{TOKENS_SQL},
ng AS (
  SELECT pair_id, n, unnest(list_transform(range(1, len(hyp) - n + 2), lambda i: array_to_string(hyp[i:i + n - 1], ' '))) AS gram, 1 AS h, 0 AS r
  FROM tok, unnest(range(1, 5)) AS u(n)
  UNION ALL
  SELECT pair_id, n, unnest(list_transform(range(1, len(ref) - n + 2), lambda i: array_to_string(ref[i:i + n - 1], ' '))), 0, 1
  FROM tok, unnest(range(1, 5)) AS u(n)),
cnt AS (SELECT pair_id, n, gram, CAST(sum(h) AS DOUBLE) AS h, CAST(sum(r) AS DOUBLE) AS r FROM ng GROUP BY 1, 2, 3)"""

_SUMS = ", ".join(
    ["coalesce(sum(r) FILTER (n = 1), 0) AS r1"]
    + [f"coalesce(sum(least(h, r)) FILTER (n = {k}), 0) AS m{k}, coalesce(sum(h) FILTER (n = {k}), 0) AS c{k}" for k in range(1, 5)]
)
_BP = "(CASE WHEN (c1 + 1e-15) / (r1 + 1e-9) < 1 THEN exp(1 - 1 / ((c1 + 1e-15) / (r1 + 1e-9))) ELSE 1.0::DOUBLE END)"
_BLEU = ", ".join(
    "round(pow({}, 1.0::DOUBLE / {}) * {}, 6) AS bleu_{}".format(
        " * ".join(f"((m{j} + 1e-15) / (c{j} + 1e-9))" for j in range(1, k + 1)), k, _BP, k
    )
    for k in range(1, 5)
)


@query("bleu_corpus", f"WITH {COUNTS_SQL}, s AS (SELECT {_SUMS} FROM cnt) SELECT {_BLEU} FROM s")
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.corpus_bleu(M.ngram_counts(token_pairs(spark, sf_dir), "pair_id"))


@query("bleu_pair", f"WITH {COUNTS_SQL}, s AS (SELECT pair_id, {_SUMS} FROM cnt GROUP BY 1) SELECT pair_id, {_BLEU} FROM s")
def bleu_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pair_bleu(M.ngram_counts(token_pairs(spark, sf_dir), "pair_id"), "pair_id")


CIDER_SQL = f"""{COUNTS_SQL},
tot AS (SELECT count(DISTINCT pair_id) AS total FROM cnt),
df AS (SELECT n, gram, count(*) AS df FROM cnt WHERE r > 0 GROUP BY 1, 2),
w AS (SELECT cnt.*, ln(CAST(total AS DOUBLE)) - ln(CAST(greatest(coalesce(df, 1), 1) AS DOUBLE)) AS idf
      FROM cnt LEFT JOIN df USING (n, gram), tot),
pn AS (SELECT pair_id, n, sum(least(h * idf, r * idf) * r * idf) AS dot, sqrt(sum(h * idf * h * idf)) AS nh,
       sqrt(sum(r * idf * r * idf)) AS nr, sum(h) AS lh, sum(r) AS lr FROM w GROUP BY 1, 2),
sc AS (SELECT pair_id, sum(CASE WHEN nh > 0 AND nr > 0 THEN dot / (nh * nr) ELSE 0 END) AS s,
       coalesce(sum(lh - lr) FILTER (n = 2), 0) AS d FROM pn GROUP BY 1),
cider AS (SELECT pair_id, round(s / 4 * exp(-(d * d) / (2 * 6.0::DOUBLE * 6.0::DOUBLE)) * 10, 6) AS cider FROM sc)"""


@query("cider", f"WITH {CIDER_SQL} SELECT * FROM cider")
def cider(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = cut_lineage(token_pairs(spark, sf_dir))  # read for counts, frequencies and total
    return M.cider(M.ngram_counts(tokens, "pair_id"), "pair_id", M.pair_total(tokens))


def _lcs_sql(src: str) -> str:
    """One table row per reference token: the dynamic programming row over the hypothesis."""
    return f"""
lcs AS (
  SELECT pair_id, 0 AS i, list_transform(range(0, len(hyp) + 1), lambda x: 0::BIGINT) AS row, ref, hyp FROM {src}
  UNION ALL
  SELECT pair_id, i + 1, list_reduce(range(1, len(hyp) + 1), lambda acc, j: list_append(acc,
      CASE WHEN hyp[j] = ref[i + 1] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0::BIGINT]), ref, hyp
  FROM lcs WHERE i < len(ref)),
fin AS (SELECT pair_id, CAST(row[-1] AS DOUBLE) AS l, len(ref) AS m, len(hyp) AS n FROM lcs WHERE i = len(ref))"""


@query(
    "rouge_l",
    f"""WITH RECURSIVE {TOKENS_SQL}, {_lcs_sql('tok')}
SELECT pair_id, CASE WHEN m > 0 AND n > 0 AND l > 0 THEN
  round((1 + 1.2::DOUBLE * 1.2::DOUBLE) * (l / n) * (l / m) / (l / m + 1.2::DOUBLE * 1.2::DOUBLE * (l / n)), 6) ELSE 0.0::DOUBLE END AS rouge_l FROM fin""",
)
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rouge_l(token_pairs(spark, sf_dir), "pair_id")


@query(
    "rouge_l_f1",
    f"""WITH RECURSIVE {PAIRS_SQL},
tok AS (SELECT pair_id, list_filter(regexp_split_to_array(lower(ref), '\\s+'), lambda x: x <> '') AS ref,
        list_filter(regexp_split_to_array(lower(hyp), '\\s+'), lambda x: x <> '') AS hyp FROM pairs), {_lcs_sql('tok')}
SELECT round(avg(CASE WHEN m > 0 AND n > 0 AND l > 0 THEN round(2 * (l / n) * (l / m) / (l / m + l / n), 6) ELSE 0.0::DOUBLE END), 6) AS rouge_l FROM fin""",
)
def rouge_l_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pairs(spark, sf_dir).select(
        "pair_id", T.tokens(F.lower("ref")).alias("ref"), T.tokens(F.lower("hyp")).alias("hyp")
    )
    return M.corpus_mean(M.rouge_l(words, "pair_id", beta=1.0), "rouge_l")


@query(
    "graph_f1",
    f"""WITH {TOKENS_SQL}, d AS (SELECT pair_id, list_distinct(ref) AS a, list_distinct(hyp) AS b FROM tok)
    SELECT pair_id, round(2 * len(list_intersect(a, b)) / CAST(len(a) + len(b) AS DOUBLE), 6) AS graph_f1 FROM d""",
)
def graph_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.graph_f1(token_pairs(spark, sf_dir), "pair_id", "ref", "hyp")


def word_graph(rows: DataFrame, keys: list[str], words: str) -> tuple[DataFrame, DataFrame]:
    """A text's words as typed entities, each related to the word after it where both are long."""
    nodes = rows.select(*keys, F.posexplode(words).alias("eid", "tokens"))
    kind = F.when(F.length("tokens") > 4, "long").otherwise("short")
    entities = nodes.select(*keys, "eid", "tokens", kind.alias("entity_type"))
    both = F.transform(words, lambda w, i: (F.length(w) > 4) & (F.length(F.get(F.col(words), i + 1)) > 4))
    links = rows.select(*keys, F.posexplode(both).alias("eid", "linked")).filter("linked")
    return entities, links.select(*keys, "eid", F.lit("precedes").alias("rel_type"), (F.col("eid") + 1).alias("target"))


def typed_sql(src: str, keys: str, level: str = "partial") -> str:
    """CTE gf(keys, g): the same comparison of the word graphs of ``src`` (keys, ref, hyp)."""
    triples = "" if level != "complete" else (
        f" UNION SELECT {keys}, s, n || chr(2) || 'precedes' || chr(2) || nx FROM gn WHERE has"
    )
    return f"""gw AS (SELECT {keys}, 'r' AS s, generate_subscripts(ref, 1) AS i, lower(unnest(ref)) AS w FROM {src}
  UNION ALL SELECT {keys}, 'h', generate_subscripts(hyp, 1), lower(unnest(hyp)) FROM {src}),
gt AS (SELECT {keys}, s, i, w || chr(1) || CASE WHEN length(w) > 4 THEN 'long' ELSE 'short' END AS n, length(w) > 4 AS l FROM gw),
gn AS (SELECT *, lead(n) OVER v AS nx, coalesce(l AND lead(l) OVER v, false) AS has FROM gt WINDOW v AS (PARTITION BY {keys}, s ORDER BY i)),
gk AS (SELECT {keys}, s, n || chr(1) || CASE WHEN has THEN '+' ELSE '-' END AS k FROM gn{triples}),
gd AS (SELECT {keys}, k, count(DISTINCT s) AS sides FROM gk GROUP BY ALL),
gf AS (SELECT {keys}, round(2 * count(*) FILTER (sides = 2) / CAST(sum(sides) AS DOUBLE), 6) AS g FROM gd GROUP BY {keys})"""


def _graph_pairs(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    rows = cut_lineage(token_pairs(spark, sf_dir))
    ref, hyp = (word_graph(rows, ["pair_id"], c) for c in ("ref", "hyp"))
    return M.typed_graph_f1(ref, hyp, "pair_id", level)


@query("graph_f1_partial", f"WITH {TOKENS_SQL}, {typed_sql('tok', 'pair_id')} SELECT pair_id, g AS graph_f1 FROM gf")
def graph_f1_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities match by tokens, type and whether they have a relation."""
    return _graph_pairs(spark, sf_dir, "partial")


@query("graph_f1_complete", f"WITH {TOKENS_SQL}, {typed_sql('tok', 'pair_id', 'complete')} SELECT pair_id, g AS graph_f1 FROM gf")
def graph_f1_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations count as facts of their own."""
    return _graph_pairs(spark, sf_dir, "complete")
