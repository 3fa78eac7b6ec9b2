"""Disease queries. Earlier orders of a customer are the admissions of a study, lines the diagnoses.

Codes are made from the brand number: brands 1-5 give the three-character parents
401-405, the others a longer code below one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf.keywords import RELEVANCE_KEYWORDS, UNKNOWN_TITLES
from ..functions import ids
from ..operators import history as H
from ..operators import knowledge as K
from ..operators import patient as P
from ..operators import timeline as L
from ..session import cut_lineage
from . import query
from .tables import LINE_TIE, ordered_lines, table

CATEGORIES = (("401-409", "first"), ("402", "second"), ("4037", "third"), ("403", "fourth"), ("404", "fifth"))
RELATIONS = (
    ("4026", "4037", "causes", 0.9),
    ("4037", "4048", "progresses_to", 0.7),
    ("401", "402", "associated_with", 0.5),
    ("40110", "40413", "complication_of", 0.6),
    ("4059", "40312", "causes", 0.8),
)
CODE_FINDINGS = {
    "401": ("URGENT", "HIGH"),
    "402": ("MEDIUM",),
    "403": (),
    "4026": ("HIGH", "LOW", "MEDIUM"),
    "4037": ("LOW", "SPECIFIED"),
    "40110": ("URGENT",),
}
PREFIX_FINDINGS = {"402": ("LOW", "Extra"), "403": ("Wide",), "404": ("MEDIUM", "Narrow")}
FINDING_WORDS = (("urgent", "URGENT"), ("high", "HIGH"), ("medium", "MEDIUM"), ("low", "LOW"), ("specified", "SPECIFIED"))
MIN_SUPPORT, MIN_CONFIDENCE = 5, 0.185
MAX_ENTITIES = 12

_N = "CAST(replace(p_brand, 'Brand#', '') AS INTEGER)"
CODE_SQL = f"CASE WHEN {_N} <= 5 THEN '40' || {_N} ELSE '40' || ({_N} % 5 + 1) || {_N} END"


def code_column() -> Column:
    n = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    text = n.cast("string")
    return F.when(n <= 5, F.concat(F.lit("40"), text)).otherwise(
        F.concat(F.lit("40"), (n % 5 + 1).cast("string"), text)
    )


def order_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the code and the description of its part."""
    return ordered_lines(spark, sf_dir).withColumn("icd_code", code_column())


LINES_SQL = f"""ln AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, p_name, {CODE_SQL} AS icd
FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def admissions_and_studies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as admissions with their diagnoses, and as studies."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    diags = H.admission_diagnoses(
        order_diagnoses(spark, sf_dir),
        admission="l_orderkey",
        seq="l_linenumber",
        tie=[F.col(c) for c in LINE_TIE],
        payload=[F.col("l_linenumber").alias("seq_num"), F.col("icd_code"), F.col("p_name").alias("description")],
    )
    drg = F.when(F.col("o_orderkey") % 5 != 0, F.struct((F.col("o_orderkey") % 5).cast("double").alias("drg_severity")))
    adm = orders.select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("admittime"),
        F.col("o_orderdate").alias("dischtime"),
        drg.alias("drg"),
    )
    adm = adm.join(diags, adm["hadm_id"] == diags["l_orderkey"], "left").drop("l_orderkey")
    studies = orders.select(
        F.col("o_orderkey").alias("study_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("study_dt")
    )
    return adm, studies


Tables = tuple[DataFrame, DataFrame]


def study_histories(spark: SparkSession, sf_dir: str, told_only: bool = False, given: Tables | None = None) -> DataFrame:
    """(study_id, study_dt, history): orders with the nested admissions before them.

    With ``told_only`` the admissions are as short as the steps of a timeline can be made from: of a description only its
    first character, which tells whether there is one. ``given`` are admissions and studies that are there already.
    """
    adm, studies = given or admissions_and_studies(spark, sf_dir)
    payload = ["hadm_id", "admittime", "dischtime", "diagnoses", "drg"]
    if told_only:
        short = lambda d: F.struct(d["icd_code"].alias("icd_code"), F.substring(d["description"], 1, 1).alias("description"))
        adm, payload = adm.withColumn("diagnoses", F.transform("diagnoses", short)), ["admittime", "diagnoses"]
    return H.attach_history(
        studies,
        adm,
        subject="subject_id",
        study_id="study_id",
        study_time="study_dt",
        discharge_time="dischtime",
        tie="hadm_id",
        payload=payload,
    )


_KEYS = dict(subject="subject_id", key="study_id")


def written_admissions(spark: SparkSession, sf_dir: str) -> Tables:
    """Admissions, written once, and studies."""
    adm, studies = admissions_and_studies(spark, sf_dir)
    return cut_lineage(adm, "admissions"), studies


def timelines(spark: SparkSession, sf_dir: str, given: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """(timeline, marks): all diagnoses of a customer once, and how far each order sees. Both are written once."""
    adm, studies = given or written_admissions(spark, sf_dir)
    line, sizes = L.diagnosis_timeline(
        adm, subject="subject_id", admission="hadm_id", discharge_time="dischtime", admit_time="admittime", severity=F.col("drg.drg_severity")
    )
    marks = L.study_marks(studies, sizes, study_time="study_dt", discharge_time="dischtime", **_KEYS)
    return cut_lineage(line, "timeline"), cut_lineage(marks, "marks")


def diagnosis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long history table, written once: several operators read it."""
    return cut_lineage(
        P.history_diagnoses(study_histories(spark, sf_dir), key="study_id", history="history", study_time="study_dt")
    )


def diagnosis_arrays(spark: SparkSession, sf_dir: str, given: Tables | None = None) -> DataFrame:
    """The histories as arrays of what a step of the timeline asks for; nothing of them is written."""
    histories = study_histories(spark, sf_dir, told_only=True, given=given)
    return P.history_diagnoses(histories, key="study_id", history="history", study_time="study_dt", severity=None, packed=P.STEP_FIELDS)


DIAG_SQL = f"""{LINES_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM ln),
diag AS MATERIALIZED (SELECT s.o_orderkey AS study_id, icd, p_name AS description,
  CASE WHEN a.o_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE a.o_orderkey % 5 END AS severity,
  CAST(greatest((year(s.o_orderdate) - year(a.o_orderdate)) * 12 + month(s.o_orderdate) - month(a.o_orderdate), 0) AS DOUBLE) AS months_ago,
  row_number() OVER (PARTITION BY s.o_orderkey ORDER BY a.o_orderdate, a.o_orderkey, rn) - 1 AS ord
  FROM orders s JOIN orders a ON a.o_custkey = s.o_custkey AND a.o_orderdate < s.o_orderdate
  JOIN rk ON l_orderkey = a.o_orderkey AND rn <= 15)"""


@query(
    "history_parse",
    f"WITH {DIAG_SQL} SELECT study_id, count(*) AS n, CAST(sum(months_ago * (ord + 1)) AS DOUBLE) AS months_check, CAST(sum(severity * (ord + 1)) AS DOUBLE) AS severity_check, string_agg(icd, ',' ORDER BY ord) AS codes FROM diag GROUP BY 1",
)
def history_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("ord") + 1
    return diagnosis_rows(spark, sf_dir).groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("months_ago") * place).alias("months_check"),
        F.sum(F.col("severity") * place).alias("severity_check"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("ord", "icd"))), lambda x: x["icd"])).alias("codes"),
    )


_CAT_SQL = "CASE {} ELSE 'Unknown' END".format(
    " ".join(f"WHEN starts_with(icd, '{c.replace('-', '')[:3]}') THEN '{n}'" for c, n in CATEGORIES)
)
_ENTITY_SQL = f"""ent AS MATERIALIZED (SELECT icd, arg_min(p_name, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) AS name,
  'disease' AS type, {_CAT_SQL} AS category, count(*) AS frequency
  FROM (SELECT * REPLACE (CASE WHEN icd = '40413' THEN '40413-old' ELSE icd END AS icd) FROM ln) GROUP BY icd)"""


def kb_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one code goes by another name, so that the knowledge base does not know it
    code = F.col("icd_code")
    lines = order_diagnoses(spark, sf_dir).withColumn("icd_code", F.when(code == "40413", "40413-old").otherwise(code))
    order = ["l_orderkey", "l_linenumber", *LINE_TIE]
    return K.disease_entities(lines, code="icd_code", name="p_name", order=order, categories=CATEGORIES)


@query("disease_freq", f"WITH {LINES_SQL}, {_ENTITY_SQL} SELECT * FROM ent")
def disease_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb_entities(spark, sf_dir)


@query("top_diseases", f"WITH {LINES_SQL}, {_ENTITY_SQL} SELECT icd, name, frequency FROM ent ORDER BY frequency DESC, icd LIMIT 10")
def top_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_diseases(kb_entities(spark, sf_dir)).select("icd", "name", "frequency")


_PAIR_SQL = f"""once AS (SELECT DISTINCT l_orderkey, icd FROM ln),
cn AS (SELECT icd, count(*) AS n FROM once GROUP BY 1),
pr AS (SELECT x.icd AS a, y.icd AS b, count(*) AS support FROM once x JOIN once y ON x.l_orderkey = y.l_orderkey AND x.icd < y.icd GROUP BY 1, 2),
co AS (SELECT a, b, support, support / CAST(least(p.n, q.n) AS DOUBLE) AS confidence FROM pr JOIN cn p ON p.icd = a JOIN cn q ON q.icd = b
  WHERE support >= {MIN_SUPPORT} AND support / CAST(least(p.n, q.n) AS DOUBLE) >= {MIN_CONFIDENCE}::DOUBLE)"""


def mined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cooccurrence(
        order_diagnoses(spark, sf_dir).select("l_orderkey", "icd_code"),
        basket="l_orderkey",
        code="icd_code",
        min_support=MIN_SUPPORT,
        min_confidence=MIN_CONFIDENCE,
    )


@query("cooccurrence", f"WITH {LINES_SQL}, {_PAIR_SQL} SELECT a, b, support, round(confidence, 6) AS confidence FROM co")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined_pairs(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


_REL_ROWS = ", ".join(f"('{s}', '{t}', '{r}', {w}::DOUBLE, {i})" for i, (s, t, r, w) in enumerate(RELATIONS))
KB_SQL = f"""{_ENTITY_SQL}, {_PAIR_SQL},
rel AS MATERIALIZED (SELECT * FROM (VALUES {_REL_ROWS}) AS f(src, tgt, rel_type, weight, ord)
  UNION ALL SELECT a, b, 'co-occurs_with', confidence, {len(RELATIONS)} FROM co
  UNION ALL SELECT b, a, 'co-occurs_with', confidence, {len(RELATIONS)} FROM co)"""


def knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    relations = K.fixed_relations(spark, RELATIONS).unionByName(
        K.cooccurrence_relations(mined_pairs(spark, sf_dir), len(RELATIONS))
    )
    return cut_lineage(kb_entities(spark, sf_dir)), cut_lineage(relations)


@query(
    "knowledge_statistics",
    f"""WITH {LINES_SQL}, {KB_SQL} SELECT 'entities' AS kind, 'all' AS name, count(*) AS n FROM ent
UNION ALL SELECT 'relations', 'all', count(*) FROM rel UNION ALL SELECT 'relation_type', rel_type, count(*) FROM rel GROUP BY 2""",
)
def knowledge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.knowledge_statistics(*knowledge(spark, sf_dir))


@query(
    "disease_relations",
    f"""WITH {LINES_SQL}, {KB_SQL} SELECT src, tgt, rel_type, round(weight, 6) AS weight FROM rel
WHERE src IN (SELECT DISTINCT icd FROM ln WHERE l_linenumber = 7) AND rel_type IN ('causes', 'co-occurs_with')""",
)
def disease_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = order_diagnoses(spark, sf_dir).filter(F.col("l_linenumber") == 7).select("icd_code")
    kept = K.relations_of(knowledge(spark, sf_dir)[1], codes, "icd_code", ["causes", "co-occurs_with"])
    return kept.select("src", "tgt", "rel_type", F.round("weight", 6).alias("weight"))


_PRIMARY_SQL = "prim AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY severity DESC, months_ago, ord) AS pr FROM diag) WHERE pr = 1)"


@query("primary_disease", f"WITH {DIAG_SQL}, {_PRIMARY_SQL} SELECT study_id, ord, icd, description, severity, months_ago FROM prim")
def primary_disease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.primary_state(*timelines(spark, sf_dir), **_KEYS)


_CHRONIC_SQL = "chron AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY study_id, icd) AS occurrences FROM diag) WHERE occurrences >= 2)"


@query("chronic_diseases", f"WITH {DIAG_SQL}, {_CHRONIC_SQL} SELECT study_id, ord, icd, occurrences FROM chron")
def chronic_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.chronic_diseases(diagnosis_rows(spark, sf_dir), "study_id")
    return out.select("study_id", F.col("ord").cast("bigint").alias("ord"), "icd", "occurrences")


_STEP_SQL = """steps AS MATERIALIZED (SELECT * FROM (SELECT study_id, ord AS src_ord, icd AS src, lead(icd) OVER w AS tgt, abs(months_ago - lead(months_ago) OVER w) AS gap_months
  FROM diag WINDOW w AS (PARTITION BY study_id ORDER BY months_ago DESC, ord)) WHERE tgt IS NOT NULL)"""


@query("timeline_edges", f"WITH {DIAG_SQL}, {_STEP_SQL} SELECT * FROM steps")
def timeline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.timeline_steps(diagnosis_arrays(spark, sf_dir), "study_id")
    return out.withColumn("src_ord", F.col("src_ord").cast("bigint"))


@query(
    "months_ago",
    """SELECT l_orderkey, l_linenumber, l_partkey, m AS months,
  CASE WHEN l_linenumber >= 4 THEN 'severe' WHEN l_linenumber >= 3 THEN 'moderate-severe' WHEN l_linenumber >= 2 THEN 'moderate' ELSE 'mild' END AS severity_text,
  CASE WHEN m < 1 THEN 'recent' WHEN m < 6 THEN m || 'mo ago' WHEN m < 12 THEN 'this year' WHEN m < 24 THEN '1-2y ago' ELSE '>2y ago' END AS recency_text
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(greatest((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate), 0) AS INTEGER) AS m
FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
)
def months_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    months = ids.months_between_calendar(F.col("o_orderdate"), F.col("l_shipdate"))
    rows = lines.join(orders, "l_orderkey").withColumn("months", months)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "months",
        ids.severity_text(F.col("l_linenumber")).alias("severity_text"),
        ids.recency_text(F.col("months")).alias("recency_text"),
    )


_EXPECTED_ROWS = ", ".join(f"('{c}', {i}, '{f}')" for c, fs in CODE_FINDINGS.items() for i, f in enumerate(fs))
_WORD_ROWS = ", ".join(f"('{w}', '{f}')" for w, f in FINDING_WORDS)
_EVIDENCE_SQL = f"""exf(icd, i, finding) AS (VALUES {_EXPECTED_ROWS}), words(word, finding) AS (VALUES {_WORD_ROWS}),
pst AS (SELECT a.o_orderkey AS study_id, b.o_orderpriority AS report, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) AS back
  FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate),
fnd AS (SELECT DISTINCT study_id, finding FROM pst JOIN words ON contains(lower(report), word) WHERE back <= 2 AND length(report) >= 5),
evi AS MATERIALIZED (SELECT d.study_id, d.icd, list(e.finding ORDER BY e.i) AS evidence FROM (SELECT DISTINCT study_id, icd FROM diag) d
  JOIN exf e ON e.icd = d.icd JOIN fnd f ON f.study_id = d.study_id AND f.finding = e.finding GROUP BY 1, 2)"""


def past_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study_id, finding) of the last reports before each study."""
    from ..operators.findings import history_findings

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    past = H.past_reports(
        orders, subject="o_custkey", study_time="o_orderdate", study_id="o_orderkey", text="o_orderpriority", min_chars=5
    )
    return history_findings(past.select(F.col("o_orderkey").alias("study_id"), "past_reports"), "study_id", "past_reports", FINDING_WORDS)


def evidence(spark: SparkSession, sf_dir: str, codes: DataFrame) -> DataFrame:
    return cut_lineage(P.imaging_evidence(codes, past_findings(spark, sf_dir), "study_id", CODE_FINDINGS))


@query("imaging_evidence", f"WITH {DIAG_SQL}, {_EVIDENCE_SQL} SELECT study_id, icd, array_to_string(evidence, ',') AS evidence FROM evi")
def imaging_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence(spark, sf_dir, L.code_marks(*timelines(spark, sf_dir), **_KEYS))
    return out.select("study_id", "icd", F.concat_ws(",", "evidence").alias("evidence"))


WEIGHT_SQL = """wraw AS (SELECT d.study_id, d.icd, max(d.severity * exp(-0.1::DOUBLE * d.months_ago) * CASE WHEN p.ord IS NULL THEN 1 ELSE 2 END) *
    (1.0 + 0.5 * coalesce(any_value(len(e.evidence)), 0)) AS raw, coalesce(any_value(len(e.evidence)), 0) AS n_evidence
  FROM diag d LEFT JOIN prim p ON p.study_id = d.study_id AND p.ord = d.ord LEFT JOIN evi e ON e.study_id = d.study_id AND e.icd = d.icd GROUP BY 1, 2),
dw AS MATERIALIZED (SELECT study_id, icd, raw / max(raw) OVER (PARTITION BY study_id) AS weight, n_evidence FROM wraw)"""
PATIENT_SQL = f"{DIAG_SQL}, {_PRIMARY_SQL}, {_EVIDENCE_SQL}, {WEIGHT_SQL}"


@query(
    "disease_weights",
    f"WITH {PATIENT_SQL} SELECT study_id, icd, round(weight, 6) AS weight, CAST(n_evidence AS INTEGER) AS n_evidence FROM dw",
)
def disease_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = timelines(spark, sf_dir)
    strongest = cut_lineage(L.strongest_state(*states, **_KEYS), "strongest")
    out = P.scaled_weights(strongest, L.primary_state(*states, **_KEYS), evidence(spark, sf_dir, strongest), "study_id")
    return out.withColumn("weight", F.round("weight", 6))


def _hop_sql(i: int) -> str:
    m = MAX_ENTITIES
    return f"""
room{i} AS (SELECT study_id, {m} - count(*) AS room FROM mem{i - 1} GROUP BY 1 HAVING count(*) < {m}),
st{i} AS MATERIALIZED (
  SELECT f.study_id, room, src, tgt, rel_type, weight, 0 AS l, ord AS o FROM front{i - 1} f JOIN room{i} USING (study_id) JOIN rel ON src = f.icd
  UNION ALL SELECT f.study_id, room, f.icd, substr(f.icd, 1, 3), 'is_a', 1.0, 1, 0 FROM front{i - 1} f JOIN room{i} USING (study_id)
  WHERE length(f.icd) > 3 AND substr(f.icd, 1, 3) IN (SELECT icd FROM ent)),
new{i} AS (SELECT study_id, tgt, room, src, row_number() OVER (PARTITION BY study_id, tgt ORDER BY src, l, o) AS k, l, o FROM st{i} s
  WHERE NOT EXISTS (SELECT 1 FROM mem{i - 1} x WHERE x.study_id = s.study_id AND x.icd = s.tgt)),
pl{i} AS MATERIALIZED (SELECT study_id, tgt, room, src, row_number() OVER (PARTITION BY study_id ORDER BY src, l, o, tgt) AS place FROM new{i} WHERE k = 1),
front{i} AS (SELECT study_id, tgt AS icd FROM pl{i} WHERE place <= room),
mem{i} AS MATERIALIZED (SELECT * FROM mem{i - 1} UNION ALL SELECT * FROM front{i}),
edge{i} AS (SELECT s.study_id, s.src, s.tgt, s.rel_type, s.weight FROM st{i} s LEFT JOIN pl{i} z ON z.study_id = s.study_id AND z.place = z.room
  WHERE EXISTS (SELECT 1 FROM mem{i} x WHERE x.study_id = s.study_id AND x.icd = s.tgt) AND (z.src IS NULL OR s.src <= z.src))"""


SUBGRAPH_SQL = f"""{KB_SQL},
mem0 AS MATERIALIZED (SELECT study_id, icd FROM (SELECT study_id, icd, row_number() OVER (PARTITION BY study_id ORDER BY icd) AS r
  FROM (SELECT DISTINCT study_id, icd FROM diag)) WHERE r <= {MAX_ENTITIES}),
front0 AS (SELECT * FROM mem0), {_hop_sql(1)}, {_hop_sql(2)},
sub_n AS MATERIALIZED (SELECT study_id, icd FROM mem2 WHERE icd IN (SELECT icd FROM ent)),
sub_e AS MATERIALIZED (SELECT * FROM (SELECT * FROM edge1 UNION ALL SELECT * FROM edge2) WHERE src IN (SELECT icd FROM ent) AND tgt IN (SELECT icd FROM ent))"""


@query(
    "khop_entities", f"WITH {DIAG_SQL}, {SUBGRAPH_SQL} SELECT study_id, icd FROM sub_n"
)
def khop_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ent, rel = knowledge(spark, sf_dir)
    d = L.code_marks(*timelines(spark, sf_dir), **_KEYS)
    return K.subgraph(d, ent, rel, key="study_id", code="icd", max_entities=MAX_ENTITIES)[0].select("study_id", "icd")


@query(
    "khop_relations",
    f"WITH {DIAG_SQL}, {SUBGRAPH_SQL} SELECT study_id, src, tgt, rel_type, round(weight, 6) AS weight FROM sub_e",
)
def khop_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ent, rel = knowledge(spark, sf_dir)
    d = L.code_marks(*timelines(spark, sf_dir), **_KEYS)
    edges = K.subgraph(d, ent, rel, key="study_id", code="icd", max_entities=MAX_ENTITIES)[1]
    return edges.select("study_id", "src", "tgt", "rel_type", F.round("weight", 6).alias("weight"))


GRAPH_SQL = f"""{PATIENT_SQL}, {_STEP_SQL}, {SUBGRAPH_SQL},
pn AS MATERIALIZED (SELECT n.study_id, n.icd, type, coalesce(weight, 0.3) AS weight, name, category, coalesce(n_evidence, 0) > 0 AS has_imaging_evidence
  FROM sub_n n JOIN ent USING (icd) LEFT JOIN dw ON dw.study_id = n.study_id AND dw.icd = n.icd),
pe AS MATERIALIZED (SELECT e.study_id, e.src, e.tgt, e.rel_type, e.weight * (a.weight + b.weight) / 2 AS weight FROM sub_e e
  JOIN pn a ON a.study_id = e.study_id AND a.icd = e.src JOIN pn b ON b.study_id = e.study_id AND b.icd = e.tgt
  UNION ALL SELECT s.study_id, s.src, s.tgt, 'evolved_to', 0.9::DOUBLE FROM steps s
  JOIN pn a ON a.study_id = s.study_id AND a.icd = s.src JOIN pn b ON b.study_id = s.study_id AND b.icd = s.tgt WHERE s.src <> s.tgt)"""


@dataclass(frozen=True)
class PatientGraphs:
    """Graphs of all studies, with the codes of their histories.

    Steps of the timeline are rows of the result where a query asks for them; only there a history is long.
    """

    codes: DataFrame
    nodes: DataFrame
    edges: DataFrame
    steps: DataFrame


def patient_graphs(spark: SparkSession, sf_dir: str, with_steps: bool = False) -> PatientGraphs:
    ent, rel = knowledge(spark, sf_dir)
    given = written_admissions(spark, sf_dir)
    states = timelines(spark, sf_dir, given)
    codes = cut_lineage(L.strongest_state(*states, **_KEYS), "strongest")
    primary = L.primary_state(*states, **_KEYS)
    ev = evidence(spark, sf_dir, codes)
    weights = P.scaled_weights(codes, primary, ev, "study_id")
    if with_steps:
        steps = P.timeline_steps(diagnosis_arrays(spark, sf_dir, given), "study_id")
    else:
        steps = spark.createDataFrame([], "study_id long, src_ord int, src string, tgt string, gap_months double")
    nodes, edges = P.weighted_graph(codes, weights, steps, ent, rel, key="study_id", max_entities=MAX_ENTITIES)
    return PatientGraphs(codes, nodes, edges, steps)


@query(
    "patient_entities",
    f"WITH {GRAPH_SQL} SELECT study_id, icd, type, round(weight, 6) AS weight, name, category, has_imaging_evidence FROM pn",
)
def patient_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patient_graphs(spark, sf_dir).nodes.withColumn("weight", F.round("weight", 6))


@query(
    "patient_relations",
    f"WITH {GRAPH_SQL} SELECT study_id, src, tgt, rel_type, count(*) AS n, round(sum(weight), 6) AS weight FROM pe GROUP BY 1, 2, 3, 4",
)
def patient_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = patient_graphs(spark, sf_dir, with_steps=True).edges
    return edges.groupBy("study_id", "src", "tgt", "rel_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight")
    )


@query(
    "patient_graph_stats",
    f"""WITH {GRAPH_SQL}, e AS (SELECT study_id, count(*) AS num_relations FROM pe GROUP BY 1)
SELECT study_id, count(*) AS num_entities, round(avg(weight), 6) AS mean_weight, round(max(weight), 6) AS max_weight,
  coalesce(any_value(num_relations), 0) AS num_relations FROM pn LEFT JOIN e USING (study_id) GROUP BY 1""",
)
def patient_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = patient_graphs(spark, sf_dir, with_steps=True)
    return P.graph_statistics(graphs.nodes, graphs.edges, "study_id")


@query(
    "progression_edges",
    f"""WITH {GRAPH_SQL} SELECT s.study_id, s.src, s.tgt, count(*) AS n, round(sum(exp(-0.05::DOUBLE * gap_months)), 6) AS weight FROM steps s
  JOIN pn a ON a.study_id = s.study_id AND a.icd = s.src JOIN pn b ON b.study_id = s.study_id AND b.icd = s.tgt
  WHERE (s.src, s.tgt) IN (SELECT (src, tgt) FROM rel WHERE rel_type IN ('causes', 'progresses_to')) GROUP BY 1, 2, 3""",
)
def progression_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = patient_graphs(spark, sf_dir, with_steps=True)
    edges = P.progression_edges(graphs.steps, graphs.nodes, K.fixed_relations(spark, RELATIONS), "study_id")
    return edges.groupBy("study_id", "src", "tgt").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight")
    )


@query(
    "pair_edges",
    f"""WITH {GRAPH_SQL}, f AS MATERIALIZED (SELECT study_id, list(icd ORDER BY o) AS codes FROM (SELECT d.study_id, d.icd, min(d.ord) AS o FROM diag d
  JOIN pn ON pn.study_id = d.study_id AND pn.icd = d.icd GROUP BY 1, 2) GROUP BY 1)
SELECT study_id, CAST(len(codes) * (len(codes) - 1) // 2 AS BIGINT) AS n, round(len(codes) * (len(codes) - 1) // 2 * 0.8::DOUBLE, 6) AS weight,
  array_to_string(flatten(list_transform(range(1, len(codes)), lambda i: list_transform(codes[i + 1:], lambda b: codes[i] || '>' || b))), ',') AS pairs FROM f WHERE len(codes) > 1""",
)
def pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 'co-occurring' edges of every study, packed into one row in their order."""
    graphs = patient_graphs(spark, sf_dir)
    edges = P.pair_edges(graphs.codes, graphs.nodes, "study_id", places=True)
    pair = F.struct(F.col("src_ord").alias("a"), F.col("tgt_ord").alias("b"), F.concat("src", F.lit(">"), "tgt").alias("p"))
    packed = F.array_sort(F.collect_list(pair))
    return edges.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("weight"), 6).alias("weight"),
        F.concat_ws(",", F.transform(packed, lambda x: x["p"])).alias("pairs"),
    )


_LISTED_SQL = "CASE {} ELSE CASE {} END END".format(
    " ".join(f"WHEN icd = '{c}' THEN {list(f)!r}::VARCHAR[]" for c, f in CODE_FINDINGS.items()),
    " ".join(f"WHEN substr(icd, 1, 3) = '{c}' THEN {list(f)!r}::VARCHAR[]" for c, f in PREFIX_FINDINGS.items()),
)
TEXT_SQL = f"""{GRAPH_SQL}, {_CHRONIC_SQL},
c3 AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY ord) AS r FROM chron),
seq AS (SELECT study_id, 0 AS r, icd, description FROM prim UNION ALL SELECT study_id, r, icd, description FROM c3 WHERE r <= 3),
ff AS (SELECT *, {_LISTED_SQL} AS f FROM seq),
g AS MATERIALIZED (SELECT * FROM ff WHERE len(coalesce(f, [])) > 0),
tf AS (SELECT study_id, list_sort(list_distinct(flatten(list(f)))) AS t, arg_min(description, r) AS lead FROM g GROUP BY 1),
lf AS (SELECT g.study_id, arg_max(f, r) AS f FROM g JOIN tf ON tf.study_id = g.study_id AND tf.lead = g.description GROUP BY 1),
cn2 AS (SELECT study_id, string_agg(description, ', ' ORDER BY r) AS names FROM c3 WHERE r <= 2 GROUP BY 1),
ev4 AS (SELECT study_id, list_sort(list_distinct(flatten(list(evidence)))) AS e FROM evi GROUP BY 1),
ctext AS (SELECT p.study_id, 'CLINICAL CONTEXT:' || chr(10) || '- Primary: ' || p.description || ' (' ||
  CASE WHEN severity >= 4 THEN 'severe' WHEN severity >= 3 THEN 'moderate-severe' WHEN severity >= 2 THEN 'moderate' ELSE 'mild' END || ', ' ||
  CASE WHEN months_ago < 1 THEN 'recent' WHEN months_ago < 6 THEN CAST(months_ago AS INTEGER) || 'mo ago' WHEN months_ago < 12 THEN 'this year' WHEN months_ago < 24 THEN '1-2y ago' ELSE '>2y ago' END || ')' ||
  CASE WHEN names IS NULL THEN '' ELSE chr(10) || '- Chronic: ' || names END ||
  CASE WHEN e IS NULL THEN '' ELSE chr(10) || '- Prior imaging: ' || array_to_string(e[1:4], ', ') END || chr(10) || chr(10) ||
  CASE WHEN t IS NULL THEN '' ELSE 'ASSESSMENT FOCUS:' || chr(10) || 'Key findings to assess: ' || array_to_string(t[1:5], ', ') || chr(10) ||
    'For ' || lead || ': examine ' || array_to_string(lf.f[1:3], ', ') || chr(10) || chr(10) END ||
  'EXPECTED:' || chr(10) || CASE WHEN severity >= 3 THEN 'Moderate to severe findings likely present' WHEN severity >= 2 THEN 'Mild to moderate changes may be seen' ELSE 'Subtle changes may be present' END ||
  CASE WHEN e IS NULL THEN '' ELSE chr(10) || 'Compare with prior imaging to assess progression' END AS clinical_text
  FROM prim p LEFT JOIN cn2 USING (study_id) LEFT JOIN ev4 USING (study_id) LEFT JOIN tf USING (study_id) LEFT JOIN lf USING (study_id)
  WHERE p.study_id IN (SELECT study_id FROM pn))"""


def clinical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.make_prompts import history_prompts

    return history_prompts(
        *timelines(spark, sf_dir), *knowledge(spark, sf_dir), **_KEYS, found=past_findings(spark, sf_dir),
        max_entities=MAX_ENTITIES, by_code=CODE_FINDINGS, by_prefix=PREFIX_FINDINGS,
    )


@query("clinical_text", f"WITH {TEXT_SQL} SELECT * FROM ctext")
def clinical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical_texts(spark, sf_dir)


@query(
    "expected_findings",
    f"""WITH {LINES_SQL}, c AS (SELECT DISTINCT icd FROM ln) SELECT icd, array_to_string(coalesce({_LISTED_SQL}, []), ',') AS findings FROM c""",
)
def expected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = order_diagnoses(spark, sf_dir).select(F.col("icd_code").alias("icd")).distinct()
    found = P.expected_findings(F.col("icd"), CODE_FINDINGS, PREFIX_FINDINGS)
    return codes.select("icd", F.concat_ws(",", found).alias("findings"))


_KB_PAIRS_SQL = """bo AS (SELECT DISTINCT study_id, icd FROM diag), bn AS (SELECT icd, count(*) AS n FROM bo GROUP BY 1),
bp AS (SELECT x.icd AS a, y.icd AS b, count(*) AS support FROM bo x JOIN bo y ON x.study_id = y.study_id AND x.icd < y.icd GROUP BY 1, 2),
bc AS (SELECT a, b, support / CAST(least(p.n, q.n) AS DOUBLE) AS confidence FROM bp JOIN bn p ON p.icd = a JOIN bn q ON q.icd = b WHERE support >= 10)"""


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..plans.build_kb import build_kb_from_timelines

    return build_kb_from_timelines(
        *timelines(spark, sf_dir), **_KEYS, min_support=10, min_confidence=0.5, categories=CATEGORIES, relations=RELATIONS
    )


@query(
    "kb_build_entities",
    f"""WITH {DIAG_SQL} SELECT icd, arg_min(description, (study_id, ord)) AS name, 'disease' AS type, {_CAT_SQL} AS category, count(*) AS frequency FROM diag GROUP BY icd""",
)
def kb_build_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge base job, every study's history being one basket."""
    return _built(spark, sf_dir)[0]


@query(
    "kb_build_relations",
    f"""WITH {DIAG_SQL}, {_KB_PAIRS_SQL}, r AS (SELECT * FROM (VALUES {_REL_ROWS}) AS f(src, tgt, rel_type, weight, ord)
  UNION ALL SELECT a, b, 'co-occurs_with', confidence, {len(RELATIONS)} FROM bc WHERE confidence >= 0.5
  UNION ALL SELECT b, a, 'co-occurs_with', confidence, {len(RELATIONS)} FROM bc WHERE confidence >= 0.5)
SELECT src, tgt, rel_type, round(weight, 6) AS weight, CAST(ord AS BIGINT) AS ord FROM r""",
)
def kb_build_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[1].withColumn("weight", F.round("weight", 6))


# descriptions of a clinical kind, some of which name a keyword and some of which are unknown titles
_DESCRIPTION_SQL = "CASE WHEN contains(p_name, 'rod') THEN 'Unknown ICD Code' ELSE replace(replace(replace(p_name, 'ring', 'Heart valve'), 'bolt', 'RIB fracture'), 'red', 'lung') END"
_RELEVANT_SQL = "(" + " OR ".join(f"contains(lower(d), '{w}')" for w in RELEVANCE_KEYWORDS) + ") AND d NOT IN ({})".format(", ".join(f"'{t}'" for t in UNKNOWN_TITLES))


@query(
    "history_context_job",
    f"""WITH {LINES_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM ln),
dx AS (SELECT s.o_orderkey AS study_id, {_DESCRIPTION_SQL} AS d, l_linenumber AS seq, row_number() OVER (PARTITION BY s.o_orderkey ORDER BY a.o_orderdate, a.o_orderkey, rn) AS ord
  FROM orders s JOIN orders a ON a.o_custkey = s.o_custkey AND a.o_orderdate < s.o_orderdate JOIN rk ON l_orderkey = a.o_orderkey AND rn <= 15),
f AS (SELECT study_id, d, arg_min(seq, ord) AS seq, min(ord) AS ord FROM dx WHERE {_RELEVANT_SQL} GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY seq, ord) AS rn FROM f),
dia AS (SELECT study_id, string_agg('- ' || d, chr(10) ORDER BY rn) AS t FROM o WHERE rn <= 30 GROUP BY 1),
p AS (SELECT a.o_orderkey AS study_id, b.o_orderpriority AS report, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) AS back
  FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate),
rep AS (SELECT study_id, string_agg('Past Report: ' || report, chr(10) || chr(10) ORDER BY back DESC) AS t FROM p WHERE back <= 2 AND length(report) >= 10 GROUP BY 1)
SELECT o_orderkey AS study_id, CASE WHEN rep.t IS NULL THEN '' ELSE '[HISTORICAL IMAGING REPORTS]' || chr(10) || rep.t END ||
    CASE WHEN rep.t IS NOT NULL AND dia.t IS NOT NULL THEN chr(10) || chr(10) ELSE '' END ||
    CASE WHEN dia.t IS NULL THEN '' ELSE '[PATIENT MEDICAL HISTORY]' || chr(10) || dia.t END AS history_text
FROM orders LEFT JOIN rep ON rep.study_id = o_orderkey LEFT JOIN dia ON dia.study_id = o_orderkey""",
)
def history_context_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the study table, with the list of relevant words and the unknown titles."""
    from ..plans.history_context import history_contexts

    adm, studies = admissions_and_studies(spark, sf_dir)
    name = lambda d: F.when(d.contains("rod"), "Unknown ICD Code").otherwise(
        F.replace(F.replace(F.replace(d, F.lit("ring"), F.lit("Heart valve")), F.lit("bolt"), F.lit("RIB fracture")), F.lit("red"), F.lit("lung"))
    )
    renamed = F.transform("diagnoses", lambda d: F.struct(d["seq_num"].alias("seq_num"), d["icd_code"].alias("icd_code"), name(d["description"]).alias("description")))
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study_id"), F.col("o_orderpriority").alias("report"))
    studies = studies.withColumnRenamed("study_dt", "study_datetime").join(reports, "study_id")
    return history_contexts(studies, adm.withColumn("diagnoses", renamed))
