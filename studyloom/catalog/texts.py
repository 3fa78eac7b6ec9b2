"""Report text queries. Documents are turned into raw reports by adding headers and noise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import patterns as P
from ..conf.keywords import DIAGNOSIS_RULES_PATCH, DIAGNOSIS_RULES_POOLED
from ..functions import text as T
from ..operators import findings as FD
from ..operators import reports as R
from . import query
from .tables import PAIRS_SQL, documents, pairs

_SHAPES = (
    ("", "{t}", ""),
    ("EXAM: CHEST\nFINDINGS: ", "{t}", "\nIMPRESSION: Stable appearance.  As previously noted, {t}"),
    ("IMPRESSION: ", "{t}", ""),
    (
        "FINDINGS: ",
        "{t}",
        " TECHNIQUE: portable AP view of the chest. Compared to prior study of 10:30 AM, again seen."
        "\nCONCLUSION: In the interval: The heart is normal .. In addition no change.",
    ),
    ("Findings: ", "{t}", " Results were discussed with Dr. Smith at 10:30."),
    ("FINDINGS:\nIMPRESSION: ok", "", ""),
    ("", "{t}", "\nOPINION: {t}\nRECOMMENDATION: frontal and lateral views obtained. [**name**] ___ **\nfindings : {t}"),
)


def _fill(template: str, text: Column) -> Column:
    pieces = template.split("{t}")
    cols = []
    for i, piece in enumerate(pieces):
        if i:
            cols.append(text)
        if piece:
            cols.append(F.lit(piece))
    return F.concat(*cols) if cols else F.lit("")


def _quote(s: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


def _fill_sql(template: str, text: str = "text") -> str:
    return " || ".join(
        x for i, piece in enumerate(template.split("{t}")) for x in ([text] if i else []) + ([_quote(piece)] if piece else [])
    ) or "''"


def raw_report(doc_id: Column, text: Column) -> Column:
    out = None
    for n, shape in enumerate(_SHAPES):
        test, value = doc_id % len(_SHAPES) == n, _fill("".join(shape), text)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


RAW_SQL = "raw AS (SELECT doc_id, CASE doc_id % {n} {cases} END AS raw FROM documents)".format(
    n=len(_SHAPES),
    cases=" ".join(f"WHEN {i} THEN {_fill_sql(''.join(s))}" for i, s in enumerate(_SHAPES)),
)


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.select("doc_id", raw_report(F.col("doc_id"), F.col("text")).alias("report_raw"))


# -- SQL forms of the text functions ------------------------------------------------------------


def rx(text: str, pattern: str, replacement: str = " ") -> str:
    return f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"


def cascade_sql(text: str, patterns, replacement: str = " ", flags: str = "(?i)") -> str:
    return reduce(lambda t, p: rx(t, flags + p, replacement), patterns, text)


def strip_sql(text: str) -> str:
    return rx(text, r"^\s+|\s+$", "")


def squeeze_sql(text: str) -> str:
    return strip_sql(rx(text, r"\s+", " "))


def noise_sql(text: str) -> str:
    return cascade_sql(rx(text, P.CLOCK_TIME, ""), P.BENIGN_NOISE)


def repair_sql(text: str) -> str:
    for g in P.GHOST_WORDS:
        text = rx(text, rf"(?i)^{g}(?:,)?\s+", "")
        text = rx(text, rf"(?i):\s+{g}(?:,)?\s+", ": ")
    text = rx(rx(rx(text, r"\s+", " "), r"\s+\.", "."), r"\.{2,}", ".")
    return strip_sql(rx(text, "^[^a-zA-Z0-9]+", ""))


def basic_sql(text: str) -> str:
    t = rx(text, r"[\n\r\t]", " ")
    return strip_sql(rx(rx(rx(t, r"\[\*\*.*?\*\*\]", ""), "__+", " "), r"\*\*+", " "))


def markup_sql(text: str, bare: bool = True) -> str:
    t = rx(text, r"\\[a-zA-Z]+\{[^}]*\}", "")
    if bare:
        t = rx(t, r"\\[a-zA-Z]+", "")
    return rx(t, "[{}]+", "")


def metric_sql(text: str, bare: bool = True) -> str:
    t = rx(f"lower(replace({text}, '<unk>', 'unk'))", "(?i)" + P.METRIC_HEADERS, " ")
    t = rx(rx(t, r"[\n\r\t]+", " "), "([.,;?!:])", r" \1 ")
    return squeeze_sql(markup_sql(t, bare))


def clinical_sql(text: str) -> str:
    t = rx(f"replace({text}, '<unk>', 'unk')", "(?i)" + P.METRIC_HEADERS, " ")
    return squeeze_sql(rx(markup_sql(t), r"[\n\r\t]+", " "))


def _named(names) -> str:
    """The last section with the first of ``names`` that occurs."""
    return "coalesce({}, '')".format(
        ", ".join(f"list_filter(secs, lambda s: upper(split_part(s, chr(2), 1)) = '{n}')[-1]" for n in names)
    )


SECTIONS_SQL = rf"""{RAW_SQL},
parts AS (SELECT doc_id, raw, string_split(regexp_replace(raw, '(?im)^\s*({"|".join(P.SECTION_HEADERS)})\s*:?',
                 chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] AS secs FROM raw),
sec AS (SELECT doc_id,
  CASE WHEN len(secs) = 0 THEN raw ELSE {strip_sql(f"split_part({_named(['FINDINGS'])}, chr(2), 2)")} END AS findings,
  CASE WHEN len(secs) = 0 THEN '' ELSE
    {strip_sql(f"split_part({_named(['IMPRESSION', 'CONCLUSION', 'RECOMMENDATION'])}, chr(2), 2)")} END AS impression
  FROM parts)"""

ROUTED_SQL = f"""{SECTIONS_SQL},
b AS (SELECT doc_id, {basic_sql('findings')} AS f0, {basic_sql('impression')} AS i0 FROM sec),
tox AS (SELECT *, {" OR ".join(f"regexp_matches(f0 || ' ' || i0, '(?i){p}')" for p in P.TOXIC)} AS toxic FROM b),
fill AS (SELECT *, CASE WHEN f0 <> '' THEN f0 ELSE i0 END AS f, CASE WHEN i0 <> '' THEN i0 ELSE f0 END AS i,
         (f0 = '' AND i0 <> '' AND NOT toxic) AS findings_filled FROM tox),
cl AS (SELECT *, {repair_sql(noise_sql("('Findings: ' || f || ' Impression: ' || i)"))} AS r1,
       {repair_sql(cascade_sql(noise_sql('f'), P.VIEW_PHRASES))} AS f1 FROM fill),
routed AS (SELECT doc_id, findings_filled,
  CASE WHEN toxic THEN 'rejected_toxic' WHEN f = '' OR length(f1) < 5 THEN 'rejected_quality' ELSE 'valid' END AS status,
  r1, f1 FROM cl)"""


@query("sections", f"WITH {SECTIONS_SQL} SELECT * FROM sec")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = T.sections(F.col("report_raw"))
    raw = raw_reports(spark, sf_dir).select("doc_id", cut.alias("s"))
    return raw.select("doc_id", "s.findings", "s.impression")


@query("basic_clean", f"WITH {RAW_SQL} SELECT doc_id, {basic_sql('raw')} AS cleaned FROM raw")
def basic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_reports(spark, sf_dir).select("doc_id", T.basic_clean(F.col("report_raw")).alias("cleaned"))


@query(
    "noise_cascade",
    f"WITH {RAW_SQL}, b AS (SELECT doc_id, {basic_sql('raw')} AS t FROM raw) "
    f"SELECT doc_id, {noise_sql('t')} AS no_noise, {cascade_sql('t', P.VIEW_PHRASES)} AS no_views FROM b",
)
def noise_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = raw_reports(spark, sf_dir).select("doc_id", T.basic_clean(F.col("report_raw")).alias("t"))
    return base.select(
        "doc_id",
        T.remove_benign_noise(F.col("t")).alias("no_noise"),
        T.remove_view_phrases(F.col("t")).alias("no_views"),
    )


@query("punctuation_repair", f"WITH {RAW_SQL} SELECT doc_id, {repair_sql('raw')} AS repaired FROM raw")
def punctuation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_reports(spark, sf_dir).select("doc_id", T.repair_punctuation(F.col("report_raw")).alias("repaired"))


@query(
    "report_status",
    f"""WITH {ROUTED_SQL} SELECT doc_id, status, findings_filled,
    CASE WHEN status = 'valid' THEN r1 END AS report, CASE WHEN status = 'valid' THEN f1 END AS findings FROM routed""",
)
def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.route_reports(raw_reports(spark, sf_dir)).drop("report_raw")


@query(
    "build_counters",
    f"""WITH {ROUTED_SQL} SELECT count(*) AS file_verified,
    count(*) FILTER (status = 'valid') AS reports_cleaned, count(*) FILTER (status = 'rejected_toxic') AS rejected_toxic,
    count(*) FILTER (status = 'rejected_quality') AS rejected_quality,
    count(*) FILTER (findings_filled) AS findings_filled, count(*) FILTER (status = 'valid') AS final_records FROM routed""",
)
def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.build_counters(R.route_reports(raw_reports(spark, sf_dir)))


_RESIDUAL = (
    " Findings were conveyed by Dr. Lee to Dr. Ng by telephone at 10:30 on Monday.",
    " The study done at 09:15. Then 08:00 hours is submitted. and text on at end",
    "",
    " Dictated by staff.. Attending: X. Findings:",
)
_RESIDUAL_SQL = "raw2 AS (SELECT doc_id, CASE doc_id % {n} {cases} END AS t FROM documents)".format(
    n=len(_RESIDUAL),
    cases=" ".join(f"WHEN {i} THEN 'However ' || text || {_quote(s)}" for i, s in enumerate(_RESIDUAL)),
)


def second_sql(text: str) -> str:
    t = rx(squeeze_sql(cascade_sql(text, P.RESIDUAL_NOISE)), r"\.{2,}", ".")
    return rx(t, "(?i)" + P.LEADING_CONJUNCTION, "")


def residual_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    tail = None
    for n, extra in enumerate(_RESIDUAL):
        test = F.col("doc_id") % len(_RESIDUAL) == n
        tail = F.when(test, extra) if tail is None else tail.when(test, extra)
    return docs.select("doc_id", F.concat(F.lit("However "), F.col("text"), tail).alias("t"))


@query("second_clean", f"WITH {_RESIDUAL_SQL} SELECT doc_id, {second_sql('t')} AS cleaned FROM raw2")
def second_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_reports(spark, sf_dir).select("doc_id", T.second_pass_clean(F.col("t")).alias("cleaned"))


@query(
    "second_clean_counts",
    f"""WITH {_RESIDUAL_SQL}, c AS (SELECT t, {second_sql('t')} AS u FROM raw2)
    SELECT count(*) AS total, count(*) FILTER (t <> u) AS report_changed,
           round(count(*) FILTER (t <> u) * 100.0 / count(*), 6)::DOUBLE AS report_changed_pct FROM c""",
)
def second_clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = residual_reports(spark, sf_dir).select("t", T.second_pass_clean(F.col("t")).alias("u"))
    return R.change_counts(cleaned, {"report": (F.col("t"), F.col("u"))})


# -- findings/impression merge over text pairs --------------------------------------------------

PREDICTIONS_SQL = f"""{PAIRS_SQL},
pred AS (SELECT pair_id, CASE pair_id % 5 WHEN 0 THEN ref
  WHEN 1 THEN 'FINDINGS: ' || ref || chr(10) || 'IMPRESSION: ' || ref
  WHEN 2 THEN CAST(to_json({{'findings': ref, 'impression': hyp}}) AS VARCHAR)
  WHEN 3 THEN 'Findings : ' || ref || ' impression: ' || hyp
  ELSE 'IMPRESSION: ' || ref || ' \\textbf{{x}} <unk> {{}}' END AS real_report, hyp AS generated_report FROM pairs)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spread_pairs(spark, sf_dir)
    r, h, n = F.col("ref"), F.col("hyp"), F.col("pair_id") % 5
    real = (
        F.when(n == 0, r)
        .when(n == 1, F.concat(F.lit("FINDINGS: "), r, F.lit("\nIMPRESSION: "), r))
        .when(n == 2, F.to_json(F.struct(r.alias("findings"), h.alias("impression"))))
        .when(n == 3, F.concat(F.lit("Findings : "), r, F.lit(" impression: "), h))
        .otherwise(F.concat(F.lit("IMPRESSION: "), r, F.lit(" \\textbf{x} <unk> {}")))
    )
    return base.select("pair_id", real.alias("real_report"), h.alias("generated_report"))


def spread_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


def _fi_sql(src: str) -> str:
    f, i = r"(?is)\bfindings\s*:\s*", r"(?is)\bimpression\s*:\s*"
    return rf"""
h AS (SELECT *, regexp_extract(t, '{f}') AS fh, regexp_extract(t, '{i}') AS ih FROM {src}),
p AS (SELECT *, CASE WHEN fh = '' THEN 0 ELSE instr(t, fh) END AS fa, CASE WHEN ih = '' THEN 0 ELSE instr(t, ih) END AS ia FROM h),
fi AS (SELECT pair_id, t,
  CASE WHEN NOT (contains(lower(t), 'findings:') OR contains(lower(t), 'impression:')) THEN {strip_sql('t')}
       WHEN fa = 0 THEN ''
       WHEN ia > fa + length(fh) THEN {strip_sql('substr(t, fa + length(fh), ia - fa - length(fh))')}
       ELSE {strip_sql('substr(t, fa + length(fh))')} END AS f,
  CASE WHEN NOT (contains(lower(t), 'findings:') OR contains(lower(t), 'impression:')) THEN ''
       WHEN ia = 0 THEN '' ELSE {strip_sql('substr(t, ia + length(ih))')} END AS i FROM p)"""


def _norm_sql(x: str) -> str:
    return squeeze_sql(rx(f"lower({x})", "(?i)" + P.METRIC_HEADERS, " "))


MERGED_SQL = f"""{PREDICTIONS_SQL}, src AS (SELECT pair_id, real_report AS t FROM pred), {_fi_sql('src')},
obj AS (SELECT pair_id, t,
  CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT'
       THEN {strip_sql("coalesce(json_extract_string(CASE WHEN json_valid(t) THEN t END, '$.findings'), '')")} ELSE f END AS f,
  CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT'
       THEN {strip_sql("coalesce(json_extract_string(CASE WHEN json_valid(t) THEN t END, '$.impression'), '')")} ELSE i END AS i FROM fi),
nm AS (SELECT *, {_norm_sql('f')} AS nf, {_norm_sql('i')} AS ni FROM obj),
dd AS (SELECT pair_id, t, CASE WHEN f = '' THEN i WHEN i = '' THEN f WHEN nf = ni THEN f
  WHEN starts_with(ni, nf) AND length(ni) <= length(nf) + 10 THEN f ELSE {strip_sql("(f || ' ' || i)")} END AS m FROM nm),
merged AS (SELECT pair_id, CASE WHEN m = '' THEN {strip_sql('t')} ELSE m END AS merged FROM dd)"""


@query("findings_impression_split", f"WITH {PREDICTIONS_SQL}, src AS (SELECT pair_id, real_report AS t FROM pred), {_fi_sql('src')} SELECT pair_id, f AS findings, i AS impression FROM fi")
def findings_impression_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = T.split_findings_impression(F.col("real_report"))
    rows = predictions(spark, sf_dir).select("pair_id", cut.alias("s"))
    return rows.select("pair_id", "s.findings", "s.impression")


@query("findings_impression_merge", f"WITH {MERGED_SQL} SELECT * FROM merged")
def findings_impression_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("pair_id", T.merge_report(F.col("real_report")).alias("merged"))


@query(
    "metric_clean",
    f"""WITH {MERGED_SQL} SELECT pair_id, {metric_sql('merged')} AS for_metric,
    {metric_sql('merged', False)} AS for_selection, {clinical_sql('merged')} AS for_clinical FROM merged""",
)
def metric_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = predictions(spark, sf_dir).select("pair_id", T.merge_report(F.col("real_report")).alias("m"))
    return merged.select(
        "pair_id",
        T.metric_clean(F.col("m")).alias("for_metric"),
        T.metric_clean(F.col("m"), drop_bare_commands=False).alias("for_selection"),
        T.clinical_clean(F.col("m")).alias("for_clinical"),
    )


_SHOWN_SQL = "'[History] old' || chr(10) || 'Findings: ' || text || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Task: none' ELSE 'Report: FINDINGS : ' || text END"
_LINES = "list_filter(string_split(t, chr(10)), lambda l: NOT ({}))".format(
    " OR ".join(f"contains(l, '{m}')" for m in P.DISPLAY_MARKERS)
)


@query(
    "display_clean",
    f"""WITH s AS (SELECT conv_id, turn, {strip_sql(f'({_SHOWN_SQL})')} AS t FROM conversations),
    j AS (SELECT conv_id, turn, array_to_string({_LINES}, ' ') AS t FROM s),
    r AS (SELECT conv_id, turn, string_split(t, 'Report:')[-1] AS t FROM j),
    b AS (SELECT conv_id, turn, CASE WHEN upper(substr(t, 1, 8)) = 'FINDINGS' AND instr(t, ':') BETWEEN 1 AND 15
          THEN substr(t, instr(t, ':') + 1) ELSE t END AS t FROM r)
    SELECT conv_id, turn, {squeeze_sql('t')} AS shown,
      'FINDINGS: ' || {squeeze_sql("CASE WHEN instr(upper(a), 'FINDINGS:') > 0 THEN substr(a, instr(upper(a), 'FINDINGS:')) ELSE a END")} AS ascii_shown
    FROM (SELECT *, {strip_sql(rx('t', r'[^\x00-\x7F]+', ' '))} AS a FROM b)""",
)
def display_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table

    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    text = F.col("text")
    tail = F.when(F.col("turn") % 2 == 0, "Task: none").otherwise(F.concat(F.lit("Report: FINDINGS : "), text))
    shown = F.concat(F.lit("[History] old\nFindings: "), text, F.lit("\n"), tail)
    step = conv.select("conv_id", "turn", T.display_clean(shown).alias("shown"))
    return step.select("conv_id", "turn", "shown", T.ascii_output(F.col("shown")).alias("ascii_shown"))


@query(
    "text_profile",
    f"""WITH {PAIRS_SQL}, l AS (SELECT length({strip_sql('ref')}) AS r, length({strip_sql('hyp')}) AS g FROM pairs)
    SELECT count(*) AS total_lines, count(*) FILTER (r > 0 AND g > 0) AS valid_lines,
      count(*) FILTER (r = 0) AS empty_real, count(*) FILTER (g = 0) AS empty_gen,
      count(*) FILTER (r > 0 AND r < 20) AS very_short_real, count(*) FILTER (g > 0 AND g < 20) AS very_short_gen,
      round(avg(r), 6) AS mean_real, round(avg(g), 6) AS mean_gen, median(r) AS median_real, median(g) AS median_gen,
      min(r) AS min_real, min(g) AS min_gen, max(r) AS max_real, max(g) AS max_gen,
      CASE WHEN count(*) FILTER (r > 0 AND g > 0) = 0 THEN 'no valid samples'
           WHEN count(*) FILTER (r > 0 AND g > 0) < count(*) * 0.5 THEN 'more than half invalid'
           WHEN count(*) FILTER (g > 0 AND g < 20) > count(*) FILTER (r > 0 AND g > 0) * 0.3 THEN 'many short generated texts'
           ELSE 'good' END AS verdict FROM l""",
)
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.text_profile(pairs(spark, sf_dir), {"real": "ref", "gen": "hyp"})


# -- keyword rules ------------------------------------------------------------------------------

KEYWORDS = (
    ("the", "Article"),
    ("an", "Article"),
    ("tion", "Suffix"),
    ("ing", "Suffix"),
    ("que", "Romance"),
    ("sch", "Germanic"),
    ("###", "Markup"),
    ("token", "Secret"),
)
_KEYWORD_ROWS = ", ".join(f"({i}, '{k}', '{f}')" for i, (k, f) in enumerate(KEYWORDS))


@query(
    "keyword_relevance",
    "SELECT doc_id, {} AS relevant, regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:that|token|einer)(?:$|[^\\p{{L}}\\p{{N}}_])') AS relevant_words FROM documents".format(
        "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ("that", "token", "einer")) + ")"
    ),
)
def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("that", "token", "einer")
    return documents(spark, sf_dir).select(
        "doc_id",
        T.contains_any(F.col("text"), words).alias("relevant"),
        T.contains_any(F.col("text"), words, whole_words=True).alias("relevant_words"),
    )


@query(
    "keyword_findings",
    f"""WITH k(ord, keyword, finding) AS (VALUES {_KEYWORD_ROWS})
    SELECT doc_id, finding, CASE WHEN count(DISTINCT keyword) >= 2 THEN 'high' ELSE 'medium' END AS confidence,
           string_agg(keyword, ',' ORDER BY ord) AS keywords
    FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY 1, 2""",
)
def keyword_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = FD.report_findings(docs, "text", KEYWORDS)
    return found.select("doc_id", "finding", "confidence", F.concat_ws(",", "keywords").alias("keywords"))


@query(
    "priority_label",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'Secret'
      WHEN contains(lower(text), '###') OR contains(lower(text), '%%%') THEN 'Markup'
      WHEN contains(lower(text), 'that') THEN 'Article' ELSE 'Other' END AS label FROM documents""",
)
def priority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("Secret", ("token",)), ("Markup", ("###", "%%%")), ("Article", ("that",)))
    return documents(spark, sf_dir).select("doc_id", T.rule_label(F.col("text"), rules).alias("label"))


def _rule_sql(rules, blank: str) -> str:
    cases = " ".join(
        "WHEN {} THEN '{}'".format(" OR ".join(f"contains(lower(text), '{w}')" for w in words), label) for label, words in rules
    )
    return (
        f"SELECT doc_id, CASE WHEN {strip_sql('text')} = '' THEN '{blank}' {cases} ELSE 'Other' END AS label "
        "FROM documents"
    )


def _diagnosed(spark: SparkSession, sf_dir: str, rules, blank: str | None) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.rule_label(F.col("text"), rules, blank=blank).alias("label"))


@query("diagnosis_patch", _rule_sql(DIAGNOSIS_RULES_PATCH, "Unknown"))
def diagnosis_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir, DIAGNOSIS_RULES_PATCH, "Unknown")


@query("diagnosis_pooled", _rule_sql(DIAGNOSIS_RULES_POOLED, "Other"))
def diagnosis_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir, DIAGNOSIS_RULES_POOLED, None)


@query(
    "keyword_labels",
    f"""WITH k(ord, keyword, finding) AS (VALUES {_KEYWORD_ROWS})
    SELECT doc_id, finding AS label_name, CAST(max(CASE WHEN contains(lower(text), keyword) THEN 1 ELSE 0 END) AS INTEGER) AS value
    FROM documents CROSS JOIN k GROUP BY 1, 2""",
)
def keyword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.keyword_labels(documents(spark, sf_dir).select("doc_id", "text"), "text", KEYWORDS).drop("text")


@query(
    "text_fallback",
    """SELECT doc_id, length(CASE WHEN length(source) < 5 THEN text ELSE source END) AS n_chars_used,
      substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 150) AS clamped FROM documents""",
)
def text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sources fall back to the text."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.length(T.text_or_fallback(F.col("source"), F.col("text"))).cast("bigint").alias("n_chars_used"),
        T.clamp(F.col("text"), 150).alias("clamped"),
    )


@query(
    "empty_reports_json",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[A-Za-z\s]+', '', 'g'), '[.,]+', '', 'g')) = '' AS empty FROM documents""",
)
def empty_reports_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report objects of which plain words are stripped: empty if no string holds anything else."""
    rest = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z\s]+", ""), "[.,]+", "")
    report = F.to_json(F.struct(rest.alias("findings"), F.lit(" ").alias("impression")))
    return documents(spark, sf_dir).select("doc_id", T.is_report_empty(report, "json").alias("empty"))


@query("build_counters_observed", f"WITH {ROUTED_SQL} SELECT count(*) AS file_verified, count(*) FILTER (status = 'valid') AS reports_cleaned, count(*) FILTER (status = 'rejected_toxic') AS rejected_toxic, count(*) FILTER (status = 'rejected_quality') AS rejected_quality, count(*) FILTER (findings_filled) AS findings_filled, count(*) FILTER (status = 'valid') AS final_records FROM routed")
def build_counters_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the job that writes the routed reports, measured while it runs."""
    from ..session import scratch_path

    path = scratch_path(spark, "routed")
    return R.write_routed(R.route_reports(raw_reports(spark, sf_dir)), path)
