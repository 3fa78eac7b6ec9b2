import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from studyloom.conf import patterns as P
from studyloom.functions import text as T
from studyloom.operators import findings as FD
from studyloom.operators import reports as R


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, findings, impression",
    [
        ("plain text", "plain text", ""),
        ("FINDINGS: a\nIMPRESSION: b", "a", "b"),
        ("IMPRESSION: only", "", "only"),
        ("Findings: x\nfindings: y", "y", ""),
        ("FINDINGS: a\nCONCLUSION: c\nRECOMMENDATION: r", "a", "c"),
        ("FINDINGS: a\nRECOMMENDATION: r", "a", "r"),
        ("OPINION: o", "", ""),
        ("see findings: inline", "see findings: inline", ""),
    ],
)
def test_sections(spark, raw, findings, impression):
    s = one(spark, T.sections, raw)
    assert (s["findings"], s["impression"]) == (findings, impression)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("As a consequence heart is big", "a consequence heart is big"),
        ("However, lungs clear ..", "lungs clear."),
        ("In the lungs", "lungs"),
        ("Note:  Therefore, fine .", "Note: fine."),
    ],
)
def test_ghost_words_apply_in_list_order(spark, text, expected):
    assert one(spark, T.repair_punctuation, text) == expected


def test_basic_clean_and_masks(spark):
    assert one(spark, T.basic_clean, " a\nb [**name**] c___d ** e\t") == "a b  c d   e"
    assert one(spark, T.basic_clean, None) == ""


@pytest.mark.parametrize(
    "text, findings, impression",
    [
        ("Findings : a", "Findings : a", ""),
        ("findings : a impression: b", "a", "b"),
        ("impression: b findings: a", "a", "b findings: a"),
        ("FINDINGS: a IMPRESSION: a", "a", "a"),
        (None, "", ""),
    ],
)
def test_findings_impression_gate(spark, text, findings, impression):
    s = one(spark, T.split_findings_impression, text)
    assert (s["findings"], s["impression"]) == (findings, impression)


@pytest.mark.parametrize(
    "text, merged",
    [
        ("FINDINGS: lungs clear IMPRESSION: Lungs  clear", "lungs clear"),
        ("FINDINGS: lungs clear IMPRESSION: lungs clear today", "lungs clear"),
        ("FINDINGS: lungs clear IMPRESSION: something else", "lungs clear something else"),
        ('{"findings": "f", "impression": "i"}', "f i"),
        ('{"findings": null, "impression": "i"}', "i"),
        ("FINDINGS: IMPRESSION:", "IMPRESSION:"),
        ("just text ", "just text"),
    ],
)
def test_merge(spark, text, merged):
    assert one(spark, T.merge_report, text) == merged


def test_metric_cleans(spark):
    text = "FINDINGS: A,b <unk> \\textbf{x} \\cmd {c}."
    assert one(spark, T.metric_clean, text) == "a , b unk c ."
    assert one(spark, lambda c: T.metric_clean(c, False), text) == "a , b unk \\cmd c ."
    assert one(spark, T.clinical_clean, text) == "A,b unk c."


def test_display_clean(spark):
    text = "Task: x\nReport: FINDINGS: heart [CHECK]\nReport:FINDINGS : clear lungs"
    assert one(spark, T.display_clean, text) == "clear lungs"
    # a blank after the marker hides the header, which then stays
    assert one(spark, T.display_clean, "Report: FINDINGS : clear lungs") == "FINDINGS : clear lungs"
    assert one(spark, T.ascii_output, "é <end_of_turn> findings: ok") == "FINDINGS: findings: ok"


def test_second_pass(spark):
    assert one(spark, T.second_pass_clean, "and ok. Seen at 10:30 hours on day. End") == "ok. End"
    assert one(spark, T.second_pass_clean, "") == ""
    assert one(spark, T.second_pass_clean, None) is None


def test_sentence_anchor_changes_nothing(spark):
    import re

    from studyloom.conf.patterns import RESIDUAL_NOISE

    texts = [
        "A. results were conveyed by Dr. Lee to Dr. Ng today. B pager was placed. C",
        "x min after y. Dictated by q. z is submitted. done at 10:30 ok. 11:22 hours. phone rang at 10:30 x.",
        "no stops results were conveyed",
    ]
    for text in texts:
        expected = text
        for p in RESIDUAL_NOISE:
            expected = re.sub(p, " ", expected, flags=re.IGNORECASE)
        assert one(spark, lambda c: T.cascade(c, RESIDUAL_NOISE), text) == expected


def test_needed_words_change_nothing(spark):
    """Patterns tried on every text and only on texts with their words give the same, whatever the letters' case and kind."""
    rng = random.Random(5)
    words = [w for group in P.NEEDED_WORDS.values() for w in group] + [*P.TOXIC_WORDS, "to", "with", "is", "from", "the", "of", "in", "by", "read"]
    words += ["study", "AP", "and", "obtained", "were", "shows", "10:30 AM", ".", " . ", ":", "As", "In the", "heart"]
    odd = [lambda w: w, str.upper, lambda w: w.replace("s", "\u017f").replace("i", "\u0131"), lambda w: w.replace("i", "\u0130").replace("k", "\u212a")]
    made = lambda: "".join(rng.choice(odd)(rng.choice(words)) + rng.choice([" ", " ", "\n", "", ": "]) for _ in range(rng.randrange(14)))
    df = spark.createDataFrame([(made(),) for _ in range(3000)] + [(None,)], "t string")
    t = F.col("t")
    plain = lambda c, ps: reduce(lambda x, p: F.regexp_replace(x, T.FLAGS + p, " "), ps, c)

    def ghosts_off(c):
        for g in P.GHOST_WORDS:
            c = F.regexp_replace(c, rf"{T.FLAGS}^{g}(?:,)?\s+", "")
            c = F.regexp_replace(c, rf"{T.FLAGS}:\s+{g}(?:,)?\s+", ": ")
        return T.repair_punctuation(c, ())

    pairs = {
        "noise": (T.cascade(t, P.BENIGN_NOISE), plain(t, P.BENIGN_NOISE)),
        "views": (T.cascade(t, P.VIEW_PHRASES), plain(t, P.VIEW_PHRASES)),
        "toxic": (T.is_rejected_content(t), T.matches_any(t, P.TOXIC)),
        "ghosts": (T.repair_punctuation(t), ghosts_off(t)),
    }
    out = df.select(*[F.count_if(~a.eqNullSafe(b)).alias(n) for n, (a, b) in pairs.items()]).first()
    assert out.asDict() == dict.fromkeys(pairs, 0)
    assert 300 < df.filter(T.is_rejected_content(t)).count() < 2900


def test_routing_and_counters(spark):
    rows = [
        (1, "FINDINGS: the lungs are clear."),
        (2, "FINDINGS: seen. Results discussed with team."),
        (3, "FINDINGS: ok"),
        (4, "IMPRESSION: heart is enlarged."),
        (5, "OPINION: nothing"),
    ]
    routed = R.route_reports(spark.createDataFrame(rows, "id int, report_raw string")).orderBy("id")
    got = [(r["status"], r["findings_filled"], r["findings"]) for r in routed.collect()]
    assert got[0] == ("valid", False, "lungs are clear.")
    assert got[1] == ("rejected_toxic", False, None)
    assert got[2][0] == "rejected_quality" and got[4][0] == "rejected_quality"
    assert got[3] == ("valid", True, "heart is enlarged.")
    c = R.build_counters(routed).first()
    assert (c["final_records"], c["rejected_toxic"], c["rejected_quality"], c["findings_filled"]) == (2, 1, 2, 1)


def test_empty_report_modes(spark):
    js = lambda t: one(spark, lambda c: T.is_report_empty(c, "json"), t)
    assert js("plain text") and js("{}") and js('{"a": " "}') and js(None)
    assert not js('{"a": " ", "b": "x"}')
    assert one(spark, T.is_report_empty, " ") and not one(spark, T.is_report_empty, "x")


def test_finding_confidence(spark):
    df = spark.createDataFrame([(1, "Enlarged HEART, cardiomegaly, small effusion")], "id int, t string")
    from studyloom.conf.keywords import FINDING_KEYWORDS

    got = {r["finding"]: (r["confidence"], r["keywords"]) for r in FD.report_findings(df, "t", FINDING_KEYWORDS).collect()}
    assert got == {
        "Pleural Effusion": ("medium", ["effusion"]),
        "Cardiomegaly": ("high", ["cardiomegaly", "enlarged heart"]),
    }
