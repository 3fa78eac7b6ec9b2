import math

import pytest
from pyspark.sql import functions as F

from studyloom.operators import labels as L
from studyloom.operators import metrics as M


def pairs(spark, *rows):
    return spark.createDataFrame([(i, r.split(), h.split()) for i, (r, h) in enumerate(rows)], "id int, ref array<string>, hyp array<string>")


def test_bleu_identity_and_disjoint(spark):
    same = M.corpus_bleu(M.ngram_counts(pairs(spark, ("a b c d e", "a b c d e")), "id")).first()
    assert [same[f"bleu_{k}"] for k in range(1, 5)] == [1.0] * 4
    none = M.corpus_bleu(M.ngram_counts(pairs(spark, ("a b c d", "x y z w")), "id")).first()
    assert none["bleu_1"] == pytest.approx(0, abs=1e-6)


def test_bleu_clipping_and_brevity(spark):
    got = M.pair_bleu(M.ngram_counts(pairs(spark, ("the cat sat on the mat", "the the the")), "id"), "id").first()
    assert got["bleu_1"] == pytest.approx(2 / 3 * math.exp(1 - 6 / 3), abs=1e-6)


def test_rouge_l(spark):
    got = M.rouge_l(pairs(spark, ("the cat sat on mat", "the cat on the mat"), ("a b", "c d")), "id", beta=1.0)
    scores = {r["id"]: r["rouge_l"] for r in got.collect()}
    assert scores == {0: 0.8, 1: 0.0}


def test_lcs_against_table():
    import random

    rng = random.Random(2)
    for _ in range(50):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 90))]
        b = [rng.choice("abc") for _ in range(rng.randrange(0, 90))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert M._lcs(a, b) == row[-1]


def test_cider_heavy_ngrams_match_plain_join(spark):
    rows = [("the x%d is clear now" % i, "the x%d was clear" % (i % 5)) for i in range(300)]
    p = pairs(spark, *rows)
    counts = M.ngram_counts(p, "id")
    freq = {}
    for ref, _ in rows:
        toks = ref.split()
        for n in range(1, 5):
            for g in {" ".join(toks[i : i + n]) for i in range(len(toks) - n + 1)}:
                freq[n, g] = freq.get((n, g), 0) + 1
    got = M.with_frequency(counts, M.document_frequency(counts)).collect()
    assert len(got) == counts.count()
    assert all(r["df"] == max(1, freq.get((r["n"], r["gram"]), 1)) for r in got)
    assert M.corpus_mean(M.cider(counts, "id", M.pair_total(p)), "cider").first()[0] > 0


def scores(spark, rows):
    return spark.createDataFrame([("l", float(y), float(p)) for y, p in rows], "label_name string, y double, prob double")


def test_auroc_with_ties_and_uncertain(spark):
    rows = [(1, 0.9), (1, 0.5), (1, 0.5), (0, 0.5), (0, 0.4), (0, 0.1), (0.5, 0.99)] * 3
    known = [(y, p) for y, p in rows if y != 0.5]
    pos, neg = [p for y, p in known if y == 1], [p for y, p in known if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    got = {r["label_name"]: r for r in L.auroc(scores(spark, rows)).collect()}
    assert got["l"]["auroc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-6)
    assert got["l"]["n_known"] == len(known)


def test_auroc_needs_both_classes(spark):
    got = {r["label_name"]: r["auroc"] for r in L.auroc(scores(spark, [(1, 0.3)] * 12)).collect()}
    assert got["l"] is None


def test_best_threshold_first_wins(spark):
    rows = [(1, 0.8), (1, 0.7), (0, 0.3), (0, 0.2)]
    got = {r["label_name"]: r for r in L.best_threshold(scores(spark, rows)).collect()}["l"]
    assert got["best_f1"] == 1.0 and got["best_threshold"] == pytest.approx(0.305)


def test_normalise(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert [r[0] for r in df.select(L.normalise(F.col("v"))).collect()] == [1.0, 0.0, 0.5, 0.0, 0.0, 3.0]
    assert [r[0] for r in df.select(L.normalise(F.col("v"), strict=True)).collect()][-1] == 0.0


def test_class_weights_clip(spark):
    rows = [("a", 1.0)] * 99 + [("a", 0.0)] + [("b", 1.0)] + [("b", 0.0)] * 99 + [("c", 0.0)] * 100
    df = spark.createDataFrame(rows, "label_name string, value double")
    w = {r["label_name"]: r["weight"] for r in L.class_weights(df).collect()}
    raw = {"a": 100 / (3 * 99), "b": 100 / 3, "c": 1.0}
    mean = sum(raw.values()) / 3
    assert w == {k: pytest.approx(min(max(v / mean, 0.5), 3.0), abs=1e-6) for k, v in raw.items()}


def test_weights_of_available_metrics():
    w = {"a": 0.4, "b": 0.4, "c": 0.2}
    assert M.normal_weights(w, {"a": True, "c": True}) == pytest.approx({"a": 2 / 3, "c": 1 / 3})
    assert M.normal_weights(w, {}) == {}
