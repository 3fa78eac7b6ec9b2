"""Large baskets, hubs and exact order statistics against brute force."""

import random
import statistics
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from studyloom.operators import features as X
from studyloom.operators import knowledge as K
from studyloom.plans.build_kb import build_kb, build_kb_from_timelines


@pytest.mark.parametrize("chunk", [64, 3, 1])
def test_cooccurrence_of_a_large_basket(spark, chunk):
    rng = random.Random(1)
    baskets = {0: [f"c{i}" for i in range(90)]} | {b: rng.sample([f"c{i}" for i in range(90)], rng.randrange(1, 8)) for b in range(1, 60)}
    rows = [(b, c) for b, cs in baskets.items() for c in cs] * 2 + [(5, None)]
    found = K.cooccurrence(
        spark.createDataFrame(rows, "basket int, code string"), basket="basket", code="code", min_support=2, min_confidence=0.0, chunk=chunk
    )
    n = Counter(c for cs in baskets.values() for c in set(cs))
    pairs = Counter(p for cs in baskets.values() for p in combinations(sorted(set(cs)), 2))
    want = {(a, b, s, s / min(n[a], n[b])) for (a, b), s in pairs.items() if s >= 2}
    assert {tuple(r) for r in found.collect()} == want


def test_basket_of_ten_thousand_codes_spreads_and_stays_whole(spark):
    codes = spark.range(10_000).select(F.lit(1).alias("basket"), F.concat(F.lit("c"), "id").alias("code"))
    few = spark.range(300).select(F.lit(2).alias("basket"), F.concat(F.lit("c"), "id").alias("code"))
    found = K.cooccurrence(codes.unionByName(few), basket="basket", code="code", min_support=2, min_confidence=0.0)
    assert found.agg(F.count("*"), F.min("support"), F.max("support")).first()[:] == (300 * 299 // 2, 2, 2)


def test_baskets_move_once_to_be_dealt_into_chunks(spark, monkeypatch):
    written, cut = {}, K.cut_lineage

    def kept(df, name="step"):
        written[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(K, "cut_lineage", kept)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.createDataFrame([(b, f"c{c}") for b in range(20) for c in range(b % 5)], "b int, c string")
        K.cooccurrence(rows, basket="b", code="c", min_support=2, min_confidence=0.0).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert written["chunks"].count("Exchange hashpartitioning") == 1


def grown(seeds, entities, relations, hops, limit):
    """Members and edges as the definition has them, one key at a time."""
    nodes, edges = {}, []
    for key, codes in seeds.items():
        members = sorted(set(codes))[:limit]
        frontier = list(members)
        for _ in range(hops):
            before, room, joined, last = set(members), limit - len(members), [], None
            if room <= 0:
                break
            steps = []
            for src in sorted(frontier):
                out = sorted([(0, o, t, r, w) for s, t, r, w, o in relations if s == src])
                if len(src) > 3 and src[:3] in entities:
                    out.append((1, 0, src[:3], "is_a", 1.0))
                steps += [(src, *x) for x in out]
            order = []
            for src, l, o, t, *_ in sorted(steps, key=lambda x: x[:4]):
                if t not in before and t not in order:
                    order.append(t)
                    if len(order) == room:
                        last = src
                        break
            joined = order
            edges += [(key, s, t, r) for s, _, _, t, r, _ in steps if (t in before or t in joined) and (last is None or s <= last)]
            members += joined
            frontier = joined
        nodes[key] = {m for m in members if m in entities}
    return nodes, sorted(e for e in edges if e[1] in entities and e[2] in entities)


def test_bounded_subgraph_with_a_hub(spark):
    rng = random.Random(3)
    names = [f"{p}{i}" for p in ("400", "401", "402") for i in range(25)] + ["400", "401", "402"]
    relations = [("4001", f"9{i:04d}", "causes", 0.5, i) for i in range(3000)]  # the hub
    relations += [("4001", n, "late", 0.5, 5000 + i) for i, n in enumerate(names[:40])]
    relations += [(rng.choice(names), rng.choice(names), rng.choice(["causes", "co"]), 0.4, i) for i in range(260)]
    entities = names + [f"9{i:04d}" for i in range(3000)]
    seeds = {k: rng.sample(names, rng.randrange(1, 7)) + (["4001"] if k % 2 else []) for k in range(25)}
    n, e = K.subgraph(
        spark.createDataFrame([(k, c) for k, cs in seeds.items() for c in cs], "key int, icd string"),
        spark.createDataFrame([(x,) for x in entities], "icd string"),
        spark.createDataFrame(relations, K.RELATION_SCHEMA),
        key="key", code="icd", max_entities=12,
    )
    nodes, edges = grown(seeds, set(entities), relations, 2, 12)
    got = {}
    for r in n.collect():
        got.setdefault(r["key"], set()).add(r["icd"])
    assert got == {k: v for k, v in nodes.items() if v}
    assert sorted(tuple(r)[:4] for r in e.select("key", "src", "tgt", "rel_type").collect()) == edges
    head, tail = K.relation_heads(spark.createDataFrame(relations, K.RELATION_SCHEMA), 12)
    assert head.filter("src = '4001'").select("tgt").distinct().count() == 12 and head.count() + tail.count() == len(relations)


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 40 + [1.0, 9.0, 2.0], list(range(501)), [None, 4.0, None, 7.5]])
def test_median(spark, values):
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(3)
    kept = [v for v in values if v is not None]
    assert X.exact_median(rows, "x") == (statistics.median(kept) if kept else None)


def test_order_statistics_with_many_equal_values(spark):
    rng = random.Random(9)
    values = [rng.choice([0.5, 0.5, rng.random()]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    found = X.order_statistics(rows, "x", lambda n: [0, 17, n // 3, n // 2, n - 1])
    assert found == {k: sorted(values)[k] for k in (0, 17, 1000, 1500, 2999)}
    shares = X.value_distribution(rows, F.col("x") == 0.5, "half").collect()
    assert {r["half"]: r["n"] for r in shares} == Counter(v == 0.5 for v in values) and round(sum(r["percent"] for r in shares), 4) == 100


def test_kb_jobs_agree(spark):
    """From nested histories and from timelines."""
    rng = random.Random(5)
    diag = {h: [(rng.choice(["4011", "402", "403", "4044"]), f"n{rng.randrange(3)}") for _ in range(rng.randrange(0, 4))] for h in range(30)}
    studies = [(100 + i, 1 if i % 3 else 2, rng.randrange(0, 31)) for i in range(40)]
    history = [(s, [(str(h), "2020-01-01", "2020-01-02", [(0, c, d) for c, d in diag[h]], None) for h in range(e) if h % 2 == u % 2]) for s, u, e in studies]
    nested = spark.createDataFrame(
        history, "study_id long, history array<struct<hadm_id:string,admittime:string,dischtime:string,diagnoses:array<struct<seq_num:int,icd_code:string,description:string>>,drg:string>>"
    ).withColumn("study_datetime", F.lit("2021-01-01").cast("timestamp"))
    line, ends = [], {}
    for u in (1, 2):
        place = 0
        for h in range(30):
            ends[u, h] = place
            if h % 2 == u % 2:
                line += [(u, place + i, c, d, 1.0, 1) for i, (c, d) in enumerate(diag[h])]
                place += len(diag[h])
        ends[u, 30] = place
    marks = [(u, s, ends[u, e], 1) for s, u, e in studies]
    a = build_kb(nested, 3, 0.2)
    b = build_kb_from_timelines(
        spark.createDataFrame(line, "subject int, position long, icd string, description string, severity double, month int"),
        spark.createDataFrame(marks, "subject int, study_id long, end long, month int"), subject="subject", key="study_id", min_support=3, min_confidence=0.2,
    )
    for x, y in zip(a, b):
        assert sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.select(*x.columns).collect()), key=str) != []
