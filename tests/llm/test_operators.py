"""The training-data operators against brute force, libraries and SQL, with nulls, ties, repeats and odd texts."""

import glob
import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import compare
from studyloom.llm import bpe, hamming, hilbert, jaccard_join, licenses, mixing, quality, queries, spotsigs, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    base = [tuple(r) for r in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()]
    odd = [
        (1000, "ab" * 900), (1001, "x" * 1500), (1002, ""), (1003, None), (1004, base[3][1]), (1004, base[3][1]),
        (1005, "é" * 500 + base[5][1][:700]), (1006, "abcdefg " * 300), (1007, " \t\n"), (1008, "two words"), (1009, "Two  WORDS"),
        (1010, "x " * 20000),
    ]
    return base + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def removed(rows, length):
    seen = Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for i, text in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if seen[text[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    short = docs.filter("doc_id <> 1010")
    want = removed([(i, (t or "").encode()) for i, t in rows if i != 1010], 400)
    assert sorted(tuple(r) for r in suffix_dedup.digest_repeats(short).collect()) == want


def test_suffix_levels_merge():
    data = np.frombuffer(bytes(np.random.default_rng(1).integers(97, 99, 4000, dtype=np.uint8)), np.uint8)
    levels = suffix_dedup.SuffixLevels(12)
    for i in range(0, 4000, 400):
        part = data[i : i + 400]
        levels.add(part, np.arange(len(part) - 11), 0, 0)
    seen = Counter(data[i + p : i + p + 12].tobytes() for i in range(0, 4000, 400) for p in range(389))
    want = [seen[data[i + p : i + p + 12].tobytes()] > 1 for i in range(0, 4000, 400) for p in range(389)]
    assert levels.repeated.tolist() == want and len(levels.levels) <= 5


def test_remove_repeats_keeps_characters(docs):
    for row in suffix_dedup.remove_repeats(docs).collect():
        assert (row.text is None) == (row.doc_id == 1003)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_pipeline_cuts_repeated_passages_of_51_words(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    own = lambda i, n: [f"r{i}w{k}" for k in range(n)]
    passage, short, within = ([f"{p}{k % 13}{k}é"[-5:] for k in range(n)] for p, n in (("a", 51), ("b", 50), ("c", 60)))
    assert len(" ".join(passage).encode()) < 400
    words = [own(0, 40) + passage + own(10, 30), own(1, 7) + passage, passage + own(2, 60), own(3, 20) + short + own(13, 9), own(4, 20) + short]
    words += [within + own(5, 5) + within[3:] + own(15, 5), own(6, 3) + passage + within[:55] + own(16, 2), own(7, 300)]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(words)] + [(8, None, "en", "s", 0), (9, "", "en", "s", 0)]
    rows += [(10, "  ".join(passage) + "\n", "en", "s", 0)]
    seen = Counter(tuple(w[p : p + 51]) for w in [(t or "").split() for _, t, *_ in rows] for p in range(len(w) - 50))
    want = {}
    for i, text, *_ in rows:
        w = (text or "").split()
        gone = {p + k for p in range(len(w) - 50) if seen[tuple(w[p : p + 51])] > 1 for k in range(51)}
        want[i] = None if text is None else [x for k, x in enumerate(w) if k not in gone]
    assert want[0] == own(0, 40) + own(10, 30) and want[3] == words[3]
    found = corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF).collect()
    assert {r.doc_id: None if r.text is None else r.text.split() for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found if r.text is not None)


def shingled(rows, size, percent):
    sets = {}
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        own = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets[i] = own
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j]) if i < j and sets[i] else 0
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("percent", [90, 60])
def test_jaccard_join(docs, rows, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, 3, percent).collect()}
    assert found == shingled(rows, 3, percent)


@pytest.mark.parametrize("bits", [1, 22])
def test_jaccard_links_do_not_depend_on_the_order(docs, rows, bits):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, 5, 80, bits).collect()}
    assert found == shingled(rows, 5, 80)


def test_every_linked_pair_of_sizes_shares_a_prefix_shingle():
    for percent in (60, 80, 90):
        for a in range(1, 200):
            for b in range(a, 100 * a // percent + 1):
                least = int(jaccard_join.needed(a, b, percent))
                if least <= a and (a, b) != (least, least):
                    assert jaccard_join.prefix_length(a, percent) > a - least
                    assert jaccard_join.prefix_length(b, percent) > b - least


def test_jaccard_family_links_through_its_original(spark):
    base = [f"w{i}" for i in range(300)]
    family = [(0, " ".join(base))]
    for i in range(1, 40):
        own = list(base)
        for k in range(4):
            own[(7 * i + 71 * k) % 300] = f"edit{i}x{k}"
        family.append((i, " ".join(own)))
    docs = spark.createDataFrame(family, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs).collect()} == shingled(family, 3, 90)


def test_count_tree_finds_every_pair():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (300, 8)).astype(np.int64)
    sizes = points.sum(1)
    q, m = jaccard_join.CountTree(points, sizes).search(points, sizes, 80)
    bound = np.minimum(points[:, None], points[None]).sum(2)
    want = bound >= jaccard_join.needed(sizes[:, None], sizes[None], 80)
    assert set(zip(q.tolist(), m.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want))))


def test_keep_one(docs, rows):
    kept = [r.doc_id for r in jaccard_join.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and {1002, 1003, 1007} <= set(kept) and 1009 not in kept and 1004 not in kept


def test_keep_one_links_texts_and_not_ids(spark):
    base = [" ".join(f"{name}{k}" for k in range(30)) for name in "abcdef"]
    rows = [(None, base[0]), (None, base[1]), (None, base[1]), (None, base[2] + " more"), (None, base[2]), (None, None), (None, None)]
    rows += [(7, base[3]), (7, base[4]), (7, base[4]), (8, base[4]), (9, " "), (9, " "), (5, base[5]), (None, base[5])]
    kept = Counter((r.doc_id, (r.text or "").strip()[:1]) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == {(None, "a"): 1, (None, "b"): 1, (None, "c"): 1, (None, ""): 2, (7, "d"): 1, (7, "e"): 1, (9, ""): 2, (5, "f"): 1}


def test_bpe_equals_library(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    own = bpe.Tokenizer(path, cache_words=50)
    odd = ["<|endoftext|>x<|startoftext|> y<|endof", "it's I'LL  ΣΑΣ İstanbul ½ 12345\u0085x é é 한국 日本語 🎉 \x1c\x1d\x00", "a" * 3000, "'s's"]
    for text in [t or "" for _, t in rows] + odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.encode_joined(text)[2] == library.decode(ids, skip_special_tokens=False) == own.decode(ids)
    assert sum(r.n_tokens for r in bpe.encode_documents(docs, path).collect()) == sum(len(own.encode(t or "")) for _, t in rows)


def test_fingerprints(docs, rows):
    texts = sorted({(i, t or "") for i, t in rows if i != 1004}, reverse=True)
    found = {r.doc_id: r for r in spotsigs.digest_fingerprints(docs.filter("doc_id <> 1004")).collect()}
    cut = lambda s: {s[k : k + 8] for k in range(0, len(s), 8)}
    for (i, text), (j, after) in zip(texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        assert found[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        a, b, e = cut(found[i].fingerprint), cut(found[j].fingerprint), cut(found[i].edited_fingerprint)
        assert found[i].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert found[i].near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1.0)


def test_spots_of_a_sentence(spark):
    one = spark.createDataFrame([("The cat of the house sat.", "dog"), ("", None)], "a string, b string")
    sizes = one.select(F.size(spotsigs.spots(F.col("a"))), F.size(spotsigs.spots(F.coalesce("b", F.lit(""))))).collect()
    assert [tuple(r) for r in sizes] == [(3, 1), (0, 0)]


def test_license_scan(spark):
    texts = [
        (1, "All rights reserved. Licensed under CC BY-NC 4.0."), (2, "GNU General Public License, version 3 or later"), (3, None),
        (4, "Released under the MIT License. all rights RESERVED"), (5, "Das ist mit dem Haus"), (6, "apache license version 2.0 é"),
    ]
    found = {r.doc_id: r for r in licenses.digest_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].last_word) == (10, 2, 0, 5)
    assert found[1].labels == "cc-by,cc-by-nc-4.0,reserved" and found[1].base_labels == "cc-by,reserved"
    assert found[2].labels == "gpl,gpl-3.0-or-later" and found[2].n_detections == 1
    assert (found[3].n_words, found[3].labels, found[3].score, found[3].first_word) == (0, "", 0.0, None)
    assert found[4].labels == "mit,reserved" and found[5].labels == "" and found[6].labels == "apache-2.0"
    assert len(licenses.rules()) > 200


def test_points_of_very_large_sets():
    small = np.arange(1000, dtype=np.uint64)
    large = np.arange(70_000, dtype=np.uint64) * np.uint64(jaccard_join.GROUPS)  # all in one group
    points = [jaccard_join.point_of(x) for x in (small, large)]
    assert [len(p) for p in points] == [2 * jaccard_join.GROUPS, 4 * jaccard_join.GROUPS]
    found = jaccard_join.points_from(points)
    assert found.sum(1).tolist() == [1000, 70_000] and found[1, 0] == 70_000


def test_family_below_the_threshold_leaves_few_pairs(spark):
    """Copies with edits of their own share many keys but do not link; a chain of smaller edits does."""
    base = [f"w{i}" for i in range(300)]
    family = [[f"x{m}_{i}" if i % 25 == m % 25 else w for i, w in enumerate(base)] for m in range(20)]
    chain = [base[:i] + [f"y{i}"] + base[i + 1 :] for i in range(0, 60, 20)]
    texts = [" ".join(t) for t in family + chain]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x.split(" ") for x in texts)]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    assert 1 < len(set(comp)) < len(comp)
    found = jaccard_join.linked(docs, 5, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(comp))


def test_quality_and_toxicity(docs, labels, empty):
    weights = quality.fit_quality(docs, labels, ~quality.held_out(0, 5))
    scored = quality.score_quality(docs, weights, "n_chars").join(labels, "doc_id").collect()
    assert len(scored) == labels.count() and all(0 <= r.n_chars <= 1 for r in scored)  # a clashing name is replaced
    assert quality.score_quality(empty, weights).count() == 0
    model = toxicity.fit_toxicity(docs, labels, ~quality.held_out(1, 3), size=toxicity.Size(14, 16))
    scores = [r.toxicity for r in toxicity.score_toxicity(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    none = toxicity.fit_toxicity(docs, labels.limit(0), ~quality.held_out(1, 3), size=toxicity.Size(14, 16))
    assert {r.toxicity for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    assert {r.quality_score for r in quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}


def test_toxicity_counts_are_not_capped(spark):
    rows = [(f"p{i} hub", i % 2, i // 2 % 2) for i in range(2000)] + [("same pair " * 40_000, 0, 0), ("same pair " * 40_000, 0, 1)]
    size = toxicity.Size(20, 22)
    train = spark.createDataFrame(rows, "text string, label int, fold int").repartition(3)
    *halves, both = toxicity.count_tables(train, size)

    def slots(text):
        return [x[-1] for x in toxicity.words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), size)[:2]]

    hub, second = slots("p0 hub"), slots("same pair")
    assert [h["before"][hub[0]] for h in (*halves, both)] == [1000, 1000, 2000]
    model = toxicity.Models(both)
    assert model.counts[0][second[1]] == 80_000 and model.total[0] == 160_000 + 2000
    assert model.shared[hub[0]] / model.shared[second[0]] == pytest.approx(2000.5 / 1.5)


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = quality.held_out(1, 3)
    model = toxicity.fit_toxicity(docs, labels, ~held, size=toxicity.Size(18, 20))
    rows = toxicity.score_toxicity(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(held).select("toxicity", "toxic").collect()
    assert np.mean([r.toxicity >= 0.7 for r in rows if r.toxic]) > 0.6
    assert np.mean([r.toxicity >= 0.7 for r in rows if not r.toxic]) < 0.02


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = quality.held_out(0, 5)
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.fit_quality(docs, labels, ~held)).filter(held)
    rows = scored.join(labels, "doc_id").select("quality_score", "quality").collect()
    for label in (0, 1):
        assert np.mean([(r.quality_score >= 0.3) == label for r in rows if r.quality == label]) > 0.95


def test_hilbert_curve_is_one_walk():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hilbert.hilbert_index(list(grid.T), 3)
    walk = grid[np.argsort(place)]
    assert sorted(place) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards(docs, rows, empty, tmp_path):
    found = hilbert.digest_shards(docs).collect()
    sizes = Counter(r.shard for r in found)
    assert len(found) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    assert sorted(r.size for r in found) == sorted(len((t or "").encode()) + 8 for _, t in rows)
    assert hilbert.digest_shards(empty).count() == 0
    hilbert.write_shards(docs, str(tmp_path / "out"), 4)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(rows)


def sql_result(name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(queries.SQL[name])
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert compare((df.columns, [tuple(r) for r in df.collect()]), sql_result(name)) == "ok"


def test_mix_meets_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["__prob"] <= 1 for r in rows)
    assert mixing.sample_mix(empty).count() == 0


def test_sample_has_the_raked_token_shares(spark):
    texts = ["plain words only " * 7, "write to a.b@c soon " * 4]
    rows = [(i, texts[i % 10 == 0], ("en", "es", "de")[(i % 7 > 3) + (i % 20 == 0)], f"s{i % 9 == 0}", 0) for i in range(6000)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toArrow().to_pylist()
    sample = Counter(r.doc_id for r in mixing.sample_mix(spark.createDataFrame(rows, SCHEMA)).select("doc_id").collect())
    assert max(r["__weight"] for r in found) > 1.5 and all(abs(sample[r["doc_id"]] - r["__weight"]) < 1 for r in found)
    for dim in ("__source", "__lang", "__topic"):
        present, taken = Counter(), Counter()
        for r in found:
            present[r[dim]] += r["__tokens"]
            taken[r[dim]] += r["__tokens"] * sample[r["doc_id"]]
        target = {v: n**0.7 / sum(m**0.7 for m in present.values()) for v, n in present.items()}
        for value, share in target.items():
            assert taken[value] / sum(taken.values()) == pytest.approx(share, abs=0.02)


def test_hamming_ties_and_repeats(spark):
    codes = [(i, i % 5) for i in range(60)] + [(60, None), (None, 3), (7, 2)]
    rows = spark.createDataFrame(codes, "vec_id long, code long")
    found = hamming.search(rows, rows.filter("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.distance) for r in found] == [(0, 5, 0), (0, 10, 0), (0, 15, 0), (50, 0, 0), (50, 5, 0), (50, 10, 0)]


def test_empty_tables(empty):
    for result in (
        suffix_dedup.digest_repeats(empty), spotsigs.digest_fingerprints(empty), jaccard_join.digest_components(empty),
        licenses.digest_licenses(empty), bpe.digest_documents(empty, queries.vocabulary()),
    ):
        assert result.count() == 0


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r.token_ids) == r.n_tokens for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing", "BPE"]


def test_columns_with_inner_names_stay(spark, rows):
    """Input columns named like the operators' own ones."""
    names = ["__spans", "__K1", "__k2", "__words", "__Open"]
    few = [(i, t, *["kept"] * 5) for i, t in rows if i in (3, 1002, 1003, 1004, 1008)]
    df = spark.createDataFrame(few, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == ["doc_id", "text", *names, "removed_spans"]
    assert all(r[n] == "kept" for r in cut.collect() for n in names)
    plain = {(r.doc_id, r.text) for r in suffix_dedup.remove_repeats(df.select("doc_id", "text")).collect()}
    assert {(r.doc_id, r.text) for r in cut.collect()} == plain
    found = licenses.scan_licenses(df)
    assert found.columns == ["doc_id", "text", *names, "n_words", "base_places", "detections"]
    assert all(r[n] == "kept" for r in found.collect() for n in names) and found.count() == len(few)


def test_topics_equal_their_patterns(spark):
    texts = ["LICENSE", "a licence", "Copyright", "All Rights Reserved", "a|b", "me@x.org", "a @ b", "1234", "123", "", None, "é@é", "x@é", "License | 1234"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.lit("prose")
    for name, pattern in reversed(mixing.TOPICS):
        plain = F.when(F.col("text").rlike(pattern), name).otherwise(plain)
    for r in df.select("text", mixing.topic_of(F.col("text")).alias("a"), F.coalesce(plain, F.lit("prose")).alias("b")).collect():
        assert r.a == r.b, r.text


def test_search_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, code long")
    assert hamming.search(none, none).collect() == []


def test_labelled_texts_are_a_join_that_moves_only_labelled_texts(spark):
    """Ids with negative numbers, repeats, nulls and shared bits; unlabelled texts leave before the shuffle."""
    rows = [(i % 90 - 5, f"text é {i}" if i % 13 else None) for i in range(200)] + [(None, "no id"), (3, ""), (2**62, "far")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(-9, 60, 3)] + [(2**62, 1)], "doc_id long, label int")
    want = sorted(map(str, texts.join(known, "doc_id").select("doc_id", "text", "label").collect()))
    for bits in (7, 26):  # 128 bits: many ids share one
        found = toxicity.labelled_texts(texts, known, bits)
        assert sorted(map(str, found.collect())) == want
    written = found.sparkSession.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0])
    assert dict(written.dtypes)["text"] == "binary"  # what travels and is written is compressed
    assert toxicity.labelled_texts(texts, known.limit(0)).count() == 0
