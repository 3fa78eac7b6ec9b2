"""Byte-level BPE, hard negatives and vector codes against the library and brute force."""

import glob
import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from check_oracle import compare
from studyloom.llm import byte_bpe, hard_negatives, queries, vector_codes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row string, planes int, whole string, code double"


# byte-level BPE


@pytest.fixture(scope="module")
def vocab():
    return queries.byte_vocabulary()


@pytest.fixture(scope="module")
def library(vocab):
    bpe = byte_bpe.ByteBpe(*vocab)
    return tiktoken.Encoding("test", pat_str=vocab[1], mergeable_ranks=bpe.encoding._mergeable_ranks, special_tokens={})


ODD = [
    "", None, " ", " \t\n ", "a  b", "x" * 700, "don't 'll we've  's", "12ab34 --'s?!", "é" * 300 + "ñandú 世界。你好，朋友 한국어 テスト", "\x1c\x1d a  b　c",
    "a\r\n\r\n  b", "‍👩‍👩‍👧 ﻿", "end   ", "<|endoftext|>", "\0\0",
]


@pytest.mark.parametrize("limit", [3, 17, 400])
def test_pieces_encode_as_the_whole(vocab, library, limit):
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null order by doc_id limit 60").fetchall()]
    rng = random.Random(limit)
    texts += ["".join(rng.choices("ab1 \n\t'’s.,!世。é ", k=600)) for _ in range(60)] + [t for t in ODD if t]
    bpe = byte_bpe.ByteBpe(*vocab, limit=limit)
    for text in texts:
        assert "".join(p for p, _ in byte_bpe.pieces(text, limit)) == text
        ids = bpe.encode(text)
        assert ids == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_giant_runs_are_encoded(vocab, library):
    bpe = byte_bpe.ByteBpe(*vocab)
    for text in (" " * 1_000_000 + "x", "a" * 200_000, "word " * 100_000, "x" + "\n" * 400_000):
        assert bpe.decode(bpe.encode(text)) == text.encode()
    for text in (" " * 40_000 + "x y", "x " + " " * 40_000, " \n" * 20_000 + "1"):
        assert bpe.encode(text) == library.encode_ordinary(text)


def test_byte_bpe_operators(spark, vocab, library):
    rows = [(i, t, "kept", [7], i) for i, t in enumerate(ODD)] + [(3, "again", "k", None, 0), (3, "again", "k", None, 0), (None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, c0 string, token_ids array<int>, source int")
    want = [library.encode_ordinary(t or "") for _, t, *_ in rows]
    coded = byte_bpe.encode_documents(docs, *vocab)
    assert coded.columns == ["doc_id", "text", "c0", "source", "token_ids", "n_tokens"]
    back = byte_bpe.decode_documents(coded, *vocab).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted([(r.doc_id, r.text or "", r.c0, r.token_ids, r.n_tokens, bytes(r.decoded)) for r in back], key=key) == sorted(
        [(i, t or "", c, ids, len(ids), (t or "").encode()) for (i, t, c, *_), ids in zip(rows, want)], key=key
    )
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = byte_bpe.digest_documents(docs, *vocab).collect()
    assert sorted([tuple(r) for r in digests], key=str) == sorted(
        [(i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for (i, t, *_), ids in zip(rows, want)], key=str
    )
    none = docs.filter("false")
    assert byte_bpe.encode_documents(none, *vocab).count() == byte_bpe.digest_documents(none, *vocab).count() == 0
    nulls = byte_bpe.decode_documents(docs.withColumn("token_ids", F.lit(None).cast("array<int>")), *vocab)
    assert {r.decoded for r in nulls.collect()} == {None}


# hard negatives and vector codes


def vectors(n=260, dims=13, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0.3, 0.05, (4, dims))
    label = [1 if i % 3 else int(rng.integers(4)) for i in range(n)]  # label 1 has most rows
    rows = [(i, [float(x) for x in centers[k] + rng.normal(0, 0.3, dims)], k) for i, k in enumerate(label)]
    same = rows[20][1]
    rows = [(i, same if i % 5 == 2 else v, k) for i, v, k in rows]  # a frequent vector
    rows += [(n, None, 1), (n + 1, rows[0][1], None), (n + 2, [None, *rows[0][1][1:]], 1), (n + 3, [float("nan")] * dims, 2), (n + 4, [float("inf")] * dims, 2)]
    rows += [rows[40], rows[40], rows[7], (None, rows[9][1], 2), (400, [], 1), (401, rows[3][1][:5], 0), (-20, [-1.5] * dims, 3), (-3, [3000.25] * dims, 1)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]


def taking_part(rows, scale):
    good = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(x * scale) for x in v], k) for i, v, k in good]


def brute_negatives(rows, positives=5, negatives=5):
    rows = [r for r in taking_part(rows, 256) if r[0] is not None and r[2] is not None]
    out = []
    for a, (i, v, k) in enumerate(rows):
        if i % 20:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, q) for b, (j, w, q) in enumerate(rows) if b != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == k][:positives]:
            hard = [s for s in scored if s[2] != k and 80 * p <= 100 * s[0] <= 100 * p][:negatives]
            out += [(i, j, r, s[1], p, s[0]) for r, s in enumerate(hard, 1)]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "r", 1, "w", 0.5) for r in rows], VECTORS).repartition(parts)


@pytest.mark.parametrize("block", [(4096, 512), (40, 3)])
def test_hard_negatives(spark, block):
    rows = vectors()
    want = brute_negatives(rows)
    found = hard_negatives.mine_hard_negatives(frame(spark, rows), F.expr("vec_id % 20 = 0"), block=block)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert len({w[0] for w in want}) > 8 and len(want) > 100


def test_hard_negatives_without_rows(spark):
    rows = vectors()
    for part, anchors in ((rows[:0], "vec_id % 20 = 0"), (rows, "vec_id = 12345"), (rows, "cast(null as boolean)"), (rows[:1], "true")):
        assert hard_negatives.mine_hard_negatives(frame(spark, part, 2), F.expr(anchors)).collect() == []


def test_planes_give_exact_products():
    rng = np.random.default_rng(3)
    for high, dims in ((3, 8), (200, 13), (2**20, 64), (2**27, 5)):
        cand, anch = (rng.integers(-high, high, (n, dims)) for n in (50, 70))
        stack = lambda m: hard_negatives.stack_planes(hard_negatives.pack_planes(m), np.full(len(m), dims), -(-dims // 8))
        planes, back = stack(cand), hard_negatives.unpack_planes(stack(anch))
        assert (back.reshape(-1, 70)[:dims].T == anch).all()
        found = np.concatenate([s for _, s in hard_negatives.scores(planes, back)], axis=1)
        assert (found == cand @ anch.T).all()


def brute_codes(rows, parts, entries, rounds, scale=1024):
    rows = taking_part(rows, scale)
    dims = max((len(v) for _, v, _ in rows), default=0)
    width = -(-dims // parts)
    rows = [(i, v + [0] * (parts * width - len(v)), k, tuple(v)) for i, v, k in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: [min((gap(part, e), k) for k, e in enumerate(book)) for part, book in zip(cut(v), books)]
    for _ in range(rounds):
        chosen = [near(r[1]) for r in rows]
        moved = []
        for p, book in enumerate(books):
            members = [[cut(r[1])[p] for r, c in zip(rows, chosen) if c[p][1] == k] for k in range(len(book))]
            moved.append([[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, book)])
        books = moved
    coded = [(r, near(r[1])) for r in rows]
    error = [sum(d for d, _ in c) for _, c in coded]
    of = {k: sum(e for e, (r, _) in zip(error, coded) if r[2] == k) for k in {r[2] for r in rows}}
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{k:02x}" for _, k in c), e, of[r[2]], sha) for (r, c), e in zip(coded, error)], key=str)


@pytest.mark.parametrize("parts,entries,bits,memo", [(4, 16, 5, 1 << 14), (3, 40, 7, 3), (13, 2, 2, 0), (4, 256, 9, 100)])
def test_vector_codes(spark, monkeypatch, parts, entries, bits, memo):
    monkeypatch.setattr(vector_codes.CellSearch.__init__, "__defaults__", (memo,))
    rows = vectors(140)
    found = vector_codes.digest_codes(frame(spark, rows), parts, entries, 3, bits).collect()
    assert sorted([tuple(r) for r in found], key=str) == brute_codes(rows, parts, entries, 3)


def test_cell_search_is_exact_and_prunes():
    rng = np.random.default_rng(8)
    book, parts = rng.integers(-300, 300, (256, 16)), rng.integers(-300, 300, (500, 16))
    book[9] = book[200]
    parts[:100] = parts[100]
    parts[7] = book[9]
    search = vector_codes.CellSearch(book, 5)
    entry, distance = search.nearest(parts)
    full = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all() and entry[7] == 9
    assert len(search.memo) <= 402 and np.mean([len(x) for x in search.memo.values()]) < 100


def test_vector_codes_round_trip_and_odd_tables(spark):
    rows = frame(spark, vectors(140))
    whole = vector_codes.whole_vectors(rows, 1024.0)
    books = vector_codes.fit_codebooks(whole, entries=64)
    coded = vector_codes.encode_vectors(whole.withColumn("code", F.lit(1)), books)
    assert coded.columns == ["vec_id", "label", "code", "error"]
    back = vector_codes.decode_codes(coded.withColumn("vector", F.lit(0)), books).join(whole.withColumnRenamed("whole", "w"), "vec_id").filter("vec_id between 50 and 130")
    for r in back.collect():
        gap = sum((round(x * 1024) - y) ** 2 for x, y in zip(r.vector, r.w))
        assert gap == r.error
    none = rows.filter("false")
    assert vector_codes.digest_codes(none).collect() == []
    assert {r.code for r in vector_codes.encode_vectors(whole, vector_codes.fit_codebooks(none.select("vec_id", "label", F.array().cast("array<long>").alias("whole")))).collect()} == {None}
    blank = spark.createDataFrame([(1, [], 1), (2, [], None), (2, None, 3)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r)[:4] for r in sorted(vector_codes.digest_codes(blank).collect())] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_vector_codes"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.SQL[name])
    assert compare((df.columns, [tuple(r) for r in df.collect()]), ([d[0] for d in found.description], found.fetchall())) == "ok"
