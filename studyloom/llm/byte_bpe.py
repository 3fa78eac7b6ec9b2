"""Byte-level BPE with the tiktoken library, a rank file and raw-byte decoding.

Every worker reads the rank file (base64 token and rank per line) from ``ranks``, a path on its own installation,
constant in size. The splitting pattern cuts a text into matches that are merged one by one, so a text may be cut
before wherever a match must end, and each piece encoded on its own: memory and the pattern's stack then follow
the piece, not the text. Such safe boundaries are

* from a character that is no white space to white space, as no match runs into white space;
* between a letter and an ASCII digit, and from a letter or digit to other signs (not from signs to letters: a
  contraction such as 's is one match);
* around the longest match inside a run of white space, which is all of the run but its last character, or all of
  it at the end of the text.

A run of one class of characters without a boundary stays one piece. Tokens are bytes: ids decode to the
concatenated bytes, whether or not these are valid UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of the longest piece that is cut no further.
PIECE_CHARS = 1 << 15
#: Letters of every Unicode version, so that a boundary never depends on the version of a library.
LETTER = r"A-Za-zÀ-ÖØ-öø-ÿЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"
SIGN = r"!-/:-@\[-`{-~、。！，？"
BOUNDARY = (
    rf"(?<=\P{{White_Space}})(?=\p{{White_Space}})|(?<=[{LETTER}])(?=[0-9])|(?<=[0-9])(?=[{LETTER}])|(?<=[{LETTER}0-9])(?=[{SIGN}])"
)


@lru_cache(maxsize=8)
def _patterns(limit: int) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    return regex.compile(BOUNDARY), regex.compile("(?r)" + BOUNDARY), regex.compile(rf"\p{{White_Space}}{{{limit},}}")


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """The text in pieces whose encodings, one after the other, are that of the text; True marks a single match."""
    forward, backward, blanks = _patterns(limit)

    def cut(start: int, end: int) -> Iterator[tuple[str, bool]]:
        while end - start > limit:
            found = backward.search(text, start + 1, start + limit) or forward.search(text, start + limit, end)
            if found is None or found.start() >= end:
                break
            yield text[start : found.start()], False
            start = found.start()
        if start < end:
            yield text[start:end], False

    if len(text) <= limit:
        yield text, False
        return
    at = 0
    for run in blanks.finditer(text):
        yield from cut(at, run.start())
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    yield from cut(at, len(text))


class ByteBpe:
    """A tiktoken encoding from a local rank file; without special tokens."""

    def __init__(self, ranks: str, pattern: str, limit: int = PIECE_CHARS):
        with open(ranks, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        self.limit = limit
        self.encoding = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in rows}, special_tokens={}
        )

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.limit:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece, single in pieces(text, self.limit):
            ids += self.encoding._encode_single_piece(piece) if single else self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=2)
def byte_bpe(ranks: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def _with(df: DataFrame, source: str, added: str, make) -> DataFrame:
    """``df`` with the columns ``added`` (DDL), which ``make`` lists for the Python values of ``source``."""
    fields = StructType.fromDDL(added).fields
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    # arrays without names: the source may itself be one of the columns that are replaced
    packed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{source}`").alias("source"))
    schema = StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = make(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *columns], schema.fieldNames())

    return packed.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` array<int> and ``n_tokens`` long to every row.

    Null and empty texts have no tokens. Input columns of these two names are replaced, all others stay as they are.
    Rows are independent of each other: no shuffle, repeated rows stay repeated, an empty table stays empty.
    """

    def make(texts: list[str | None]) -> list[pa.Array]:
        bpe = byte_bpe(ranks, pattern)
        ids = [bpe.encode(t) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64())]

    return _with(docs, text, "token_ids array<int>, n_tokens long", make)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` binary, the bytes of the ids in ``ids``; null ids decode to null, no ids to no bytes."""

    def make(rows: list[list[int] | None]) -> list[pa.Array]:
        bpe = byte_bpe(ranks, pattern)
        return [pa.array([None if r is None else bpe.decode(r) for r in rows], pa.binary())]

    return _with(encoded, ids, "decoded binary", make)


def digest_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Digests of every row's ids and of the bytes they decode to, without moving either out of the worker.

    Output: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (raw bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in batches:
            n, ids, raw = [], [], []
            for text in batch.column(1).to_pylist():
                found = bpe.encode(text)
                n.append(len(found))
                ids.append(hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
                raw.append(hashlib.sha256(bpe.decode(found)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
