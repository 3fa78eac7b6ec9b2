"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves; leaf i holds the rank of the pair that symbol i forms with the next live
symbol. The root names the leftmost pair of lowest rank. A merge changes at most three leaves, each written
with a logarithmic number of steps, until no pair has a rank. Words repeat, so each worker keeps the result of
recent words in a cache of bounded size; the vocabulary file is read by every worker from ``vocab``, a path on
its own installation, and is constant in size.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CACHE_WORDS = 300_000
COUNT, IDS, TOKENS = itemgetter(0), itemgetter(1), itemgetter(2)
EMPTY = (0, "", "")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    hidden = (b for b in range(256) if b not in shown)
    return shown | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairTree:
    """Segment tree of minima over the places of a word's symbols, as a flat list with the root at 1.

    A leaf is ``rank * size + place``, so the smaller of two leaves is the lower rank and, for equal ranks, the
    place further left. ``none`` is a rank above all others and stands for a pair that does not merge.
    """

    __slots__ = ("size", "node", "limit", "none")

    def __init__(self, ranks: list[int], none: int):
        size = 1 << (len(ranks) - 1).bit_length()
        self.size, self.limit, self.none = size, none * size, none
        row = [rank * size + place for place, rank in enumerate(ranks)]
        row += [self.limit] * (size - len(row))
        rows = [row]
        while len(row) > 1:
            row = [x if x < y else y for x, y in zip(row[::2], row[1::2])]
            rows.append(row)
        self.node = [0]
        for row in reversed(rows):
            self.node += row

    def put(self, place: int, rank: int) -> None:
        """Writes one leaf and the minima above it, up to the first that stays as it is."""
        node, i = self.node, self.size + place
        least = rank * self.size + place
        while node[i] != least:
            node[i] = least
            if i == 1:
                return
            other = node[i ^ 1]
            if other < least:
                least = other
            i >>= 1


class Tokenizer:
    """Encodes and decodes with the vocabulary, merges and patterns of a tokenizer file.

    Understands files with the normalizers NFC, white space to one blank and lower case, one splitting pattern,
    byte-level symbols, a word-end suffix and no decoder (decoding joins the tokens with blanks). Letters that
    entered Unicode after the version of the ``regex`` package or of Python's tables may be split otherwise than
    by the tokenizers library.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in reversed(list(enumerate(pairs)))}
        self.none = len(pairs)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split, regex.V0)
        self.blank = regex.compile(r"\s+")
        #: control characters that str.split() takes for blanks and the pattern does not
        self.odd_blank = regex.compile(r"[\x1c-\x1f]")
        self.special = regex.compile("|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)) or r"(?!)")
        self.letters = byte_alphabet()
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.cache_words = cache_words

    def merge(self, symbols: list[str]) -> list[str]:
        """Applies the merges to a word's symbols, lowest rank first and leftmost among equal ranks."""
        n = len(symbols)
        if n < 2:
            return symbols
        get, none, text = self.rank.get, self.none, list(symbols)
        tree = PairTree([get(pair, none) for pair in zip(text, text[1:])], none)
        node, put, size, limit = tree.node, tree.put, tree.size, tree.limit
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        while (least := node[1]) < limit:
            place = least % size
            gone = after[place]
            text[place] = joined = text[place] + text[gone]
            follow, ahead = after[gone], before[place]
            after[place] = follow
            if follow >= 0:
                before[follow] = place
                put(gone, none)
                put(place, get((joined, text[follow]), none))
            else:
                put(place, none)
            if ahead >= 0:
                put(ahead, get((text[ahead], joined), none))
        out, i = [], 0
        while i >= 0:
            out.append(text[i])
            i = after[i]
        return out

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of tokens, ids and decoded tokens (both joined by blanks) of a piece of text without blanks."""
        found = self.older.get(word)
        if found is None:
            tokens: list[str] = []
            for part in filter(None, self.split.findall(word)):
                symbols = [self.letters[b] for b in part.encode("utf-8")]
                symbols[-1] += self.suffix
                tokens += self.merge(symbols)
            found = len(tokens), " ".join([str(self.vocab[t]) for t in tokens]), " ".join(tokens)
        if len(self.cache) >= self.cache_words:
            self.older, self.cache = self.cache, {}
        self.cache[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """The normalized text cut at blanks, which no token spans."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower case is taken letter by letter: str.lower() alone writes a final sigma differently
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return self.blank.sub(" ", text).split(" ") if self.odd_blank.search(text) else text.split()

    def encode_joined(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by blanks and decoded text."""
        parts: list[tuple[int, str, str]] = []
        at = 0
        for special in self.special.finditer(text) if "<|" in text else ():
            parts += self._found(text[at : special.start()])
            parts.append((1, str(self.added[special[0]]), special[0]))
            at = special.end()
        parts += self._found(text[at:] if at else text)
        return sum(map(COUNT, parts)), " ".join(map(IDS, parts)), " ".join(map(TOKENS, parts))

    def _found(self, text: str) -> list[tuple[int, str, str]]:
        words = self.words(text)
        found = list(map(self.cache.get, words))
        if None in found:
            found = [f or self.cache.get(w) or self.word(w) for f, w in zip(found, words)]
        return [f for f in found if f[0]] if EMPTY in found else found

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_joined(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_documents(docs: DataFrame, vocab: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds to every row its token ids, and the text they decode to.

    Output: the input columns (without ``text`` if ``keep_text`` is false), ``token_ids`` array<int>, ``n_tokens``
    long, ``decoded`` string. Null and empty texts have no tokens and decode to the empty string. Input columns
    with one of these names are replaced. Rows are independent: no shuffle, repeated rows stay repeated.
    """
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "decoded") and (keep_text or c != text)]
    if text not in kept:
        docs = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
        text = "__text"
    else:
        docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    names = [c for c in docs.columns if c != "__text"]
    added = StructType.fromDDL("token_ids array<int>, n_tokens long, decoded string").fields
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in names]).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocab)
        for batch in batches:
            found = [tok.encode_joined(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = pa.array([list(map(int, f[1].split())) for f in found], pa.list_(pa.int32()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [ids, pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "token_ids", "n_tokens", "decoded"])

    return docs.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, vocab: str) -> DataFrame:
    """Digests of what ``encode_documents`` makes of every row, without moving the ids out of the worker.

    Output: doc_id, n_tokens, ids_sha256 (decimal ids joined by one blank), decoded_sha256 (UTF-8).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocab)
        for batch in batches:
            found = [tok.encode_joined(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found], pa.string()),
                    pa.array([hashlib.sha256(f[2].encode()).hexdigest() for f in found], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
