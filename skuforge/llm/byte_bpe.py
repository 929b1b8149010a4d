"""Byte-level BPE by a monoid tree: encode(x + y) is made from encode(x) and encode(y).

A text is halved until a leaf is short. Two neighbours are joined by encoding a window about their border again. The
window grows until both its ends lie where a match of the pattern provably ends, whatever stands further away: between
a letter, digit or mark and a following space or line feed. Tokens outside the window are then final. Inside one very
long match, where no such place exists, the window grows by tokens instead until the pair of tokens on either of its
edges is compatible: the two tokens' bytes, encoded alone, give these two tokens. A sequence all of whose neighbours are
compatible is the encoding (every token of the vocabulary encodes to itself, which is checked when it is loaded).

Each text is encoded where it lies; nothing is shuffled. Memory is bounded by one text and its tokens.

Cases: null text counts as empty (no tokens, hashes of the empty string); texts of any length; null doc_id and repeated
rows give a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import id_long, id_text, small_batches, table, text_or_empty

#: Characters of a leaf, and tokens of one when decoding.
LEAF = 96
#: Bytes of a leaf within one long match of the pattern.
PIECE_LEAF = 64
#: Characters of a window about a border within which a safe place is sought before a long match is suspected.
LONG = 4096
SCHEMA = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+"))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = [0] * (max(self.bytes_of, default=-1) + 1)
        for r, b in self.bytes_of.items():
            self.length[r] = len(b)
        self.piece = self.enc._encode_single_piece
        self.plain = self.enc._core_bpe.encode_ordinary
        self.proper = all(self.piece(b) == [r] for b, r in ranks.items())
        self.names = {r: str(r) for r in ranks.values()}

    @functools.lru_cache(maxsize=200_000)
    def compatible(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _before(text: str, lo: int, mid: int) -> int:
    """The last safe place in (lo, mid], or lo: a space or line feed after a letter, digit or mark of one."""
    reach = 32
    while True:
        least = max(lo, mid - reach)
        at = max(text.rfind(" ", least, mid + 1), text.rfind("\n", least, mid + 1))
        while at > least and not text[at - 1].isalnum():
            at = max(text.rfind(" ", least, at), text.rfind("\n", least, at))
        if at > least:
            return at
        if least == lo:
            return lo
        reach *= 4


def _after(text: str, mid: int, hi: int) -> int:
    """The first safe place in [mid, hi), or hi."""
    reach = 32
    while True:
        most = min(hi, mid + reach)
        at = mid
        while at < most:
            x, y = text.find(" ", at, most), text.find("\n", at, most)
            at = min(x, y) if x >= 0 and y >= 0 else max(x, y)
            if at < 0:
                break
            if at and text[at - 1].isalnum():
                return at
            at += 1
        if most == hi:
            return hi
        reach *= 4


def _last_tokens(v: Vocabulary, ids: list[int], n: int) -> int:
    """How many of the last tokens have n bytes together."""
    k = len(ids)
    while n > 0:
        k -= 1
        n -= v.length[ids[k]]
    assert n == 0
    return len(ids) - k


def _first_tokens(v: Vocabulary, ids: list[int], n: int) -> int:
    k = 0
    while n > 0:
        n -= v.length[ids[k]]
        k += 1
    assert n == 0
    return k


def join_pieces(v: Vocabulary, left: list[int], right: list[int]) -> list[int]:
    """Of the tokens of two parts of one match, those of the whole."""
    k = 4
    while True:
        i, j = max(0, len(left) - k), min(len(right), k)
        window = v.piece(b"".join(v.bytes_of[t] for t in left[i:] + right[:j]))
        if v.proper and (i == 0 or v.compatible(left[i - 1], window[0])) and (j == len(right) or v.compatible(window[-1], right[j])):
            return left[:i] + window + right[j:]
        if i == 0 and j == len(right):
            return window
        k *= 2


def encode_piece(v: Vocabulary, piece: bytes) -> list[int]:
    """One match of the pattern, by halves."""
    if len(piece) <= PIECE_LEAF:
        return v.piece(piece)
    mid = len(piece) // 2
    return join_pieces(v, encode_piece(v, piece[:mid]), encode_piece(v, piece[mid:]))


def _window(v: Vocabulary, part: str) -> list[int]:
    """Tokens of a window. A long one holds a long match, whose encoding is by halves too."""
    if len(part) <= 4 * LONG:
        return v.plain(part)
    out: list[int] = []
    for m in v.pattern.finditer(part):
        out += encode_piece(v, m.group().encode())
    return out


def encode(v: Vocabulary, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
    """The tokens of text[lo:hi] alone."""
    hi = len(text) if hi is None else hi
    if hi - lo <= LEAF:
        return v.plain(text[lo:hi])
    mid = lo + LEAF * ((hi - lo + LEAF - 1) // LEAF // 2)  # halves of whole leaves
    a, b = _before(text, lo, mid), _after(text, mid, hi)
    if b - a > 2 * LONG and (a == lo or b == hi):
        return _window(v, text[lo:hi])  # one match fills most of it
    left, right = encode(v, text, lo, mid), encode(v, text, mid, hi)
    if a == b:  # the border itself is a safe place
        return left + right
    i = len(left) - _last_tokens(v, left, len(text[a:mid].encode()))
    j = _first_tokens(v, right, len(text[mid:b].encode()))
    left[i:] = _window(v, text[a:b]) + right[j:]
    return left


def decode(v: Vocabulary, ids: list[int]) -> bytes:
    """Halves decode apart and concatenate."""
    if len(ids) <= LEAF:
        return b"".join(map(v.bytes_of.__getitem__, ids))
    mid = LEAF * ((len(ids) + LEAF - 1) // LEAF // 2)
    return decode(v, ids[:mid]) + decode(v, ids[mid:])


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [encode(v, t) for t in pdf["text"]]})

    return id_long(docs.select(id_text(), text_or_empty().alias("text")).mapInPandas(run, "doc_id string, ids array<int>"))


def encode_digests(docs: DataFrame, path: str, pattern: str, place: str | None = None) -> DataFrame:
    """Encodes, decodes, and returns counts and digests of both for every row, and its long in column ``place`` if one is named."""
    places = [place] if place else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for pdf in batches:
            n, ids_sha, text_sha = [], [], []
            for t in pdf["text"]:
                ids = encode(v, t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(v.names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode(v, ids)).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha} | {p: pdf[p] for p in places})

    rows = docs.select(id_text(), text_or_empty().alias("text"), *places)
    return id_long(rows.mapInPandas(run, ", ".join([SCHEMA, *(f"{p} long" for p in places)])))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers as public

    small_batches(spark)
    return encode_digests(table(spark, sf_dir, "documents"), path or public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
