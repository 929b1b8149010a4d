"""Token counts of whole texts, with a shortcut for pre-tokens that are provably one token.

Offline, every string of the vocabulary that is one pre-token is given to the merges alone. Where they yield one token, a text's
pre-token equal to it counts one, since pre-tokens are encoded independently. The proved set is as large as the vocabulary at
most, so it is broadcast. Other pre-tokens are merged by the library's model, without a second normalisation (a lower-cased text
need not be in normal form), once each while they stay in a worker's bounded memory of counts.

Nothing is shuffled. Long texts are cut at places that no pre-token or normalisation crosses (before a space that
follows a letter or digit), so memory is bounded by the longest run without one.

Cases: null text counts as empty (0 tokens); texts that hold special strings of the vocabulary, or young characters that databases
differ on, are counted by the library as a whole;
null doc_id and repeated rows give a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_long, id_text, small_batches, table, text_or_empty

CUT = 1 << 16
MEMO = 400_000
SCHEMA = "doc_id string, n_bytes long, n_tokens long, over_limit boolean"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=2)
def merger(path: str):
    """The vocabulary's merges alone: a string is taken as one pre-token as it stands, neither normalised nor cut again."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer(tokenizer(path).model)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return t


def _pattern(path: str):
    """The vocabulary file's own pattern of pre-tokens."""
    import regex

    with open(path) as f:
        split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return regex.compile(split.replace(r"\s", r"\p{White_Space}"))


def whole_tokens(path: str) -> frozenset[str]:
    """Strings that, as a pre-token, are proved to be one token."""
    t, pattern = merger(path), _pattern(path)
    with open(path) as f:
        spec = json.load(f)["model"]
    end = spec["end_of_word_suffix"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
    others = [b for b in range(256) if b not in plain]  # the others follow from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    found = []
    for s in spec["vocab"]:
        if s.endswith(end):
            try:
                found.append(bytes(byte[c] for c in s[: -len(end)]).decode())
            except (UnicodeDecodeError, KeyError):
                pass
    found = [s for s in found if s and normalise(s) == s and pattern.findall(s) == [s]]
    return frozenset(s for s, e in zip(found, t.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


_LOWER: dict[int, str] = {}


def normalise(text: str) -> str:
    """NFC, then each character's own lower case (white space of any kind separates pre-tokens as one space does)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def _settled(c: str) -> bool:
    """Not so are characters that Python's database doesn't know, and combining marks younger than its old one (3.2): libraries may know other ones."""
    kind = unicodedata.category(c)
    return kind != "Cn" and (kind[0] != "M" or unicodedata.ucd_3_2_0.category(c) != "Cn")


def _parts(text: str) -> Iterator[str]:
    lo, n = 0, len(text)
    while n - lo > CUT:
        hi = lo + CUT
        while hi < n and not (text[hi] == " " and text[hi - 1].isalnum()):
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


class Counter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.library, self.merges, self.pattern = tokenizer(path), merger(path), _pattern(path)
        self.special = list(self.library.get_added_tokens_decoder().values())
        self.special = [s.content for s in self.special]
        self.whole, self.memo, self.known = whole, {}, set()

    def _rest(self, words: set[str]) -> None:
        words = list(words)
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        for w, e in zip(words, self.merges.encode_batch(words, add_special_tokens=False), strict=True):
            self.memo[w] = len(e.ids)

    def _settled(self, text: str) -> bool:
        """Distinct characters are looked up once a worker."""
        new = set(text) - self.known
        odd = {c for c in new if not _settled(c)}
        self.known |= new - odd
        return not odd

    def count(self, text: str) -> int:
        if any(s in text for s in self.special) or (not text.isascii() and not self._settled(text)):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        total = 0
        for part in _parts(text):
            words = self.pattern.findall(normalise(part))
            rest = [w for w in words if w not in self.whole]
            total += len(words) - len(rest)
            new = {w for w in rest if w not in self.memo}
            if new:
                self._rest(new)
            lacking = [w for w in rest if w not in self.memo]
            if lacking:  # the memory was emptied meanwhile
                self._rest(set(rest))
            total += sum(map(self.memo.__getitem__, rest))
        return total


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text has more than ``limit`` tokens, for every row."""
    small_batches(spark)
    whole = spark.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(path, whole.value)
        for pdf in batches:
            n = [counter.count(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]})

    rows = docs.select(id_text(), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return id_long(rows.mapInPandas(run, SCHEMA))


def op3_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers as public

    return token_counts(spark, table(spark, sf_dir, "documents"), path or public.path("word_bpe_49k.json"))
