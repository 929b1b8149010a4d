"""Similarity of texts (Indel ratios) and vectors.

The ratio of two texts is 100 * 2 * LCS / (len a + len b); two empty texts are alike (100), one empty text is like none (0).
The longest common subsequence is computed with bit operations on whole integers, in Arrow batches. Callers deduplicate
pairs first and bound candidates losslessly, see ``length_bound`` and ``grams``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one addition and a few bit operations for each character of b."""
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text and a window of the longer one, of its length or cut at an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    if a in b:
        return 100.0
    return max(indel(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)))


def sorted_tokens(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort(a: str, b: str) -> float:
    return indel(sorted_tokens(a), sorted_tokens(b))


def typo_aligned(a: str, b: str, least: int = 5, cutoff: float = 80.0) -> float:
    """Token-sorted ratio after each word of a became the first word of b that it is a likely misspelling of."""
    theirs = b.split()
    ours = [next((y for y in theirs if len(x) >= least and len(y) >= least and indel(x, y) >= cutoff), x) for x in a.split()]
    return token_sort(" ".join(ours), b)


def _pairwise(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in memo:
                memo[pair] = f(*pair)
            out.append(memo[pair])
        return pd.Series(out, dtype=float)

    return run


ratio = _pairwise(indel)
partial_ratio = _pairwise(partial)
token_sort_ratio = _pairwise(token_sort)
typo_ratio = _pairwise(typo_aligned)


def length_bound(a: Column, b: Column, cutoff: float) -> Column:
    """Necessary for ratio >= cutoff: the longer text can share no more characters than the shorter one has."""
    la, lb = F.length(a), F.length(b)
    return 200.0 * F.least(la, lb) >= cutoff * (la + lb)


def grams(text: Column, q: int = 2) -> Column:
    """Distinct character q-grams of a text padded at both ends; empty texts have the gram of padding alone."""
    padded = F.concat(F.repeat(F.lit("\u0002"), q - 1), text, F.repeat(F.lit("\u0003"), q - 1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - q + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(q))))


def numbered_grams(text: Column, q: int = 2) -> Column:
    """All q-grams of a padded text, each with the number of its occurrence, so that arrays intersect as multisets."""
    padded = F.concat(F.repeat(F.lit("\u0002"), q - 1), text, F.repeat(F.lit("\u0003"), q - 1))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - q + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(q)))
    return F.transform(every, lambda g, i: F.concat(g, F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def shared_bound(a: Column, b: Column, shared: Column, cutoff: float, q: int) -> Column:
    """Necessary for ratio >= cutoff: each of at most (1 - cutoff / 100)(la + lb) edits breaks at most q grams of the longer text."""
    la, lb = F.length(a), F.length(b)
    edits = F.floor((1 - cutoff / 100) * (la + lb) + 1e-9)
    return shared >= F.greatest(la, lb) + (q - 1) - q * edits


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, where the value is computed once, however often ``then`` has it: a lambda's body is evaluated for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalized(a: Column) -> Column:
    scaled = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return bound(a, lambda v: bound(norm(v), lambda n: scaled(v, n)))


def softmax(scores: Column, temperature: float) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def sigmoid(x: Column, slope: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-slope * x))
