"""All pairs of texts whose Indel ratio reaches a cutoff, found by a prefix filter over character bags.

At ratio c two texts share c / 200 of their joint length as a common subsequence, so at least as many numbered characters ('e', the
second 'e', ...). Sort each text's numbered characters by rarity over all texts. If two texts share O of them, the first k
shared ones stand within the first l - O + k of either. So the chain of a pair's first shared characters is made by both texts, and
any rule that ends chains by the chain alone finds the pair. A chain ends where few texts are expected to have it, and goes on, up to
LONGEST characters, where more do than LIMIT and SHARE allow, as expected first and then by count. So a character that many
texts hold is no key of the join, and no pair is lost.

Of a pair, the shorter text needs a shorter prefix than the longer one, so chains carry whether they are short enough for that.
Keys are 64-bit hashes of chains: a collision adds a candidate and its count, for both sides alike. Candidates within the length bound are
made distinct and scored once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, LongType

from skuforge.functions import similarity as S
from skuforge.sources.shared import checkpointed

#: A chain is a key if at most so many texts have it, or this share of all; longer chains than LONGEST cost more keys than they save.
LIMIT, SHARE, LONGEST = 200, 0.002, 5
#: Of so few texts in all, single characters are keys: any of them meets few others.
FEW = 4000
KEY = "text string, key long, depth int, last int, size int, least int, small boolean, grown boolean"


def required(cutoff: float, also: tuple[float, float] | None = None) -> Callable[[int, int], int]:
    """The number of characters that texts of two lengths share at least. also: another cutoff, and by how many characters pairs may fall short of it."""

    def shared(n: int, m: int) -> int:
        least = cutoff * (n + m) / 200
        if also:
            least = max(least, also[0] * (n + m) / 200 - also[1])
        return math.ceil(least - 1e-9)

    return shared


def _bounds(n: int, cutoff: float, shared: Callable[[int, int], int]) -> tuple[int, int]:
    """Characters that a text of length n shares at least with any partner that is no shorter, and with any partner."""
    low, high = max(1, math.ceil(n * cutoff / (200 - cutoff) - 1e-9)), math.floor(n * (200 - cutoff) / cutoff + 1e-9)
    longer = min(shared(n, m) for m in range(n, high + 1))
    return longer, min([longer, *(shared(n, m) for m in range(low, n))])


def _step(key: int, token: int) -> int:
    x = (key ^ token) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 29


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


@F.pandas_udf(ArrayType(LongType()))
def numbered_characters(text: pd.Series) -> pd.Series:
    """Each character with the number of its occurrence; one pass over a text."""

    def of(t: str) -> list[int]:
        seen: dict[str, int] = {}
        out = []
        for ch in t:
            seen[ch] = seen.get(ch, 0) + 1
            out.append(ord(ch) << 32 | seen[ch])
        return out

    return text.map(of)


def _chains(cutoff: float, shared: Callable[[int], int], texts: int, limit: float):
    """Rows of text, tokens (by rarity), counts of tokens, and a chain (key, depth, last) that so many texts (met) have, to rows of KEY."""

    def of(text: str, tokens: list[int], counts: list[int], key: int, depth: int, last: int, met: float, bounds: tuple[int, int]) -> Iterator[tuple]:
        n, size, (with_longer, least) = len(text), len(tokens), bounds
        if least <= 0:  # partners need share nothing: all such texts meet
            yield text, 0, 0, -1, n, least, True, True
            return
        left = [(key & 0xFFFFFFFFFFFFFFFF, depth, last, met)]
        while left:
            key, depth, last, met = left.pop()
            for at in range(last + 1, min(size, size - least + depth + 1)):
                longer, expected = _step(key, tokens[at]), met * counts[at] / texts
                grows = expected > limit and depth + 1 < LONGEST
                if not grows or depth + 1 >= least:  # a chain that is all a pair need share is a key beside the longer ones
                    yield text, _signed(longer), depth + 1, at, n, least, at - depth <= size - with_longer, grows
                if grows:
                    left.append((longer, depth + 1, at, expected))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[int, int]] = {}
        for pdf in batches:
            rows: list[tuple] = []
            for row in zip(*(pdf[c].tolist() for c in ("text", "tokens", "counts", "key", "depth", "last", "met")), strict=True):
                n = len(row[0])
                if n not in known:
                    known[n] = _bounds(n, cutoff, shared)
                rows.extend(of(row[0], list(map(int, row[1])), list(map(int, row[2])), *row[3:], known[n]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in KEY.split(", ")])

    return run


def keys_of(sides: DataFrame, cutoff: float, shared: Callable[[int], int], limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """text, key, size, small (and more): the keys by which each distinct text of ``sides`` (column text) meets others."""
    texts = sides.filter("text <> ''").distinct()
    total = texts.count()
    few = total <= FEW
    most = math.inf if few else max(limit, total * share)
    each = texts.select("text", F.explode(numbered_characters("text")).alias("token"))
    each = each if few else checkpointed(each)
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(counts, "token").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    ordered = ordered.select("text", F.transform("t", lambda x: x["token"]).alias("tokens"), F.transform("t", lambda x: x["n"]).alias("counts"))
    ordered = ordered if few else checkpointed(ordered)
    run = _chains(cutoff, shared, max(total, 1), most)
    start = ordered.select("*", F.lit(0).cast("long").alias("key"), F.lit(0).alias("depth"), F.lit(-1).alias("last"), F.lit(float(total)).alias("met"))
    new, kept = start.mapInPandas(run, KEY), None
    if few:
        return new
    new = checkpointed(new)
    while True:
        # chains that more texts have than expected: their lengths grow by one a round at least
        met = new.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).cast("double").alias("met")).filter(F.col("met") > most)
        counted = new.join(met, F.col("key") == F.col("of"), "left").drop("of")
        on = F.col("met").isNotNull() & ~F.col("grown") & (F.col("depth") < LONGEST)
        hot = checkpointed(counted.filter(on).drop("small", "grown"))
        ends = new if hot.isEmpty() else checkpointed(counted.filter(~on | (F.col("least") <= F.col("depth"))).drop("met"))
        kept = ends if kept is None else kept.unionByName(ends)
        if ends is new:
            return kept
        longer = hot.withColumnRenamed("text", "t").join(ordered, F.col("t") == F.col("text"))
        new = checkpointed(longer.select("text", "tokens", "counts", "key", "depth", "last", "met").mapInPandas(run, KEY))


def candidates(texts: DataFrame, choices: DataFrame, cutoff: float, also: tuple[float, float] | None = None, limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """_a, _b: distinct pairs among which all alike ones are. texts: _a, choices: _b; both distinct."""
    both = texts.select(F.col("_a").alias("text")).union(choices.select(F.col("_b").alias("text")))
    keys = checkpointed(keys_of(both, cutoff, required(cutoff, also), limit, share).select("text", "key", "size", "small").distinct())  # read by both sides
    side = lambda df, c: keys.join(df, F.col("text") == F.col(c)).select(c, "key", F.col("size").alias(f"n{c}"), F.col("small").alias(f"small{c}"))
    # of two texts the shorter one's chain stands within its shorter prefix
    pairs = side(texts, "_a").join(side(choices, "_b"), "key")
    na, nb = F.col("n_a"), F.col("n_b")
    in_prefix = F.when(na > nb, F.col("small_b")).when(na < nb, F.col("small_a")).otherwise(F.col("small_a") & F.col("small_b"))
    within = 200.0 * F.least(na, nb) >= cutoff * (na + nb)
    return pairs.filter(within & in_prefix).select("_a", "_b").distinct()


def alike(texts: DataFrame, choices: DataFrame, text: str, choice: str, cutoff: float, also: tuple[float, float] | None = None) -> DataFrame:
    """_a, _b, ratio: all pairs of distinct texts and choices that are at least ``cutoff`` alike.

    also: another cutoff and a number of characters, where only pairs count that share as many characters as that cutoff asks for, less that number.
    """
    a = texts.select(F.col(text).alias("_a")).filter("_a IS NOT NULL").distinct()
    b = choices.select(F.col(choice).alias("_b")).filter("_b IS NOT NULL").distinct()
    empty = a.filter("_a = ''").join(b.filter("_b = ''"), F.col("_a") == F.col("_b"))
    pairs = candidates(a, b, cutoff, also).unionByName(empty)
    return pairs.withColumn("ratio", S.ratio("_a", "_b")).filter(F.col("ratio") >= cutoff)
