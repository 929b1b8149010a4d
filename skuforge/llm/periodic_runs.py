"""Periodic runs: stretches of words that repeat with a smallest period q at least four times, and six words at least.

A suffix automaton is built over a text's words; its suffix links are a tree in which the states of all endings of a prefix form
a path to the root. Word by word that path is accessed in a link-cut tree: every solid path holds the states whose last
occurrence is one and the same earlier end, and the access recolours them with the present end. Where a segment's last end lies p words back
and its deepest state is of p words or longer, those words stand twice in a row, so period p reaches back over that length and p
more: a repetition, known by its start and period. The last end at which it is met is its right end. As a
segment's end is the *last* occurrence, a smaller period would have been met in its place, so p is the smallest.

An automaton costs far more than reading. So a text is first cut at four-word windows that do not recur, again and again within
each piece: all four-word windows within a run of four periods recur within it, so no run crosses a cut, and a run's neighbours
stand in its piece or break its period. Recurrence is told by hashes, where a collision only leaves a longer piece.

Scale: one pass over the texts, nothing is shuffled; a worker holds a batch of texts and the automaton of one piece, of a few states a
word; time is n log n in a piece's length, whatever repeats.

Cases: null text counts as empty: no words, no runs, empty collapsed text; words are separated by space, tab, line feed, vertical tab, form
feed and carriage return alone; null doc_id and repeated rows give a row each (a null doc_id plants nothing); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_long, id_text, small_batches, table, text_or_empty

#: Periods that a run has at least, and its words at least.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Words of a window, and how often pieces are cut again at most (a bound on time: pieces that could be cut further are searched whole).
WINDOW, CUTS = 4, 12
SCHEMA = "doc_id string, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Lengths and suffix links of the states (0: the root), and the state of each prefix."""
    length, link, go, ends = [0], [-1], [{}], []
    last = 0
    for w in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        go.append({})
        at = last
        while at >= 0 and w not in go[at]:
            go[at][w] = new
            at = link[at]
        if at >= 0:
            to = go[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                go.append(go[to].copy())
                link[to] = link[new] = twin
                while at >= 0 and go[at].get(w) == to:
                    go[at][w] = twin
                    at = link[at]
        ends.append(new)
        last = new
    return length, link, ends


class LastOccurrences:
    """A link-cut tree over the suffix links. A solid path's colour, kept at the root of its splay tree, is the last end of its states' strings."""

    def __init__(self, link: list[int]):
        self.up, n = [max(0, x) for x in link], len(link)  # the automaton's root, 0, is no node here
        self.left, self.right, self.colour = [0] * n, [0] * n, [0] * n

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                turns = (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            else:
                turns = (x,)
            for y in turns:
                p = up[y]
                g = up[p]
                if left[p] == y:
                    b = left[p] = right[y]
                    right[y] = p
                else:
                    b = right[p] = left[y]
                    left[y] = p
                if b:
                    up[b] = p
                up[p], up[y] = y, g
                if g and left[g] == p:
                    left[g] = y
                elif g and right[g] == p:
                    right[g] = y
                else:
                    colour[y] = colour[p]

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Gives all states from ``state`` to the root the last end ``end``; returns each segment's former end and deepest state."""
        up, right, colour = self.up, self.right, self.colour
        met, below, x = [], 0, state
        while x:
            self._splay(x)
            was = colour[x]
            if was:
                met.append((was, x))
            deeper = right[x]
            if deeper:
                colour[deeper] = was
            right[x] = below
            below = x
            x = up[x]
        colour[below] = end
        self._splay(state)
        return met


def runs_of_piece(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """start, length and smallest period of every run."""
    length, link, states = automaton(words)
    tree, found = LastOccurrences(link), {}
    for end, state in enumerate(states, 1):
        for was, deepest in tree.access(state, end):
            period = end - was
            if length[deepest] >= (LEAST_PERIODS - 1) * period:
                found[end - length[deepest] - period, period] = end
    for (start, period), end in found.items():
        if end - start >= LEAST_WORDS:
            yield start, end - start, period


def _recurring(windows: np.ndarray) -> np.ndarray:
    """Which windows stand more than once."""
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    out = np.zeros(len(windows), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def pieces(hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """First word and end of each stretch that may hold runs, in order of no kind."""
    n = len(hashes) - WINDOW + 1
    if n < LEAST_WORDS - WINDOW + 1:
        return
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        windows ^= windows >> np.uint64(29)
    left = [(0, n, 0)]
    while left:
        lo, hi, cuts = left.pop()
        again = _recurring(windows[lo:hi])
        if cuts == CUTS or again.all():
            yield lo, hi + WINDOW - 1
            continue
        edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
        left += [(lo + int(a), lo + int(b), cuts + 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= LEAST_WORDS - WINDOW + 1]


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length and period of every run, by start, then period."""
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    found = []
    for lo, hi in pieces(hashes):
        number: dict[bytes, int] = {}
        found += [(lo + s, n, p) for s, n, p in runs_of_piece([number.setdefault(w, len(number)) for w in words[lo:hi]])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep)]


def planted(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The query's words: every tenth id's, by checksum, are periodic from some word on."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(spark: SparkSession, docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs by start and period (words are numbered from 0), and the text without repeats, words joined by one space, for every row.

    plant: take the words as planted() gives them.
    """
    small_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, spans, texts = [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = text.encode().split()  # of bytes, split() takes the six separators and no others
                if plant:
                    words = planted(words, doc_id)
                found = runs(words)
                n.append(len(words))
                spans.append([{"start": s, "length": k, "period": p} for s, k, p in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n, "runs": spans, "text": texts})

    return id_long(docs.select(id_text(), text_or_empty().alias("text")).mapInPandas(run, SCHEMA))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark, table(spark, sf_dir, "documents"), plant=True)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("under"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.under")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.under")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Runs as islands of four-word windows that stand again q words on; of those, the ones that none of a smaller period covers.
ORACLE = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS remainder
  FROM range(256) r(i)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, x: xor(c >> 8, remainder[xor(c & 255, x) + 1])), 4294967295) AS h
  FROM documents, crc),
planted AS (
  SELECT rid, doc_id, words, len(words) AS n, coalesce(h % 10 = 0, false) AND len(words) > 0 AS tenth,
         (h // 10) % greatest(1, len(words)) AS a,
         1 + (len(words) - (h // 10) % greatest(1, len(words))) // (3 + (h // 10) % 8) AS p
  FROM d),
w AS (
  SELECT rid, i, n, words[CASE WHEN tenth AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
g AS (
  SELECT rid, i, n, row(word, lead(word, 1) OVER v, lead(word, 2) OVER v, lead(word, 3) OVER v) AS four FROM w WINDOW v AS (PARTITION BY rid ORDER BY i)),
q AS (
  SELECT x.rid, x.i, y.i - x.i AS period FROM g x JOIN g y ON x.rid = y.rid AND x.four = y.four AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
  WHERE x.i + 4 <= x.n AND y.i + 4 <= y.n),
islands AS (
  SELECT rid, period, min(i) AS start, count(*) + 3 + period AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, period ORDER BY i) AS island FROM q) GROUP BY rid, period, island
  HAVING count(*) + 3 + period >= greatest(6, 4 * period)),
r AS (
  SELECT * FROM islands x WHERE NOT EXISTS (
    SELECT 1 FROM islands y WHERE y.rid = x.rid AND y.period < x.period AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
told AS (
  SELECT rid, count(*) AS n_runs, arg_max(start, (length, -start, -period)) AS start, max(length) AS length,
         arg_max(period, (length, -start, -period)) AS period,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM r GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""
