"""Indel ratios in plain SQL, for oracles: common table expressions over a relation of pairs (a, b) that the caller names."""

from __future__ import annotations


def lcs(pairs: str, out: str) -> str:
    """``out``: a, b, n, the length of the longest common subsequence, for each distinct (a, b) of ``pairs``; one recursion step a character."""
    return f"""{out}_step AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS row FROM (SELECT DISTINCT a, b FROM {pairs}) AS d
    UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN row[j] + 1 ELSE row[j + 1] END]),
      lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0]) FROM {out}_step WHERE i < length(a)),
  {out} AS (SELECT a, b, row[length(b) + 1] AS n FROM {out}_step WHERE i = length(a))"""


def ratio(pairs: str, out: str) -> str:
    """``out``: a, b, r, the ratio of each distinct pair."""
    return f"""{lcs(pairs, out + "_n")},
  {out} AS (SELECT a, b, CASE WHEN a = '' AND b = '' THEN 100.0 ELSE 200.0 * n / (length(a) + length(b)) END AS r FROM {out}_n)"""


def partial(pairs: str, out: str) -> str:
    """``out``: a, b, r, the best ratio of the shorter text and a window of the longer one, of its length or cut at an end."""
    return f"""{out}_two AS (SELECT DISTINCT a, b, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM {pairs}),
  {out}_at AS (SELECT *, unnest(range(1 - length(s), length(l))) AS k FROM {out}_two),
  {out}_win AS (SELECT a AS x, b AS y, s AS a, substr(l, CAST(greatest(k, 0) + 1 AS BIGINT), CAST(k + length(s) - greatest(k, 0) AS BIGINT)) AS b FROM {out}_at),
  {ratio(out + "_win", out + "_r")},
  {out} AS (SELECT x AS a, y AS b, max(r) AS r FROM {out}_win JOIN {out}_r USING (a, b) GROUP BY ALL)"""


def words_sorted(text: str) -> str:
    return f"array_to_string(list_sort(string_split({text}, ' ')), ' ')"


def token_sorted(pairs: str, out: str) -> str:
    """``out``: a, b, r, the ratio of the texts with their words sorted. Words are parted by single spaces."""
    return f"""{out}_k AS (SELECT DISTINCT a AS x, b AS y, {words_sorted("a")} AS a, {words_sorted("b")} AS b FROM {pairs}),
  {ratio(out + "_k", out + "_r")},
  {out} AS (SELECT x AS a, y AS b, r FROM {out}_k JOIN {out}_r USING (a, b))"""


def typo(pairs: str, out: str) -> str:
    """``out``: a, b, r, the word-sorted ratio after each word of a became the first word of b that it may be a misspelling of."""
    return f"""{out}_d AS (SELECT DISTINCT a, b FROM {pairs}),
  {out}_a AS (SELECT a, b, unnest(string_split(a, ' ')) AS x, unnest(range(len(string_split(a, ' ')))) AS i FROM {out}_d),
  {out}_b AS (SELECT a, b, unnest(string_split(b, ' ')) AS y, unnest(range(len(string_split(b, ' ')))) AS j FROM {out}_d),
  {out}_xy AS (SELECT DISTINCT x AS a, y AS b FROM {out}_a JOIN {out}_b USING (a, b) WHERE length(x) >= 5 AND length(y) >= 5),
  {ratio(out + "_xy", out + "_w")},
  {out}_new AS (SELECT p.a, p.b, p.i, coalesce(arg_min(q.y, q.j) FILTER (w.r >= 80), p.x) AS x FROM {out}_a p JOIN {out}_b q ON p.a = q.a AND p.b = q.b LEFT JOIN {out}_w w ON w.a = p.x AND w.b = q.y GROUP BY p.a, p.b, p.i, p.x),
  {out}_k AS (SELECT a AS t, b AS u, array_to_string(list_sort(list(x)), ' ') AS a, {words_sorted("b")} AS b FROM {out}_new GROUP BY a, b),
  {ratio(out + "_k", out + "_r")},
  {out} AS (SELECT t AS a, u AS b, r FROM {out}_k JOIN {out}_r USING (a, b))"""
