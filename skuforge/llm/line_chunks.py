"""Removal of passages that repeat across the corpus, by content-defined chunks of lines.

A rolling hash over the last WINDOW line hashes ends a chunk where its low bits are zero, so the same run of lines is cut
the same way wherever it stands. A chunk of at least two lines and some text whose bytes occur more than once keeps its
first occurrence (smallest doc_id, then position); the others go.

Chunks lose the edges of a passage, and passages shorter than a chunk. So a matched passage is grown to its ends: beside chunks, the
fewest lines with PAIR_WORDS words (two lines at least, blank ones not counted but compared) are matched from each line on and up to each
line, so that every line of a repeated passage stands in such a window within it, however short its lines are. A single line of
over LINE_WORDS words is matched alone. A line goes if any matched chunk that is not the first of its kind covers it; as a first
occurrence is always an earlier one, each line that goes still stands somewhere before.

Steps: digests of chunks with their places; digests that repeat, counted before the shuffle; of documents that hold one, the
bytes of chunks with one digest are compared (the smallest and the largest text must be equal, combined before the shuffle, so
a hot passage is one row a task); each document gets the lines to drop.

Scale: digests and places move, then texts that hold a repeated chunk for the comparison, and all texts once for the removal,
at every size alike. No group is ever gathered; joins on a hot digest are plain equi-joins, which adaptive execution splits.

Cases: null text counts as empty; texts without a repeated chunk come back as they are; a text that is all repeats becomes
empty; lines end at line feeds alone; a null doc_id comes first in order; rows that repeat both doc_id and text count as one
occurrence and are treated alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_long, id_text, small_batches, stage, table, text_or_empty

WINDOW, MASK, LEAST_LINES = 2, 1, 2
PAIR_WORDS, LINE_WORDS = 10, 50


def chunks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """First line and end of each content-defined chunk, in order."""
    import xxhash

    start, last = 0, 0
    for k, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line.encode(), 7)
        rolling = (last * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF  # WINDOW is 2: this line's hash and the last one's
        last = h
        if k + 1 - start >= LEAST_LINES and (rolling >> 40) & MASK == 0:
            yield start, k + 1
            start = k + 1
    if start < len(lines):
        yield start, len(lines)


def _windows(words: list[int]) -> list[tuple[int, int]]:
    """First and last of the fewest lines, two at least, with PAIR_WORDS words: from each line on, and up to each line. In order.

    So each line of a repeated passage of that size stands in a window that lies within the passage.
    """
    found, hi, n = set(), 0, 0
    for lo in range(len(words)):  # from each line on
        while hi < len(words) and (n < PAIR_WORDS or hi - lo < 2):
            n += words[hi]
            hi += 1
        if n >= PAIR_WORDS and hi - lo >= 2:
            found.add((lo, hi - 1))
        n -= words[lo]
    lo, n = len(words) - 1, 0
    for hi in range(len(words) - 1, -1, -1):  # up to each line
        while lo >= 0 and (n < PAIR_WORDS or hi - lo < 2):
            n += words[lo]
            lo -= 1
        if n >= PAIR_WORDS and hi - lo >= 2:
            found.add((lo + 1, hi))
        n -= words[hi]
    return sorted(found)


def passages(lines: list[str]) -> Iterator[tuple[int, int, bool]]:
    """First line and end of all that is matched, and whether it is one of the rolling hash's chunks."""
    words = [len(line.split()) for line in lines]
    for lo, hi in chunks(lines):
        if hi - lo >= LEAST_LINES and any(words[lo:hi]):
            yield lo, hi, True
    filled = [k for k, n in enumerate(words) if n]
    after = -1
    for a, b in _windows([words[k] for k in filled]):
        lo, hi = filled[a], filled[b] + 1
        # of a line that stands many times in a row, windows don't overlap: a first one isn't taken for its own copy
        if lo < after and len({lines[k] for k in filled[a : b + 1]}) == 1:
            continue
        yield lo, hi, False
        after = hi
    for k in filled:
        if words[k] > LINE_WORDS:
            yield k, k + 1, False


def _digest(lines: list[str], lo: int, hi: int) -> bytes:
    return hashlib.blake2b("\n".join(lines[lo:hi]).encode(), digest_size=16).digest()


PLACE = ["doc_id", "key", "lo", "hi", "is_chunk", "digest"]


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for i, key, text in zip(pdf["doc_id"], pdf["key"], pdf["text"], strict=True):
            lines = text.split("\n")
            found += [(i, key, lo, hi, whole, _digest(lines, lo, hi)) for lo, hi, whole in passages(lines)]
        yield pd.DataFrame(found, columns=PLACE)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for text, places in zip(pdf["text"], pdf["places"], strict=True):
            lines = text.split("\n")
            found += [(p["digest"], "\n".join(lines[p["lo"] : p["hi"]])) for p in places]
        yield pd.DataFrame(found, columns=["digest", "passage"])


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text, drop in zip(pdf["doc_id"], pdf["text"], pdf["drop"], strict=True):
            lines = text.split("\n")
            drop = [] if drop is None else drop
            gone = {k for p in drop for k in range(p["lo"], p["hi"])}
            kept = [x for k, x in enumerate(lines) if k not in gone]
            rows.append((i, "\n".join(kept), len(lines), sum(1 for _ in chunks(lines)), len(gone), sum(bool(p["is_chunk"]) for p in drop)))
        yield pd.DataFrame(rows, columns=["doc_id", "text", "n_lines", "n_chunks", "lines_removed", "chunks_removed"])


def line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated passages, n_lines, n_chunks, lines_removed, chunks_removed for every row."""
    small_batches(spark)
    rows = docs.select(id_text(), text_or_empty().alias("text"))
    # a row is known by its id and whole text
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("\u0001", F.coalesce("doc_id", F.lit("-")), "text").cast("binary"))))
    found = rows.select("doc_id", "key", "text").mapInPandas(_places, "doc_id string, key binary, lo int, hi int, is_chunk boolean, digest binary")
    places = stage(spark, id_long(found), "chunk-places")
    at = F.struct("doc_id", "key", "lo")
    first = places.groupBy("digest").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    repeated = stage(spark, first.filter("first <> last").select(F.col("digest").alias("d"), "first"), "chunk-repeated")
    hits = stage(spark, places.join(repeated, F.col("digest") == F.col("d")).select("key", "lo", "hi", "is_chunk", "digest", (at != F.col("first")).alias("later")), "chunk-hits")

    held = hits.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("digest", "lo", "hi")).alias("places"))
    texts = rows.join(held.hint("merge"), F.col("key") == F.col("k")).select("text", "places").mapInPandas(_texts, "digest binary, passage string")
    proved = texts.groupBy("digest").agg(F.min("passage").alias("a"), F.max("passage").alias("b")).filter("a = b").select(F.col("digest").alias("d"))
    proved = stage(spark, proved, "chunk-proved")
    gone = hits.filter("later").join(proved, F.col("digest") == F.col("d"), "left_semi")
    drops = stage(spark, gone.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("lo", "hi", "is_chunk")).alias("drop")), "chunk-drops")
    joined = rows.join(drops.hint("merge"), F.col("key") == F.col("k"), "left").select("doc_id", "text", "drop")
    return id_long(joined.mapInPandas(_removed, "doc_id string, text string, n_lines long, n_chunks long, lines_removed long, chunks_removed long"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark, table(spark, sf_dir, "documents"))
