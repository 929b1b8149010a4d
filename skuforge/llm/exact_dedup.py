"""Exact deduplication against a minimal perfect hash of historical digests.

The index over the history has one row per shard of digests: level bitmaps (about three bits a digest) that give each
digest its own slot, and per slot the full SHA-256 digest, the winner's doc_id, whether there is one, and the number of copies. Arrivals look
up their slot; the full digest there is compared byte by byte. Members join the group of that slot, nonmembers are
grouped among themselves.

Scale: only (doc_id, 32-byte digest) pairs move. Copies are counted before the shuffle, so a group of any size is one
row a map task; shards hold a bounded number of digests and grow in number with the input. The last join, from rows to
groups, is a plain equi-join that adaptive execution splits where a third of all rows share a digest.

Cases: null text counts as empty; empty texts equal each other; a null doc_id never wins over another id, any long is an id, and a group of
only null ids has a null keep_id and keeps its rows; rows that repeat the winning doc_id all stay; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mph
from .common import ascii_lower, stage, table, text_or_empty

INDEX_SCHEMA = "shard long, level_bits binary, bitmap binary, digests binary, keep_ids binary, with_id binary, sizes binary"
GROUP_SCHEMA = "digest binary, keep_id long, with_id boolean, group_size long, in_history boolean"


def keys(docs: DataFrame, in_history: Column) -> DataFrame:
    """doc_id, SHA-256 of the normalised text, and whether the row belongs to the history."""
    digest = F.unhex(F.sha2(ascii_lower(text_or_empty()).cast("binary"), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.coalesce(in_history, F.lit(False)).alias("in_history"))


def _counted(rows: DataFrame, shards: int) -> DataFrame:
    return (
        rows.groupBy("digest")
        .agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("keep_id"), (F.count("doc_id") > 0).alias("with_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    )


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    d = mph.words(list(pdf["digest"]))
    sizes, bitmap = mph.build(d)
    order = np.empty(len(d), dtype=np.int64)
    order[mph.slots(sizes, bitmap, d)] = np.arange(len(d))
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "level_bits": [sizes.tobytes()],
            "bitmap": [np.packbits(bitmap).tobytes()],
            "digests": [d[order].tobytes()],
            "keep_ids": [pdf["keep_id"].to_numpy(np.int64)[order].tobytes()],
            "with_id": [pdf["with_id"].to_numpy(bool)[order].tobytes()],
            "sizes": [pdf["n"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: doc_id, digest. One row per shard."""
    return _counted(history, shards).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def _resolve(left: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    new = mph.words(list(left["digest"])) if len(left) else np.zeros((0, 4), dtype=np.uint64)
    ids, known, n = left["keep_id"].to_numpy(np.int64), left["with_id"].to_numpy(bool), left["n"].to_numpy(np.int64)
    if not len(index):
        return pd.DataFrame({"digest": list(left["digest"]), "keep_id": ids, "with_id": known, "group_size": n, "in_history": False})
    row = index.iloc[0]
    sizes = np.frombuffer(row["level_bits"], dtype=np.int64)
    bitmap = np.unpackbits(np.frombuffer(row["bitmap"], dtype=np.uint8))[: int(sizes.sum())].astype(bool)
    held = np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
    keep, with_id, size = (np.frombuffer(row[c], dtype=kind).copy() for c, kind in (("keep_ids", np.int64), ("with_id", bool), ("sizes", np.int64)))
    slot = mph.slots(sizes, bitmap, new)
    member = slot >= 0
    member[member] = (held[slot[member]] == new[member]).all(axis=1)  # the bytes decide, not the hash
    at = slot[member]
    larger = known[member] & (~with_id[at] | (ids[member] > keep[at]))  # where no row has an id, its number means nothing
    keep[at] = np.where(larger, ids[member], keep[at])
    with_id[at] |= known[member]
    size[at] += n[member]
    rest = ~member
    return pd.DataFrame(
        {
            "digest": [x.tobytes() for x in held] + [x.tobytes() for x in new[rest]],
            "keep_id": np.concatenate([keep, ids[rest]]),
            "with_id": np.concatenate([with_id, known[rest]]),
            "group_size": np.concatenate([size, n[rest]]),
            "in_history": np.concatenate([np.ones(len(held), dtype=bool), np.zeros(int(rest.sum()), dtype=bool)]),
        }
    )


def lookup(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of the index or the arrivals."""
    return _counted(arrivals, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_resolve, GROUP_SCHEMA)


def exact_dedup(spark: SparkSession, docs: DataFrame, in_history: Column | None = None, digests_per_shard: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and in_history for every row of ``docs``.

    in_history marks the rows the index is built from; by default the half of the rows with an even hash of doc_id, so
    that one table serves as an earlier and a later crawl. The groups are the same for any choice.
    """
    if in_history is None:
        in_history = F.xxhash64("doc_id").bitwiseAND(F.lit(1)) == 0
    rows = stage(spark, keys(docs, in_history), "dedup-keys")
    shards = max(1, -(-rows.count() // digests_per_shard))
    index = stage(spark, build_index(rows.filter("in_history"), shards), "dedup-index")
    groups = stage(spark, lookup(index, rows.filter("NOT in_history"), shards), "dedup-groups")
    keep = F.when(F.col("g.with_id"), F.col("g.keep_id"))
    return (
        rows.alias("r")
        .join(groups.alias("g"), F.col("r.digest") == F.col("g.digest"))
        .select(
            "r.doc_id",
            keep.alias("keep_id"),
            "g.group_size",
            F.col("r.doc_id").eqNullSafe(keep).alias("kept"),
            F.lower(F.hex("r.digest")).alias("text_sha256"),
            "r.in_history",
        )
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents")).drop("in_history")


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
