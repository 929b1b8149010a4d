"""Shards by jump consistent hashing of a stable key.

A row's shard follows from its key and the number of shards alone: a generator seeded with the key's 64-bit hash jumps forward
through shard numbers, and the last one below the count is the shard. No table of a ring is kept or sent. With one more shard a
row stays or goes to the new one, and the expected share that goes is one in the new number of shards.

assign() adds shards and shuffles nothing. place() also gives each row its slot in the shard, by key: narrow rows are sorted by
shard and key over ranges, which split a hot shard or a hot key (the row itself breaks ties), and are numbered by their
place in the sorted files, so no shard is ever gathered. write() writes a folder for each shard; grow() says which rows move.

The law of the query is ``key``: doc_id and shard count decide. Equal texts go together only where their doc_ids are equal too.

Cases: a null doc_id is a key like the empty string, and its rows share a shard; a null text has no bytes (size 8, checksum
0); repeated rows get a slot each; an empty table gives no rows; further columns of any name pass through assign() and write() and are
ignored by place(); more shards than rows leave some empty; less than one shard is refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, numbered, row_ids, stage, table, text_or_empty, unused

SHARDS = 24
#: Bytes of a record beside its text.
OVERHEAD = 8
#: Fixed value: multiplier of the published algorithm's generator.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, all at once; the number of steps grows with the logarithm of ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state, shard = keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    live, ahead = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
    while len(live):
        shard[live] = ahead
        state = state * np.uint64(MULTIPLIER) + np.uint64(1)
        step = float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead = ((shard[live] + 1) * step).astype(np.int64)
        on = ahead < shards
        live, state, ahead = live[on], state[on], ahead[on]
    return shard


def key_hash(key: Column) -> Column:
    """16 bytes that depend on the key's text alone; the first 8 seed the jumps."""
    return F.unhex(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key, from 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jumped(hashes: pd.Series) -> pd.Series:
        seeds = np.frombuffer(b"".join(hashes), dtype=">u8")[::2].astype(np.uint64)
        return pd.Series(jump(seeds, shards).astype(np.int32), index=hashes.index)

    return jumped(key_hash(key))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with its shard in ``name``, which a column of that name gives way to. Nothing is shuffled."""
    return docs.withColumn(name, shard_of(F.col(f"`{key}`"), shards))


def grow(docs: DataFrame, shards: int, more: int, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that move when ``shards`` become ``more``, with columns ``source_shard`` and ``target_shard``."""
    if more < shards:
        raise ValueError("shards are appended only")
    moved = assign(assign(docs, shards, key, "source_shard"), more, key, "target_shard")
    return moved.filter("source_shard <> target_shard")


def place(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) for every row."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id").cast("long"), shards).alias("shard"),
        shard_of(F.col("doc_id").cast("long"), shards + 1).alias("grown_shard"),
        key_hash(F.col("doc_id").cast("long")).alias("key"),
    )
    rows = row_ids(spark, stage(spark, rows, "shard-keys"), "row")
    order = ["shard", "key", "doc_id", "size", "text_crc32", "row"]
    ordered = stage(spark, rows.repartitionByRange(*order).sortWithinPartitions(*order), "shard-order")
    # a row for each shard: as many as there are shards, whatever the input
    sizes = ordered.groupBy(F.col("shard").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(spark, sizes.select("of", before.alias("start")), "shard-starts")
    placed = numbered(spark, ordered, "place").join(starts, F.col("shard") == F.col("of"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), "grown_shard")


def write(spark: SparkSession, docs: DataFrame, path: str | None = None, shards: int = SHARDS, key: str = "doc_id", file_rows: int = 1 << 20) -> str:
    """Writes ``docs`` as Parquet, a folder ``shard=k`` for each shard with rows, in files of at most ``file_rows`` rows; returns the path.

    Whole rows are shuffled once, by ranges of shard and key, so that a shard's rows stand in few files and a large shard is split.
    """
    path = path or new_path(spark, "shards")
    kept = docs.drop("shard")
    hashed, tie = unused(kept, "_hash"), unused(kept, "_tie")
    rows = row_ids(spark, assign(kept, shards, key).withColumn(hashed, key_hash(F.col(f"`{key}`"))), tie)
    order = ["shard", hashed, tie]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(hashed, tie).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
    return path


def op11_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark, table(spark, sf_dir, "documents"))


#: A table of 256 remainders, then a fold over a text's bytes.
_CRC = """
crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS remainder
  FROM range(256) r(i))
"""
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bytes}, lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, remainder[xor(c & 255, x) + 1])), 4294967295)"


def _jump_sql(name: str, shards: int) -> str:
    return f"""
{name}_step AS (
  SELECT key, key AS state, 0::BIGINT AS shard, 0::BIGINT AS ahead, 0 AS step FROM keys
  UNION ALL
  SELECT key, next_state, ahead, CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / ((next_state // 8589934592) + 1)::DOUBLE)) AS BIGINT), step + 1
  FROM (SELECT *, (state * {MULTIPLIER} + 1) % 18446744073709551616 AS next_state FROM {name}_step WHERE ahead < {shards}) s),
{name} AS (SELECT key, arg_max(shard, step) AS shard FROM {name}_step GROUP BY key)"""


ORACLE = f"""
WITH RECURSIVE {_CRC},
d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
keys AS (SELECT DISTINCT CAST(('0x' || substr(hash, 1, 16))::UBIGINT AS HUGEINT) AS key FROM d),
{_jump_sql("now", SHARDS)},
{_jump_sql("grown", SHARDS + 1)},
s AS (
  SELECT doc_id, hash, strlen(text) + {OVERHEAD} AS size, {_CRC_OF.format(bytes="regexp_extract_all(hex(encode(text)), '..')")} AS text_crc32,
         now.shard AS shard, grown.shard AS grown_shard
  FROM crc, d JOIN now ON now.key = ('0x' || substr(hash, 1, 16))::UBIGINT::HUGEINT JOIN grown USING (key))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY hash, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM s
"""
