"""Exact top-k by inner product over an impact-ordered index, score at a time.

Index: each block of vectors keeps its non-zero components as postings (dimension, row, value), in segments by quantised
impact: segment s holds |value| in [2^(s/2), 2^((s+1)/2)). Search: the segments of a block are processed by descending
impact for a block of queries; partial scores grow, and what is still missing is bounded for each vector by
norm(query) x norm(its unprocessed rest). Processing stops when, for every query of the block, few vectors can
still reach the k-th best lower bound (rounding of the rests is allowed for); those possible members, ties included, are scored exactly from the vectors.

Scale: vectors are dealt to blocks by hash, queries in blocks of QUERY_BLOCK are sent to every vector block (a stated
query set against all rows), each pair returns k rows a query, and a window with Spark's group limit merges them.

Cases: vectors that are null, or hold null or non-finite components, take no part, as queries or candidates; a shorter
vector counts as filled with zeros; a query row's own vec_id is no candidate; repeated rows are candidates each; a null
vec_id takes no part; equal scores go to the smaller vec_id; an empty table gives no rows; further columns are ignored. Scores are
longs: the sum of products must fit one, as it does for components below 2^20 in size and up to a million dimensions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

BLOCK, QUERY_BLOCK, QUERY_GROUP = 4096, 256, 64
INDEX_SCHEMA = "block long, width int, ids binary, vectors binary, bounds array<long>, dims binary, rows binary, values binary"
PACKED_SCHEMA = "qblock long, query_width int, query_ids binary, query_vectors binary"
HIT_SCHEMA = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array<long>): floor(scale * x) of each component; rows that take no part are left out."""
    x = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return x.filter(finite).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    m = _matrix(pdf["v"])
    row, dim = np.nonzero(m)
    segment = np.floor(2 * np.log2(np.abs(m[row, dim].astype(float)))).astype(np.int64)
    order = np.lexsort((row, dim, -segment))
    row, dim, segment = row[order].astype(np.int32), dim[order].astype(np.int32), segment[order]
    bounds = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(row)]
    packed = {"ids": pdf["vec_id"].to_numpy(np.int64), "vectors": m, "dims": dim, "rows": row, "values": m[row, dim]}
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "width": [m.shape[1]], "bounds": [bounds]} | {k: [v.tobytes()] for k, v in packed.items()})


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """vectors: vec_id, v. One row a block."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_index, INDEX_SCHEMA)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    m = _matrix(pdf["v"])
    return pd.DataFrame({"qblock": [int(pdf["qblock"].iloc[0])], "query_width": [m.shape[1]], "query_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "query_vectors": [m.tobytes()]})


def search_block(m: np.ndarray, ids: np.ndarray, bounds: list[int], dims: np.ndarray, rows: np.ndarray, values: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int, few: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query, positions of at most k best rows of a block with their exact scores: (query, row, score)."""
    n, width = len(m), m.shape[1]
    q = np.pad(q, ((0, 0), (0, max(0, width - q.shape[1]))))[:, :width]
    acc = np.zeros((n, len(q)), dtype=np.int64)
    rest = (m.astype(float) ** 2).sum(axis=1)
    norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    slack = rest * 1e-11 + 1e-6  # far more than rounding in sums of as many squares as a vector has
    total, mark = max(rest.max(initial=0), 1e-9), 0.25
    own = ids[:, None] == query_ids[None, :]
    possible = None
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi == lo:
            continue
        cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(dims[lo:hi]))).tolist(), hi]
        for a, b in zip(cuts, cuts[1:], strict=False):
            acc[rows[a:b]] += values[a:b, None] * q[None, :, dims[a]]
        np.subtract.at(rest, rows[lo:hi], values[lo:hi].astype(float) ** 2)
        left = rest.max()
        if left <= mark * total and hi < bounds[-1]:
            mark = left / total / 3
            missing = np.sqrt(np.maximum(rest, 0) + slack)[:, None] * norm[None, :] * (1 + 1e-9)
            low = np.where(own, -np.inf, acc - missing)
            floor = np.partition(low, max(0, n - k), axis=0)[max(0, n - k)] if n > k else np.full(len(q), -np.inf)
            may = (acc + missing >= floor) & ~own
            if may.sum() <= few * len(q):
                possible = may
                break
    if possible is None:
        possible = ~own  # all postings are in: the scores are exact
        if n > k:
            scores = np.where(own, np.iinfo(np.int64).min, acc)
            possible &= acc >= np.partition(scores, n - k, axis=0)[n - k]
    at, query = np.nonzero(possible)
    score = np.einsum("ij,ij->i", m[at], q[query])
    order = np.lexsort((ids[at], -score, query))
    at, query, score = at[order], query[order], score[order]
    first = np.searchsorted(query, query, side="left")
    best = np.arange(len(query)) - first < k
    return query[best], at[best], score[best]


def search(index: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """queries: vec_id, v. The k best rows of each block for each query."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in left.itertuples(index=False):
            ids = np.frombuffer(x.ids, dtype=np.int64)
            m = np.frombuffer(x.vectors, dtype=np.int64).reshape(len(ids), x.width)
            dims, rows, values = np.frombuffer(x.dims, dtype=np.int32), np.frombuffer(x.rows, dtype=np.int32), np.frombuffer(x.values, dtype=np.int64)
            for y in right.itertuples(index=False):
                query_ids = np.frombuffer(y.query_ids, dtype=np.int64)
                q = np.frombuffer(y.query_vectors, dtype=np.int64).reshape(len(query_ids), y.query_width)
                query, at, score = search_block(m, ids, list(x.bounds), dims, rows, values, q, query_ids, k)
                out.append(pd.DataFrame({"query_id": query_ids[query], "vec_id": ids[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    n = queries.count()
    packed = queries.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // QUERY_BLOCK))))).groupBy("qblock").applyInPandas(_pack, PACKED_SCHEMA)
    groups = max(1, -(-n // (QUERY_BLOCK * QUERY_GROUP)))
    spread = packed.withColumn("part", F.col("qblock") % groups).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    spread_index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.col("part").cast("long"))
    return spread_index.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInPandas(run, HIT_SCHEMA)


def exact_top_k(spark: SparkSession, rows: DataFrame, is_query, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows but its own for each row that ``is_query`` holds for."""
    vectors = stage(spark, integer_vectors(rows), "vectors")
    blocks = max(1, -(-vectors.count() // block))
    index = stage(spark, build_index(vectors, blocks), "impact-index")
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = search(index, queries, blocks, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op4_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
