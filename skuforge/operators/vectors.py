"""Embedding columns and retrieval: encoding, fusion, exact top-k over dense and sparse vectors, semantic dedup.

Encoders and scorers are the user's: callables over batches, run once for each distinct text or pair. Dense search multiplies
blocks of queries with partitions of the corpus and keeps k rows each before the one shuffle that merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuforge.functions import similarity as S
from skuforge.functions import text as T
from skuforge.sources.shared import checkpointed, settled

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], list[float]]
#: Weights of name, description and category in a product's vector.
MATCH_WEIGHTS, CLASSIFY_WEIGHTS = (1.0, 0.3, 0.2), (1.0, 0.8, 0.5)
UNSCORED = -10.0
#: Postings that one task sorts by row.
TASK_POSTINGS = 1 << 17
#: Numbers of either side that a task of a dense search holds, and numbers that a round of it copies. Copies with more than MEMBERS hits a query stay rows of their own.
CELL, ROUND, MEMBERS = 1 << 21, 1 << 29, 1000


def hashed_words(dim: int = 64) -> Encoder:
    """A deterministic stand-in for an encoder: words hashed into a bag."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[k, h % dim] += 1 if h >> 16 & 1 else -1
        return out

    return encode


def encode(df: DataFrame, text: str, encoder: Encoder, out: str = "vector", texts: DataFrame | None = None) -> DataFrame:
    """``df`` with a unit vector for each text; each distinct text is encoded once.

    texts: where the texts come from, if not from ``df``: give what ``df`` was before an encoding of another column, which would else be done again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.asarray(encoder(pdf["_t"].tolist()), dtype=np.float32)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.DataFrame({"_t": pdf["_t"], out: list(v / np.where(n > 0, n, 1))})

    coded = (df if texts is None else texts).select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct().mapInPandas(run, f"_t string, {out} array<float>")
    return df.join(coded, F.coalesce(F.col(text), F.lit("")) == F.col("_t")).drop("_t")


def encode_missing(df: DataFrame, stored: DataFrame, key: str, text: str, encoder: Encoder) -> DataFrame:
    """key, vector for the keys not stored yet."""
    return encode(df.join(stored, key, "left_anti").select(key, text), text, encoder).select(key, "vector")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows, but those with a key in ``new``, and the new rows."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def _scaled(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * w)


def weighted_vector(parts: list[tuple[Column, Column]], weights: tuple[float, ...]) -> Column:
    """parts: (text, vector) of each field; blank fields are left out of the weighted sum, which is then normalised."""
    total = None
    for (text, vector), w in zip(parts, weights, strict=True):
        scaled = _scaled(vector, w)
        zero = F.transform(vector, lambda x: F.lit(0.0))
        own = F.when(T.blank(text), zero).otherwise(scaled)
        total = own if total is None else F.zip_with(total, own, lambda a, b: a + b)
    return S.normalized(total)


def _weighted(m: Column, w: float) -> Column:
    return F.transform_values(m, lambda k, v: v * w)


def merged_sparse(parts: list[Column], weights: tuple[float, ...]) -> Column:
    """Maps token -> weight merged by the largest weighted score."""
    scaled = [_weighted(m, w) for m, w in zip(parts, weights, strict=True)]
    out = scaled[0]
    for m in scaled[1:]:
        out = F.map_zip_with(out, m, lambda k, a, b: F.greatest(F.coalesce(a, b), F.coalesce(b, a)))
    return out


def top_k(hits: DataFrame, query: str, score: str, uid: str, k: int, rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(score), uid)
    return hits.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def best_columns(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest scores, row by row, largest first, ties by column: what a stable sort gives, without sorting all."""
    n, width = score.shape
    if width > k:
        low, groups = -score, width // 16
        # the k-th best of groups' best scores is no better than the k-th best of all, and is found among fewer
        few = low if groups < 4 * k else low[:, : groups * 16].reshape(n, 16, groups).min(axis=1)
        cut = np.partition(few, k - 1, axis=1)[:, k - 1]
        if not np.isnan(cut).any():  # with fewer than k numbers nothing is cut off
            rows, columns = np.nonzero(low <= cut[:, None])
            order = np.lexsort((low[rows, columns], rows))
            rows, columns = rows[order], columns[order]
            first = np.searchsorted(rows, np.arange(n))
            kept = np.arange(len(rows)) - first[rows] < k
            return rows[kept], columns[kept]
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(n), best.shape[1]), best.ravel()


def _sizes(q: DataFrame, c: DataFrame, block: int, part_rows: int, weights: tuple[int, int] = (1, 1)) -> DataFrame:
    """_v, blocks, parts, copied: of each value of _on the blocks of queries, the parts of the corpus, and what all copies weigh, given each side's row."""
    count = lambda df, rows, name: df.groupBy("_on").agg(F.count(F.lit(1)).alias(f"n{name}"), F.ceil(F.count(F.lit(1)) / rows).alias(name))
    sizes = count(q, block, "blocks").join(count(c, part_rows, "parts"), "_on")
    copied = F.col("nblocks") * F.col("parts") * float(weights[0]) + F.col("nparts") * F.col("blocks") * float(weights[1])
    return checkpointed(sizes.select(F.col("_on").alias("_v"), "blocks", "parts", copied.alias("copied")))


def _on(queries: DataFrame, corpus: DataFrame, same: str | None) -> tuple[DataFrame, DataFrame]:
    value = F.col(same) if same else F.lit(0)
    return queries.withColumn("_on", value), corpus.withColumn("_on", value)


def _dealt(q: DataFrame, c: DataFrame, sizes: DataFrame, rounds: int = 1, at: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns b and part, a row for each pair they belong to, of the blocks that this one of the rounds takes."""
    sizes, taken = sizes.drop("copied"), F.pmod(F.xxhash64("_on") + F.col("b"), F.lit(rounds)) == at
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = q.join(sizes, F.col("_on") == F.col("_v")).withColumn("b", F.pmod(F.xxhash64("query_id"), "blocks")).filter(taken).withColumn("part", every("parts"))
    c = c.join(sizes, F.col("_on") == F.col("_v")).withColumn("part", F.pmod(F.xxhash64("uid"), "parts")).withColumn("b", every("blocks")).filter(taken)
    return q.drop("_v", "blocks", "parts"), c.drop("_v", "blocks", "parts")


def _grid(queries: DataFrame, corpus: DataFrame, same: str | None, block: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (query_id, ... and uid, ...) with columns _on, b and part: a row for each pair of a block of queries and a part of the corpus
    that it belongs to. Where ``same`` is given, only blocks and parts of one value meet; their numbers follow the value's own rows."""
    q, c = _on(queries, corpus, same)
    return _dealt(q, c, _sizes(q, c, block, part_rows))


def _members(corpus: DataFrame, same: str | None, k: int) -> DataFrame:
    """uid, uids, v (and ``same``): each distinct vector with the smallest k of its rows, which are all that can be among a query's best k, and the first of them."""
    on = [same] if same else []
    rows = corpus.select("uid", F.col("vector").alias("v"), *on).filter("v IS NOT NULL AND uid IS NOT NULL")
    if k > MEMBERS:
        return rows.withColumn("uids", F.array("uid"))
    return _first_rows(rows, ["v", *on], "uid", k).groupBy("v", *on).agg(F.min("uid").alias("uid"), F.array_sort(F.collect_list("uid")).alias("uids"))


def _first_rows(rows: DataFrame, by: list[str], uid: str, k: int) -> DataFrame:
    """The k smallest rows of each group; Spark leaves the others out before they are sent."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(uid))).filter(F.col("_n") <= k).drop("_n")


def _rows_of(row: np.ndarray, column: np.ndarray, score: np.ndarray, starts: np.ndarray, counts: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, codes and scores of the best k rows of each query, from its best vectors (row, column, score); codes are the vectors' rows one behind the other."""
    n = counts[column]
    each = np.repeat(np.arange(len(column)), n)
    of = codes[np.arange(len(each)) + np.repeat(starts[column] - (np.cumsum(n) - n), n)]
    row, score = row[each], score[each]
    order = np.lexsort((of, -score, row))
    row, of, score = row[order], of[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], of[kept], score[kept]


def dense_top_k(spark: SparkSession, queries: DataFrame, corpus: DataFrame, k: int, least: float | None = None, same: str | None = None, block: int | None = None, part_rows: int | None = None) -> DataFrame:
    """query_id, uid, score, rank: the k corpus rows with the largest dot product. queries: query_id, vector; corpus: uid, vector.

    ``same`` names a column that both sides share and that must agree. Equal vectors meet once: queries take their vector's hits by a join, and a corpus
    vector brings its smallest k rows. A task holds one block of queries and one part of the corpus, whatever the tables' sizes: it multiplies them, and
    keeps k rows a query. Blocks take turns where all copies would be more than ROUND numbers: a round takes whole blocks and writes their hits, so its
    shuffle holds ROUND numbers, or one block with the corpus. Ties go to the smaller uid. All filters hold before the top k. Rows without a vector, and corpus rows without a uid, take no part.
    """
    on = [same] if same else []
    asked = settled(queries.select("query_id", "vector", *on).filter("vector IS NOT NULL"))  # read twice: what encodes them need not give the same twice
    units = settled(asked.select("vector", *on).distinct().select(F.monotonically_increasing_id().alias("query_id"), "vector", *on))
    known = settled(_members(corpus, same, k))
    width = max([r[0] for r in known.select(F.size("v")).limit(1).collect()] + [1])
    q, c = _on(units, known, same)
    fit = max(128, CELL // width)
    sizes = _sizes(q, c, block or fit, part_rows or fit, (width + 3 * min(k, fit), width))
    copied, blocks, cells = sizes.agg(F.sum("copied"), F.sum("blocks"), F.sum(F.col("blocks") * F.col("parts"))).first()
    rounds = max(1, min(-(-int(copied or 0) // ROUND), blocks or 0))
    tasks = max(1, min(2 * (cells or 0) // rounds, 1000))  # by number: a task's work is the product of its sides, which their bytes don't tell

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "uid": [], "score": []}, dtype=object)]
        if len(left) and len(right):
            counts = right["uids"].map(len).to_numpy()
            codes, ids = pd.factorize(np.concatenate(right["uids"].tolist()), sort=True)
            starts = np.cumsum(counts) - counts
            order = np.argsort(codes[starts], kind="stable")  # by the vectors' first rows
            starts, counts, single = starts[order], counts[order], bool((counts == 1).all())
            m = np.stack(right["v"].tolist()).astype(np.float64)[order].T
            names, vectors = left["query_id"].to_numpy(), left["vector"].tolist()
            for lo in range(0, len(names), 32):  # scores of a few queries at a time
                score = np.stack(vectors[lo : lo + 32]).astype(np.float64) @ m
                row, best = best_columns(score, k)
                found = score[row, best]
                if least is not None:
                    keep = found >= least
                    row, best, found = row[keep], best[keep], found[keep]
                row, of, found = (row, codes[starts[best]], found) if single else _rows_of(row, best, found, starts, counts, codes, k)
                out.append(pd.DataFrame({"query_id": names[lo : lo + 32][row], "uid": ids[of], "score": found}))
        return pd.concat(out[1:] or out)

    def best_of(at: int) -> DataFrame:
        left, right = (side.repartition(tasks, "_on", "part", "b") for side in _dealt(q, c, sizes, rounds, at))
        hits = left.groupBy("_on", "part", "b").cogroup(right.groupBy("_on", "part", "b")).applyInPandas(run, _hit_schema(units, known))
        return top_k(hits, "query_id", "score", "uid", k).withColumnRenamed("query_id", "_unit")

    best = best_of(0) if rounds == 1 else reduce(DataFrame.unionByName, [settled(best_of(at)) for at in range(rounds)])
    of = asked.join(units.select(F.col("query_id").alias("_unit"), "vector", *on), ["vector", *on]).select("query_id", "_unit")
    return of.join(best, "_unit").select("query_id", "uid", "score", "rank")


def softmax_best(queries: DataFrame, classes: DataFrame, block: int = 2048, part_rows: int = 8192) -> DataFrame:
    """query_id, uid, score, share: the class with the largest dot product (ties: the smaller uid), and its share of the softmax over all classes.

    queries: query_id, vector; classes: uid, vector; rows without a vector take no part. Blocks of queries meet parts of the classes as in dense_top_k;
    a task gives each query its best class and the sum of the part's exponentials below it, and parts are added up by query.
    """
    some = lambda df, c, v: df.filter(F.col("vector").isNotNull()).select(c, F.col("vector").alias(v))
    q, c = _grid(some(queries, "query_id", "vector"), some(classes, "uid", "v"), None, block, part_rows)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "uid": [], "score": [], "total": []}, dtype=object)]
        if len(left) and len(right):
            right = right.sort_values("uid", kind="stable")
            ids, m = right["uid"].to_numpy(), np.stack(right["v"].tolist()).astype(np.float64)
            names, vectors = left["query_id"].to_numpy(), left["vector"].tolist()
            for lo in range(0, len(names), 128):  # scores of a few queries at a time
                score = np.stack(vectors[lo : lo + 128]).astype(np.float64) @ m.T
                best = score.argmax(axis=1)
                top = score[np.arange(len(score)), best]
                out.append(pd.DataFrame({"query_id": names[lo : lo + 128], "uid": ids[best], "score": top, "total": np.exp(score - top[:, None]).sum(axis=1)}))
        return pd.concat(out[1:] or out)

    parts = q.groupBy("_on", "part", "b").cogroup(c.groupBy("_on", "part", "b")).applyInPandas(run, _hit_schema(queries, classes) + ", total double")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uid"))
    most = F.max("score").over(Window.partitionBy("query_id"))
    total = F.sum(F.col("total") * F.exp(F.col("score") - most)).over(Window.partitionBy("query_id"))
    return parts.select("query_id", "uid", "score", first.alias("_n"), (1 / total).alias("share")).filter("_n = 1").drop("_n")


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, uid {kind(corpus, 'uid')}, score double"


def sparse_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, uid, score over shared tokens. Both sides in long form: id, token, weight."""
    q = queries.select("query_id", "token", F.col("weight").alias("wq"))
    c = corpus.select("uid", "token", F.col("weight").alias("wd"))
    return q.join(c, "token").groupBy("query_id", "uid").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def _long_form(df: DataFrame, key: str, same: str | None) -> DataFrame:
    """key, token, _on, weight: one row for each token of a row; rows with a null among them take no part."""
    on = F.col(same) if same else F.lit(0)
    kept = df.select(key, "token", on.alias("_on"), F.col("weight").cast("double").alias("weight")).dropna()
    return kept.groupBy(key, "token", "_on").agg(F.sum("weight").alias("weight"))


def posting_parts(corpus: DataFrame, same: str | None = None, part_rows: int = 1 << 19) -> DataFrame:
    """uid, token, _on, weight, band, part: postings in parts of about ``part_rows``, each of rows of alike length.

    A band holds the rows whose vectors' lengths agree to a factor of sqrt(2), so the largest weights of its parts are alike too; a band is cut into
    as many parts as its size needs. A row stays whole. Postings are written first and counted, so that tasks grow in number, not in size.
    """
    corpus = checkpointed(corpus)
    c = _long_form(corpus.repartition(max(1, -(-corpus.count() // TASK_POSTINGS)), "uid"), "uid", same)
    length = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("uid", "_on"))
    c = checkpointed(c.withColumn("band", F.when(length > 0, F.floor(F.log2(length))).otherwise(-2000).cast("int")))
    sizes = c.groupBy(F.col("_on").alias("_v"), F.col("band").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts"))
    return c.join(sizes, (F.col("_on") == F.col("_v")) & (F.col("band") == F.col("_b"))).withColumn("part", F.pmod(F.xxhash64("uid"), "_parts")).drop("_v", "_b", "_parts")


def part_bounds(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """query_id, _on, band, part, bound: no row of the part scores above the bound; parts without a token of the query are left out."""
    largest = parts.groupBy("token", "_on", "band", "part").agg(F.max("weight").alias("hi"), F.min("weight").alias("lo"))
    w = F.col("weight")
    most = F.greatest(w * F.col("hi"), w * F.col("lo"), F.lit(0.0))
    total = queries.join(largest, ["token", "_on"]).groupBy("query_id", "_on", "band", "part").agg(F.sum(most).alias("bound"))
    return total.withColumn("bound", F.col("bound") * (1 + 1e-9))  # sums differ in their last digits by order


_PART = ["_on", "band", "part"]


def _score_parts(pairs: DataFrame, queries: DataFrame, parts: DataFrame, k: int, block: int, schema: str) -> DataFrame:
    """query_id, uid, score: the best k of each part for each query that ``pairs`` (query_id, _on, band, part) sends there.

    A part is copied once for each ``block`` of the queries it gets, and not at all without one. A task holds one part and one block, and
    adds up a few queries at a time.
    """
    blocks = pairs.groupBy(*_PART).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    sent = pairs.join(blocks, _PART).select("query_id", *_PART, F.pmod(F.xxhash64("query_id"), "_blocks").alias("b"))
    left = sent.join(queries, ["query_id", "_on"]).select("query_id", "token", "weight", "b", *[F.col(x).alias(x) for x in _PART])  # columns of its own, told from the parts'
    right = parts.join(blocks, _PART).select("uid", "token", "weight", *_PART, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("b"))

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "uid": [], "score": []}, dtype=object)]
        if len(q) and len(c):
            rows, ids = pd.factorize(c["uid"], sort=True)
            tokens, names = pd.factorize(c["token"])
            by_token = np.argsort(tokens, kind="stable")
            rows, weights = rows[by_token], c["weight"].to_numpy()[by_token]
            starts = np.searchsorted(tokens[by_token], np.arange(len(names) + 1))
            q = q.assign(at=pd.Index(names).get_indexer(q["token"])).query("at >= 0").sort_values(["query_id", "at"], kind="stable")
            own, asked = pd.factorize(q["query_id"])
            at, given = q["at"].to_numpy(), q["weight"].to_numpy()
            cuts = np.searchsorted(own, np.arange(len(asked) + 1))
            few = max(1, (1 << 21) // len(ids))
            for lo in range(0, len(asked), few):
                hi = min(lo + few, len(asked))
                score, shared = np.zeros((hi - lo, len(ids))), np.zeros((hi - lo, len(ids)), dtype=bool)
                for x in range(cuts[lo], cuts[hi]):  # a token has a row once at most
                    posting = slice(starts[at[x]], starts[at[x] + 1])
                    score[own[x] - lo, rows[posting]] += given[x] * weights[posting]
                    shared[own[x] - lo, rows[posting]] = True
                for j in range(hi - lo):
                    found = np.flatnonzero(shared[j])
                    best = found[best_columns(score[j : j + 1, found], k)[1]]
                    out.append(pd.DataFrame({"query_id": asked[lo + j], "uid": ids[best], "score": score[j, best]}))
        return pd.concat(out[1:] or out)

    return left.groupBy(*_PART, "b").cogroup(right.groupBy(*_PART, "b")).applyInPandas(run, schema)


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int, same: str | None = None, block: int = 4096, part_rows: int = 1 << 19) -> DataFrame:
    """query_id, uid, score, rank: the k corpus rows with the largest sums over shared tokens; rows without one don't count.

    Both sides in long form: id, token, weight, and column ``same`` if they must agree in one. Tokens of a row that come twice add up; rows of either
    side with a null take no part; weights may be negative. Ties go to the smaller uid.
    Exact, with bounds: a query is scored against the part with its largest bound first, and then only against parts whose bound reaches the k-th score
    it found there. Postings are copied once for each ``block`` of queries that still need their part, at most 1 + queries / block times, twice rounded up.
    """
    q = checkpointed(_long_form(queries, "query_id", same))
    parts = checkpointed(posting_parts(corpus.join(q.select("token").distinct(), "token", "left_semi"), same, part_rows))
    schema = _hit_schema(queries, corpus)
    bounds = part_bounds(q, parts)
    if parts.select(*_PART).distinct().limit(2).count() < 2:  # nothing to skip
        return top_k(_score_parts(bounds.select("query_id", *_PART), q, parts, k, block, schema), "query_id", "score", "uid", k)
    bounds = checkpointed(bounds)
    best = bounds.groupBy("query_id").agg(F.max_by(F.struct(*_PART), F.struct("bound", *_PART)).alias("p")).select("query_id", "p.*")
    first = checkpointed(top_k(_score_parts(best, q, parts, k, block, schema), "query_id", "score", "uid", k))
    reached = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    others = bounds.join(best, ["query_id", *_PART], "left_anti").join(reached, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    more = _score_parts(others.select("query_id", *_PART), q, parts, k, block, schema)
    return top_k(first.drop("rank").unionByName(more), "query_id", "score", "uid", k)


def allowed_scores(queries: DataFrame, corpus: DataFrame, allowed: DataFrame) -> DataFrame:
    """query_id, uid, score of the allowed pairs that share a token: postings are met by row and token, so no other pair is ever scored."""
    q = queries.select("query_id", "token", F.col("weight").alias("wq"))
    c = corpus.select("uid", "token", F.col("weight").alias("wd"))
    pairs = allowed.select("query_id", "uid").distinct()
    return pairs.join(q, "query_id").join(c, ["uid", "token"]).groupBy("query_id", "uid").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], k0: int = 60) -> DataFrame:
    """lists: query_id, uid, rank (from 1). query_id, uid, score: the sum of 1 / (k0 + rank)."""
    every = lists[0].select("query_id", "uid", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "uid", "rank"))
    return every.groupBy("query_id", "uid").agg(F.sum(1.0 / (k0 + F.col("rank"))).alias("score"))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5) -> DataFrame:
    every = dense.select("query_id", "uid", (alpha * F.col("score")).alias("s")).unionByName(sparse.select("query_id", "uid", ((1 - alpha) * F.col("score")).alias("s")))
    return every.groupBy("query_id", "uid").agg(F.sum("s").alias("score"))


def hybrid_search(dense: DataFrame, sparse: DataFrame, k: int = 30, k0: int = 60) -> DataFrame:
    return top_k(reciprocal_rank_fusion([dense, sparse], k0), "query_id", "score", "uid", k)


def allowed_tag_search(scores: DataFrame, allowed: DataFrame, k: int = 50) -> DataFrame:
    """The best k of the (query_id, uid) pairs that are allowed; the filter holds before the cut."""
    return top_k(scores.join(allowed.select("query_id", "uid").distinct(), ["query_id", "uid"], "left_semi"), "query_id", "score", "uid", k)


def expand_queries(df: DataFrame, uid: str, text: Column, bt: Column, stripped: Column) -> DataFrame:
    """uid, kind, query, bt: up to three queries a row, within the type, over all, and without brands."""
    kinds = F.array(
        F.when(~T.blank(bt), F.struct(F.lit("filtered").alias("kind"), text.alias("query"), bt.alias("bt"))),
        F.struct(F.lit("open").alias("kind"), text.alias("query"), F.lit(None).cast("string").alias("bt")),
        F.when((stripped != text) & (stripped != ""), F.struct(F.lit("stripped").alias("kind"), stripped.alias("query"), F.lit(None).cast("string").alias("bt"))),
    )
    return df.select(uid, F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("q")).select(uid, "q.kind", "q.query", "q.bt")


def candidate_pool(hits: DataFrame, query: str = "query_id", text: str = "clean_text", size: int = 15) -> DataFrame:
    """The best ``size`` distinct texts of each query, each with its best hit."""
    per_text = hits.withColumn("_n", F.row_number().over(Window.partitionBy(query, text).orderBy(F.desc("score"), "uid"))).filter("_n = 1").drop("_n")
    return top_k(per_text, query, "score", "uid", size, "pool_rank")


def rerank(pairs: DataFrame, left: str, right: str, scorer: Scorer | None, out: str = "rerank_score") -> DataFrame:
    """``pairs`` with a score for each; each distinct pair is scored once; without a scorer or a score it is -10."""
    if scorer is None:
        return pairs.withColumn(out, F.lit(UNSCORED))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_s=[float(x) for x in scorer(list(zip(pdf["_l"], pdf["_r"], strict=True)))])

    scored = pairs.select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct().mapInPandas(run, "_l string, _r string, _s double")
    return pairs.join(scored, (F.col(left) == F.col("_l")) & (F.col(right) == F.col("_r")), "left").withColumn(out, F.coalesce("_s", F.lit(UNSCORED))).drop("_l", "_r", "_s")


def token_logit(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic stand-in for a reranker."""
    return [S.token_sort(a or "", b or "") / 10 - 5 for a, b in pairs]


def reconcile_hashes(remote: DataFrame, local: DataFrame) -> DataFrame:
    """uid, row_hash of both sides; the local one holds where both have it."""
    r, l = remote.select("uid", F.col("row_hash").alias("_r")), local.select("uid", F.col("row_hash").alias("_l"))
    return r.join(l, "uid", "full_outer").select("uid", F.coalesce("_l", "_r").alias("row_hash"))


def near_pairs(vectors: DataFrame, least: float, block: int = 8192, strip: int = 1024) -> DataFrame:
    """a, b (a < b by id) of vectors with dot product >= least, exactly: uid, vector in blocks of rows, each pair of blocks one task.

    A row travels once for each block, so larger blocks shuffle less; the product is taken in strips, which bounds memory.
    Give vectors that differ: copies make a pair with each other.
    """
    blocks = max(1, -(-vectors.count() // block))
    rows = vectors.select("uid", "vector", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("i"))
    left = rows.select("uid", "vector", "i", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))).alias("j"))
    right = rows.select("uid", "vector", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"), F.col("i").alias("j"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
        if len(x) and len(y):
            u, v = x["uid"].to_numpy(), y["uid"].to_numpy()
            left, right = np.stack(x["vector"].tolist()).astype(float), np.stack(y["vector"].tolist()).astype(float).T
            for at in range(0, len(u), strip):
                k, m = np.nonzero(left[at : at + strip] @ right >= least)
                a, b = np.minimum(u[at + k], v[m]), np.maximum(u[at + k], v[m])
                out.append(pd.DataFrame({"a": a, "b": b})[a < b].drop_duplicates())
        return pd.concat(out).drop_duplicates()

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "a long, b long")


def first_come(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """uid of the rows that a scan in order of uid keeps, where a row goes if it has an edge to one kept before. rows: uid; edges: a, b with a < b.

    Rounds: a row without an undecided earlier neighbour is kept, and its later neighbours go. A row with one undecided earlier neighbour has the
    opposite fate of it; such rows point to that neighbour, and every round each pointer is replaced by its target's, with the fates
    multiplied, so that a chain of n rows is decided in about log2(n) rounds. The first undecided row is always decided, so rounds end by
    themselves; the state of each is checkpointed, and pairs with a decided row are left out of the next.
    """
    open_, edges = checkpointed(rows.select("uid").distinct()), checkpointed(edges.select("a", "b").distinct())
    kept = open_.limit(0)
    fresh = kept.select("uid", F.lit(True).alias("stays"))  # decided in the last round
    points = kept.select("uid", F.col("uid").alias("to"), F.lit(True).alias("alike"))  # uid has the fate of ``to``, or the opposite
    rounds = 0
    while open_.take(1):
        before = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).withColumnRenamed("b", "uid")
        free = open_.join(before, "uid", "left_anti").select("uid", F.lit(True).alias("stays"))
        single = before.filter("n = 1").join(points, "uid", "left_anti").select("uid", F.col("a").alias("to"), F.lit(False).alias("alike"))
        points = points.unionByName(single)
        beyond = points.select(F.col("uid").alias("to"), F.col("to").alias("_to"), F.col("alike").alias("_alike"))
        doubled = points.join(beyond, "to", "left").select("uid", F.coalesce("_to", "to").alias("to"), (F.col("alike") == F.coalesce("_alike", F.lit(True))).alias("alike"))
        points = checkpointed(doubled.join(fresh.select(F.col("uid").alias("to"), F.col("stays").alias("fate")), "to", "left").select("uid", "to", "alike", "fate"))
        known = free.unionByName(points.filter("fate IS NOT NULL").select("uid", (F.col("alike") == F.col("fate")).alias("stays")))
        gone = edges.join(known.filter("stays").select(F.col("uid").alias("a")), "a", "left_semi").select(F.col("b").alias("uid"), F.lit(False).alias("stays"))
        fresh = checkpointed(known.unionByName(gone).groupBy("uid").agg(F.min("stays").alias("stays")))
        kept = kept.unionByName(fresh.filter("stays").select("uid"))
        open_ = checkpointed(open_.join(fresh, "uid", "left_anti"))
        edges = checkpointed(edges.join(open_.withColumnRenamed("uid", "a"), "a", "left_semi").join(open_.withColumnRenamed("uid", "b"), "b", "left_semi").select("a", "b"))
        points = points.join(open_, "uid", "left_semi").select("uid", "to", "alike")
        rounds += 1
        if rounds % 20 == 0:  # keeps the plan short
            kept = checkpointed(kept)
    return kept


def semantic_dedup(spark: SparkSession, vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """uid of the rows that a scan in order of uid keeps, dropping each that is too near to one kept before.

    Equal vectors share the fate of their first row, so only that one is compared: copies of it go, unless it is too short to be near
    itself, in which case they stay where it stays. Rows without a vector are near to nothing and stay.
    The scan itself is ``first_come``.
    """
    own = vectors.filter(F.col("vector").isNotNull())
    first = checkpointed(own.groupBy("vector").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n")))
    kept = first_come(first.select("uid"), near_pairs(first.select("uid", "vector"), least))
    bare = vectors.filter(F.col("vector").isNull()).select("uid")
    short = first.filter((F.col("n") > 1) & (S.dot(F.col("vector"), F.col("vector")) < least)).join(kept, "uid", "left_semi")
    copies = own.join(short.select("vector", F.col("uid").alias("_first")), "vector").filter(F.col("uid") != F.col("_first")).select("uid")
    return kept.union(copies).union(bare)
