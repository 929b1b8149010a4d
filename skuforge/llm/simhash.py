"""SimHash near-duplicates by vantage-point trees.

Fingerprints are made where the texts lie; only (doc_id, 64 bits) moves on. Equal fingerprints become one class before
any search. A vantage-point tree, built from a bounded sample that decides cost alone, deals the classes to shards: at each
node those within a radius of the vantage point go inside, the others outside. Inside points whose distance is within the
link distance of the radius are also sent outside, so by the triangle inequality every linked pair meets in some shard.
Each shard goes on with its own vantage points down to small blocks, which are compared in full, and returns a spanning
forest of the links it found, never all pairs. Components come from stars over those forests, whose nodes are the fingerprints
themselves; a component's id is sought afterwards, so ids may be any longs.

Scale: radii are the lower fifth of the distances, as for random 64-bit prints a one-sided overlap then makes the tree's
total volume grow as n to the power of about 1.5 (2 without pruning). Shards are to grow as the fourth root of n: those that
the first tree leaves larger than four times that are sampled and split again where they lie, in salted parts, until none is.

Cases: null text counts as empty; texts without words have fingerprint zero and link like any other; with fewer words than
a shingle has, the whole sequence is the shingle; a null doc_id never names a component that has another id (its
component_id is null else); repeated rows give a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_long, id_text, small_batches, stage, table, text_or_empty
from .components import components

SAMPLE, SHARD_SAMPLE = 1 << 16, 1 << 13
MOST_TASKS = 20_000
BLOCK = 1024


def fingerprint(text: str, size: int = 3, at_once: int = 1 << 17) -> int:
    """64 bits, unsigned: a bit is 1 if set in over half the shingles' XXH64 with seed 42."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, len(a), at_once):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(a[lo : lo + at_once], b[lo : lo + at_once], strict=True)], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(a), bitorder="little").view("<u8")[0])


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    small_batches(spark)
    return id_long(docs.select(id_text(), text_or_empty().alias("text")).mapInPandas(run, "doc_id string, fp long"))


def distance(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def _split(x: np.ndarray, near: int, tries: int = 4) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """A vantage point, its radius, and positions inside and outside, border points in both.

    None if no try saves comparisons, as within a dense ball, where the overlap would multiply the points.
    """
    for k in range(min(tries, len(x))):
        v = x[(len(x) * k) // tries]
        d = distance(x, v)
        r = int(np.quantile(d, 0.2))
        inside, outside = np.flatnonzero(d <= r), np.flatnonzero(d > r - near)
        if len(inside) ** 2 + len(outside) ** 2 <= 0.98 * len(x) ** 2:
            return v, r, inside, outside
    return None


def build_tree(sample: np.ndarray, most: float, near: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inside, outside); a child below zero is shard -1 - child. most: sample points a shard."""
    nodes: list = []
    shards = 0
    todo = [(sample, None)]
    while todo:
        x, place = todo.pop()
        cut = _split(x, near) if len(x) > max(most, 8) else None
        if cut is None:
            shards += 1
            child = -shards
        else:
            child = len(nodes)
            nodes.append([int(cut[0]), cut[1], 0, 0])
            todo += [(x[cut[2]], (child, 2)), (x[cut[3]], (child, 3))]
        if place:
            nodes[place[0]][place[1]] = child
    return [tuple(n) for n in nodes]


def route(nodes: list[tuple[int, int, int, int]], x: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x, and the shard of each; border points have several."""
    found, todo = [], [(0 if nodes else -1, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            found.append((own, np.full(len(own), -1 - at)))
            continue
        v, r, inside, outside = nodes[at]
        d = distance(x[own], np.uint64(v))
        todo += [(inside, own[d <= r]), (outside, own[d > r - near])]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _compare(label: np.ndarray, own: np.ndarray, y: np.ndarray, near: int, rows: int = 256, columns: int = 8192) -> None:
    """Joins the groups of all linked pairs among ``own``; tiles that are one group already hold nothing new."""
    for lo in range(0, len(own), rows):
        for at in range(lo, len(own), columns):
            if (label[own[lo : lo + rows]] == label[own[lo]]).all() and (label[own[at : at + columns]] == label[own[lo]]).all():
                continue
            i, j = np.nonzero(np.bitwise_count(y[lo : lo + rows, None] ^ y[None, at : at + columns]) <= near)
            later = at + j > lo + i
            _union(label, own[lo + i[later]], own[at + j[later]])


def forest(x: np.ndarray, near: int) -> np.ndarray:
    """For each distinct fingerprint of a shard, the position of its group's first one; groups by links within the shard."""
    label, todo = np.arange(len(x)), [np.arange(len(x))]
    while todo:
        own = todo.pop()
        cut = _split(x[own], near) if len(own) > BLOCK else None
        if cut is None:
            _compare(label, own, x[own], near)
        else:
            todo += [own[cut[2]], own[cut[3]]]
    return label


def _unsigned(fp: pd.Series) -> np.ndarray:
    return fp.to_numpy(np.int64).view(np.uint64)


def _split_again(spark: SparkSession, dealt: DataFrame, most: float, near: int) -> DataFrame:
    """dealt: shard, fp. The same with every shard of more than ``most`` prints split by a tree of its own, if one helps."""
    done = None
    while True:
        sizes = stage(spark, dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("shard").alias("of"), "n"), "simhash-large")
        if not sizes.take(1):
            return dealt if done is None else done.union(dealt)
        mine = F.col("shard") == F.col("of")
        large = dealt.join(sizes, mine)
        first = large.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("fp")))).filter(F.col("rank") <= SHARD_SAMPLE)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes = build_tree(_unsigned(pdf["fp"]), max(most * len(pdf) / int(pdf["n"].iloc[0]), 64), near)
            return pd.DataFrame({"of": pdf["shard"].iloc[:1], "parts": [-(-int(pdf["n"].iloc[0]) // int(max(most, 1)))], "nodes": [pickle.dumps(nodes)], "splits": [bool(nodes)]})

        trees = stage(spark, first.select("shard", "n", "fp").groupBy("shard").applyInPandas(grow, "of long, parts long, nodes binary, splits boolean"), "simhash-trees")

        def deal(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"shard": [], "child": [], "fp": []}, dtype=np.int64)
            at, child = route(pickle.loads(tree["nodes"].iloc[0]), _unsigned(rows["fp"]), near)
            return pd.DataFrame({"shard": rows["shard"].iloc[0], "child": child, "fp": rows["fp"].to_numpy()[at]})

        split = trees.filter("splits")
        rows = dealt.join(split.select("of", "parts"), mine).select("shard", "fp", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
        copies = split.select(F.col("of").alias("shard"), "nodes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        again = rows.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(deal, "shard long, child long, fp long")
        # two shards that meet under one number cost comparisons and lose nothing
        again = stage(spark, again.select(F.xxhash64("shard", "child").alias("shard"), "fp"), "simhash-split")
        rest = dealt.join(split.select("of"), mine, "left_anti")
        done, dealt = rest if done is None else done.union(rest), again


def link_classes(spark: SparkSession, classes: DataFrame, near: int, most: float | None = None) -> DataFrame:
    """classes: fp (distinct). A spanning forest of the links, as u, v. most: prints a shard is to have."""
    n = classes.count()
    most = most or 400 * max(n, 1) ** 0.25
    sample = _unsigned(classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"])
    nodes = build_tree(sample, most * len(sample) / max(n, 1), near)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, shard = route(nodes, _unsigned(pdf["fp"]), near)
            yield pd.DataFrame({"shard": shard, "fp": pdf["fp"].to_numpy()[at]})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy(np.int64))
        label = forest(fp.view(np.uint64), near)
        child = label != np.arange(len(label))
        return pd.DataFrame({"u": fp[child], "v": fp[label[child]]})

    dealt = stage(spark, classes.mapInPandas(deal, "shard long, fp long"), "simhash-dealt")
    dealt = _split_again(spark, dealt, 4 * most, near)
    # a stated number of tasks: shards are small but take long, and would be coalesced by their bytes
    return dealt.repartition(min(MOST_TASKS, len(nodes) + 1), "shard").groupBy("shard").applyInPandas(search, "u long, v long")


def simhash_groups(spark: SparkSession, docs: DataFrame, near: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of ``docs``."""
    prints = stage(spark, fingerprints(spark, docs), "simhash")
    classes = stage(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(spark, link_classes(spark, classes.select("fp"), near))
    rooted = stage(spark, classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-roots")
    ids = rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    named = stage(spark, rooted.join(ids, F.col("root") == F.col("of")).select("fp", "component_id"), "simhash-named")
    return (
        prints.alias("p")
        .join(named.alias("n"), F.col("p.fp") == F.col("n.fp"))
        .select("p.doc_id", F.lower(F.lpad(F.hex("p.fp"), 16, "0")).alias("fingerprint"), "n.component_id")
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark, table(spark, sf_dir, "documents"))
