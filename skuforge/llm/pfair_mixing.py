"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows, in a fixed pseudo-random order, form blocks. With weight w of a total W, block j of a source may go out
from slot floor(j W / w) and must be out by slot ceil((j + 1) W / w). Earliest deadline first over the blocks released
by then fills every slot, and keeps every source less than one block from its share at every moment. Releases and
deadlines repeat after W slots, so one period (W is bounded by ``parts`` plus the number of sources) is scheduled by a fold
in a single row, and every block finds its slot by arithmetic: nothing sequential grows with the data.

No row is dropped or repeated. Where a source has run out its slots stay empty, so the others go on in the proportion of their
weights. By default a source's weight is the square root of its row count (temperature one half), in ``parts`` parts.

Scale: a row's place in its source is the count of rows in smaller hash buckets, plus a row number within its bucket. Buckets are
bounded in size, so a source with a third of all rows is many windows, not one. The counts are added up in two levels, so the longest
window of them has a row for 4096 buckets, or 16 million rows. The fold over a period costs its length times the number of sources:
it is meant for thousands of sources at most.

Cases: a null source is a source of its own, named '' as an empty one is; null doc_ids sort by the hash of ''; repeated
rows each get a place; a source missing from given weights gets weight 1; an empty table gives no rows; a column of the input
whose name is added here (block, slot, release, deadline, place) is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

PARTS, BLOCK_ROWS, BUCKET_ROWS = 240, 16, 4096
#: Last hexadecimal digits of a bucket's name; buckets alike but for these are a group.
GROUP_DIGITS = 3
ADDED = ["block", "slot", "release", "deadline", "place"]


def source_weights(counts: DataFrame, parts: int) -> DataFrame:
    """counts: src, n. Integer weights, one at least, by the square root of n."""
    total = F.sum(F.sqrt("n")).over(Window.partitionBy())
    return counts.select("src", F.greatest(F.lit(1).cast("long"), F.floor(parts * F.sqrt("n") / total)).alias("w"))


def _edf(weights: Column, total: Column) -> Column:
    """The source (as a position in ``weights``) of each slot of one period."""
    k = F.size(weights)

    def step(acc: Column, t: Column) -> Column:
        issued = acc["issued"]

        def job(i: Column) -> Column:
            c, w = F.get(issued, i), F.get(weights, i)
            released = (c < w) & (F.floor(c * total / w) <= t)
            return F.when(released, F.struct(F.ceil((c + 1) * total / w).alias("d"), i.alias("i")))

        pick = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), k - 1), job), lambda s: s.isNotNull()))["i"]
        bumped = F.transform(issued, lambda c, i: c + F.when(i == pick, 1).otherwise(0).cast("long"))
        return F.struct(bumped.alias("issued"), F.concat(acc["picks"], F.array(pick)).alias("picks"))

    start = F.struct(F.transform(weights, lambda w: w * 0).alias("issued"), F.filter(F.array(F.lit(0)), lambda x: x < 0).alias("picks"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, step)["picks"]


def period(weights: DataFrame) -> DataFrame:
    """weights: src, w. src, w, total, r, slot: where the r-th block of a period goes, a row for each of the period's slots."""
    one = weights.agg(F.array_sort(F.collect_list(F.struct("src", "w"))).alias("a"), F.sum("w").alias("total")).filter("total > 0")
    picks = one.select("a", "total", _edf(F.transform("a", lambda s: s["w"]), F.col("total")).alias("picks"))
    slots = picks.select("a", "total", F.posexplode("picks").alias("slot", "i"))
    r = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    return slots.select(F.get("a", "i")["src"].alias("src"), F.get("a", "i")["w"].alias("w"), "total", r.cast("long").alias("r"), F.col("slot").cast("long").alias("slot"))


def mix(spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with block, slot, release, deadline and place (in the block). Order by slot, place to get the mixture."""
    # the input's columns travel in one struct, so that their names can't clash with the ones used here
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*kept).alias("doc")).withColumns({"_src": F.coalesce(F.col("doc.source").cast("string"), F.lit("")), "_key": F.md5(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")).cast("binary"))})
    counts = stage(spark, rows.groupBy(F.col("_src").alias("src")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(n, 1) / BUCKET_ROWS, 16)) + 1) if n > BUCKET_ROWS else 1
    rows = rows.withColumn("_bucket", F.substring("_key", 1, digits))
    if weights is None:
        weights = source_weights(counts, parts)
    else:
        weights = counts.join(weights.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("src")).agg(F.max("weight").cast("long").alias("w")), "src", "left").select("src", F.greatest(F.lit(1).cast("long"), F.coalesce("w", F.lit(1))).alias("w"))
    plan = stage(spark, period(weights), "mix-period")
    sizes = rows.groupBy("_src", "_bucket").agg(F.count(F.lit(1)).alias("m"))
    # counts of smaller buckets in two levels: before a bucket's group of buckets, and within it
    group = F.substring("_bucket", 1, max(0, digits - GROUP_DIGITS))
    earlier = lambda by, order: F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stage(spark, sizes.withColumn("_group", group), "mix-sizes")
    groups = sizes.groupBy("_src", "_group").agg(F.sum("m").alias("m")).select(F.col("_src").alias("_s"), F.col("_group").alias("_g"), earlier(["_src"], "_group").alias("_before_group"))
    offsets = sizes.withColumn("_within", earlier(["_src", "_group"], "_bucket")).join(groups, (F.col("_src") == F.col("_s")) & (F.col("_group") == F.col("_g")))
    offsets = stage(spark, offsets.select(F.col("_src").alias("_s"), F.col("_bucket").alias("_b"), (F.col("_before_group") + F.col("_within")).alias("_before")), "mix-offsets")
    in_bucket = F.row_number().over(Window.partitionBy("_src", "_bucket").orderBy("_key", "doc.doc_id")) - 1
    ranked = rows.withColumn("_in", in_bucket).join(offsets, (F.col("_src") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rn", F.col("_before") + F.col("_in")).withColumn("block", F.floor(F.col("_rn") / block_rows))
    ws = F.broadcast(plan.groupBy("src", "w", "total").agg(F.array_sort(F.collect_list(F.struct("r", F.col("slot").alias("at")))).alias("turns")))  # one period: bounded by parts and the number of sources
    out = ranked.join(ws, F.col("_src") == F.col("src"))
    q, r = F.floor(F.col("block") / F.col("w")), F.col("block") % F.col("w")
    start = q * F.col("total")
    return out.select(
        "doc.*",
        "block",
        (start + F.get("turns", r.cast("int"))["at"]).alias("slot"),
        (start + F.floor(r * F.col("total") / F.col("w"))).alias("release"),
        (start + F.ceil((r + 1) * F.col("total") / F.col("w"))).alias("deadline"),
        (F.col("_rn") % block_rows).alias("place"),
    )


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents").select("doc_id", "source"))


ORACLE = f"""
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT src, greatest(1, CAST(floor({PARTS} * sqrt(n) / sum(sqrt(n)) OVER ()) AS BIGINT)) AS w FROM c),
l AS (SELECT list(w ORDER BY src) AS ws, list(src ORDER BY src) AS ss, CAST(sum(w) AS BIGINT) AS total FROM w),
step AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS issued, CAST(0 AS BIGINT) AS i FROM l
  UNION ALL
  SELECT t, list_transform(issued, lambda x, j: x + CASE WHEN j = i THEN 1 ELSE 0 END) AS issued, i
  FROM (
    SELECT s.t + 1 AS t, s.issued,
      list_min(list_filter(list_transform(range(1, len(ws) + 1),
        lambda j: CASE WHEN issued[j] < ws[j] AND (issued[j] * total) // ws[j] <= s.t + 1
                  THEN (((issued[j] + 1) * total + ws[j] - 1) // ws[j]) * 100000 + j END), lambda x: x IS NOT NULL)) % 100000 AS i
    FROM step s, l WHERE s.t + 1 < total) p),
turns AS (SELECT ss[i] AS src, ws[i] AS w, total, t AS slot, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS r FROM step, l WHERE t >= 0),
d AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rn
  FROM documents),
b AS (SELECT *, rn // {BLOCK_ROWS} AS block FROM d)
SELECT doc_id, source, block, (block // w) * total + slot AS slot, (block // w) * total + (r * total) // w AS release,
       (block // w) * total + ((r + 1) * total + w - 1) // w AS deadline, rn % {BLOCK_ROWS} AS place
FROM b JOIN turns USING (src) WHERE r = block % w
"""
