"""A prefix trie over conversations that are rebuilt from a shared head and their own turns, without writing out rebuilt texts.

A turn's hash is an element; a sequence of turns is the pair (length, value) of a polynomial over a prime field of 127 bits, and two
sequences join by (m, a)(n, b) = (m + n, a B^n + b). This is a monoid, so products are made of parts in any grouping: a
conversation's own suffix is scanned in blocks of rows, block products are carried on, and the head's product, taken from its base
conversation, is put before it by one multiplication. Members of the trie are (conversation, depth, product) rows with a reference
to the stored turn they end in; equal depth and product make a node.

Products are then proved. All own turns that end in one node are fetched by their references and their bytes compared
(smallest against largest, combined before the shuffle). Product and last turn settle the parent's product, so equality follows
from depth to depth. Should any two differ, another multiplier and other hashes are drawn and the trie is made again.

Sums over subtrees need no walk. The nodes whose smallest member is conversation r are the tail of r's own path, so a node's
subtree is the tails of its members, less the part of its own tail above it: sums by conversation, then by node.

Scale: rows are turns, narrow but for the comparison; positions come from a range sort over turns, so that a conversation
of a third of all turns is split; joins on a hot conversation or node are plain equi-joins that adaptive execution splits; the ids
that end in a node are put into strings of bounded length where they are sorted, and hashed as a stream.

Cases: a null role or text is empty; rows with a null conv_id belong to no conversation; turns of equal number stand by role, then text,
null numbers first; repeated rows are turns each; a conversation whose turns all give way to a missing head is a member of
the root alone; remainders of negative ids have the id's sign; an empty table gives no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, row_ids, stage, table

#: Fixed value: the field's prime.
PRIME = (1 << 127) - 1
#: The query's heads: from the conversation at the start of each hundred, so many turns less one at most.
HUNDRED, HEADS = 100, 6
#: Turns of a block that is scanned at once; ids in a string of those that end in a node.
BLOCK_BITS, IDS = 12, 4096
EMPTY = bytes(16)


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _binary(n: int) -> bytes:
    return n.to_bytes(16, "big")


class Monoid:
    """Products of turn hashes for one draw of multiplier and hashes."""

    def __init__(self, seed: int, prime: int = PRIME):
        self.seed, self.prime = seed, prime
        self.base = 2 + int.from_bytes(hashlib.sha256(f"multiplier {seed}".encode()).digest(), "big") % (prime - 2)
        self.inverse = pow(self.base, -1, prime)

    def element(self, role: Column, text: Column) -> Column:
        """A turn's 16 bytes."""
        parts = [F.lit(str(self.seed)), F.octet_length(role).cast("string"), F.concat(role, text)]
        return F.unhex(F.md5(F.concat_ws(":", *parts).cast("binary")))

    def then(self, left: int, right: int, length: int) -> int:
        """The value of ``left`` followed by ``right``, which has ``length`` turns."""
        return (left * pow(self.base, length, self.prime) + right) % self.prime if left else right

    def before(self, value: int, element: bytes) -> int:
        """The value without its last turn."""
        return (value - _number(element)) * self.inverse % self.prime


def draws() -> Iterator[Monoid]:
    seed = 0
    while True:
        yield Monoid(seed)
        seed += 1


def ordered_turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and row, by conversation and turn in the order of rows, stored in the shared folder."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turn = F.col("turn").asc_nulls_first()
    # a range is chosen by the starts of texts, so that no long text is among the sampled bounds
    ranged = turns.repartitionByRange("conv_id", turn, F.substring("role", 1, 32), F.substring("text", 1, 64))
    return row_ids(spark, stage(spark, ranged.sortWithinPartitions("conv_id", turn, "role", "text").drop("turn"), "turns"), "ref")


def _scan(monoid: Monoid):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a block of rows: each conversation's own turns, with the product from its first row in the block on and that product's length."""
        own = pdf[pdf["i"] > pdf["skip"]].sort_values(["conv_id", "i"])
        values, lengths, of, value, k = [], [], None, 0, 0
        for c, e in zip(own["conv_id"], own["element"], strict=True):
            if c != of:
                of, value, k = c, 0, 0
            value, k = (value * monoid.base + _number(e)) % monoid.prime, k + 1
            values.append(_binary(value))
            lengths.append(k)
        return own.assign(value=values, k=lengths)[["conv_id", "block", "i", "k", "ref", "points", "element", "value"]]

    return run


def _carries(monoid: Monoid):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value, out = 0, []
        for block, k, v in pdf.sort_values("block")[["block", "k", "value"]].itertuples(index=False):
            out.append(_binary(value))
            value = monoid.then(value, _number(v), k)
        return pdf.sort_values("block")[["conv_id", "block"]].assign(carried=out)

    return run


def own_products(spark: SparkSession, turns: DataFrame, monoid: Monoid, skip: Column) -> tuple[DataFrame, DataFrame]:
    """conv_id and n of each conversation; and of each turn after its first ``skip`` ones the product from there on, with place i from 1.

    skip: of conv_id; turns before it are left out.
    """
    narrow = turns.select("conv_id", "ref", F.char_length("text").cast("long").alias("points"), monoid.element(F.col("role"), F.col("text")).alias("element"))
    placed = stage(spark, numbered(spark, narrow.withColumn("id", F.col("ref")), "place", "id"), "turn-places")
    convs = stage(spark, placed.groupBy("conv_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")), "conversations")
    block = F.shiftright("place", BLOCK_BITS)
    ends = convs.select(F.col("conv_id").alias("c"), "start", (F.shiftright("start", BLOCK_BITS) != F.shiftright(F.col("start") + F.col("n") - 1, BLOCK_BITS)).alias("wide"))
    rows = placed.join(ends, F.col("conv_id") == F.col("c")).select("conv_id", block.alias("block"), (F.col("place") - F.col("start") + 1).alias("i"), skip.cast("long").alias("skip"), "ref", "points", "element", "wide")
    rows = stage(spark, rows, "turn-rows")
    schema = "conv_id long, block long, i long, k long, ref long, points long, element binary, value binary"
    scanned = stage(spark, rows.groupBy("block").applyInPandas(_scan(monoid), schema), "turn-products")
    # conversations on more than one block: two of a block at most
    wide = rows.filter("wide").select(F.col("conv_id").alias("c"), F.col("block").alias("b")).distinct()
    parts = scanned.join(wide, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b"))).groupBy("conv_id", "block").agg(F.max(F.struct("k", "value")).alias("m")).select("conv_id", "block", "m.k", "m.value")
    carries = stage(spark, parts.groupBy("conv_id").applyInPandas(_carries(monoid), "conv_id long, block long, carried binary"), "carries")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            carried = [EMPTY if c is None else c for c in pdf["carried"]]
            values = [_binary(monoid.then(_number(c), _number(v), k)) for c, v, k in zip(carried, pdf["value"], pdf["k"], strict=True)]
            yield pdf.assign(value=values)[["conv_id", "i", "ref", "points", "element", "value"]]

    carries = carries.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "carried")
    joined = scanned.join(carries, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")
    return convs.select("conv_id", "n"), stage(spark, joined.mapInPandas(carry, "conv_id long, i long, ref long, points long, element binary, value binary"), "own-products")


MEMBER = "conv_id long, depth long, value binary, parent binary, points long, ref long, ends boolean"


def members(spark: SparkSession, turns: DataFrame, monoid: Monoid, base: Column, head: Column, most: int) -> DataFrame:
    """A row for each rebuilt conversation and each of its prefixes, the empty one too. base, head: of conv_id; head is ``most`` at most."""
    skip = F.when(F.col("conv_id") == base, F.lit(0)).otherwise(head)
    convs, own = own_products(spark, turns, monoid, skip)
    # a base's first turns: ``most`` in a row at most
    first = own.filter((F.col("conv_id") == base) & (F.col("i") <= most)).groupBy(F.col("conv_id").alias("of"))
    heads = first.agg(F.array_sort(F.collect_list(F.struct("i", "value", "points"))).alias("all"))
    known = convs.select("conv_id", "n", base.alias("base"), skip.cast("int").alias("skip")).join(heads, F.col("base") == F.col("of"), "left")
    known = known.withColumn("head", F.when((F.col("skip") > 0) & F.col("all").isNotNull(), F.slice("all", 1, F.col("skip"))).otherwise(F.slice(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(EMPTY).alias("value"), F.lit(0).cast("long").alias("points"))), 1, 0)))
    known = known.select("conv_id", "skip", "head", F.size("head").cast("long").alias("g"), (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("skip"))).alias("total"))
    known = stage(spark, known, "heads")
    at_root = known.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(EMPTY).alias("value"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("points"), F.lit(None).cast("long").alias("ref"), (F.col("total") == 0).alias("ends"))
    shared = known.select("conv_id", "head", "total", F.posexplode("head").alias("j", "turn")).select(
        "conv_id", F.col("turn.i").alias("depth"), "turn.value", F.when(F.col("j") > 0, F.get("head", F.col("j") - 1)["value"]).otherwise(F.lit(EMPTY)).alias("parent"), "turn.points", F.lit(None).cast("long").alias("ref"), (F.col("turn.i") == F.col("total")).alias("ends")
    )

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = pdf["i"] - pdf["skip"]
            values = [monoid.then(_number(h), _number(v), n) for h, v, n in zip(pdf["before"], pdf["value"], k, strict=True)]
            parents = [_binary(monoid.before(v, e)) for v, e in zip(values, pdf["element"], strict=True)]
            depth = pdf["g"] + k
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "depth": depth, "value": [_binary(v) for v in values], "parent": parents, "points": pdf["points"], "ref": pdf["ref"], "ends": depth == pdf["total"]})

    before = F.when(F.col("g") > 0, F.element_at("head", -1)["value"]).otherwise(F.lit(EMPTY))
    joined = own.join(known.select(F.col("conv_id").alias("c"), "skip", before.alias("before"), "g", "total"), F.col("conv_id") == F.col("c")).drop("c")
    combined = joined.mapInPandas(combine, MEMBER)
    return stage(spark, at_root.union(shared).union(combined), "members")


def proved(turns: DataFrame, rows: DataFrame, nodes: DataFrame) -> bool:
    """Whether all turns that end in one node have the same bytes. Heads refer to a base's own turns, so own turns are enough."""
    several = nodes.filter("refs > 1").select(F.col("depth").alias("d"), F.col("value").alias("v"))
    refs = rows.filter("ref IS NOT NULL").join(several, (F.col("depth") == F.col("d")) & (F.col("value") == F.col("v"))).select("depth", "value", F.col("ref").alias("of"))
    turn = F.struct("role", "text")
    met = refs.join(turns, F.col("of") == F.col("ref")).groupBy("depth", "value").agg(F.min(turn).alias("a"), F.max(turn).alias("b"))
    return not met.filter("a <> b").take(1)


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and conv_id to strings of IDS ids at most."""
    columns = ["depth", "value", "first", "ids"]
    node, ids = None, []
    for pdf in batches:
        out = []
        for d, v, c in zip(pdf["depth"], pdf["value"], pdf["conv_id"], strict=True):
            if node != (d, v) or len(ids) == IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = (d, v), []
            ids.append(c)
        yield pd.DataFrame(out, columns=columns)
    if ids:
        yield pd.DataFrame([(*node, ids[0], ",".join(map(str, ids)))], columns=columns)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings sorted by node and first id to one digest a node; what is held is a digest's state."""
    node, state = None, None
    for pdf in batches:
        out = []
        for d, v, ids in zip(pdf["depth"], pdf["value"], pdf["ids"], strict=True):
            if node == (d, v):
                state.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, state.hexdigest()))
            node, state = (d, v), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["depth", "value", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "value", "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """depth, value and the digest of the ids, in order, of the conversations that end there."""
    order = ["depth", "value", "conv_id"]
    strings = rows.filter("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_strings, "depth long, value binary, first long, ids string")
    return strings.repartition("depth", "value").sortWithinPartitions("depth", "value", "first").mapInPandas(_digests, "depth long, value binary, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame, base: Column, head: Column, most: int, monoids: Iterable[Monoid] | None = None) -> DataFrame:
    """A row for each node: see op12_conversation_trie(). base, head: of conv_id, the conversation whose turns come first and how many; head is ``most`` at most."""
    turns = ordered_turns(spark, conversations)
    for monoid in monoids or draws():
        rows = members(spark, turns, monoid, base, head, most)
        found = rows.groupBy("depth", "value").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("points").alias("points"), F.count("ref").alias("refs"))
        found = stage(spark, found, "nodes")
        if proved(turns, rows, found):
            break
    else:
        raise ValueError("no draw told all prefixes apart")
    below = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("d"), F.col("parent").alias("v")).agg(F.count(F.lit(1)).alias("n_children"))
    above = found.select((F.col("depth") + 1).alias("d"), F.col("value").alias("v"), F.col("conv_id").alias("parent_conv_id"))
    on = lambda value: (F.col("depth") == F.col("d")) & (F.col(value) == F.col("v"))
    nodes = found.join(below, on("value"), "left").drop("d", "v").join(above, on("parent"), "left").drop("d", "v")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saved", (F.col("n_convs") - 1) * F.col("points"))
    nodes = stage(spark, nodes.select("depth", "value", "conv_id", "parent_conv_id", "n_convs", "n_children", "saved", F.shiftright("depth", BLOCK_BITS).alias("block")), "linked-nodes")
    # along a conversation's tail: what stands above a node, in two levels
    earlier = lambda w: F.coalesce(F.sum("saved").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved")).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), earlier(Window.partitionBy("conv_id").orderBy("block")).alias("blocks_above"))
    tails = nodes.withColumn("above", earlier(Window.partitionBy("conv_id", "block").orderBy("depth"))).join(blocks, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")))
    tails = tails.select("depth", "value", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("above") + F.col("blocks_above")).alias("above"))
    totals = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("saved").alias("tail"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    sums = rows.join(totals, F.col("conv_id") == F.col("c")).groupBy(F.col("depth").alias("d"), F.col("value").alias("v")).agg(F.sum("tail").alias("tails"), F.sum("leaf").alias("n_leaves"))
    sums = stage(spark, sums, "subtree-sums")
    ends = stage(spark, end_digests(rows).select(F.col("depth").alias("de"), F.col("value").alias("ve"), "ends_sha256"), "ends")
    none = hashlib.sha256().hexdigest()
    return (
        tails.join(sums, on("value"))
        .join(ends, (F.col("depth") == F.col("de")) & (F.col("value") == F.col("ve")), "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("tails") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    c = F.col("conv_id")
    return prefix_trie(spark, table(spark, sf_dir, "conversations"), c - c % HUNDRED, F.crc32(c.cast("string").cast("binary")) % HEADS, HEADS - 1)


#: Prefixes as strings of 33 characters a turn; each node meets its ancestors.
ORACLE = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS remainder
  FROM range(256) r(i)),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, n, conv_id - conv_id % {HUNDRED} AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, x: xor(c >> 8, remainder[xor(c & 255, x) + 1])), 4294967295) % {HEADS} AS h
  FROM n, crc),
g AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS g FROM c LEFT JOIN n b ON b.conv_id = c.base),
rebuilt AS (
  SELECT g.conv_id, t.i AS d, role, text FROM g JOIN t ON t.conv_id = g.base AND t.i <= g.h
  UNION ALL
  SELECT g.conv_id, t.i - g.h + g.g, role, text FROM g JOIN t ON t.conv_id = g.conv_id AND t.i > g.h),
m AS (
  SELECT conv_id, d, length(text) AS points,
         string_agg(md5(strlen(role) || ':' || role || text), ',') OVER w || ',' AS key, d = max(d) OVER (PARTITION BY conv_id) AS ends
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY d)
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM c),
nodes AS (
  SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(points) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY key, d),
children AS (SELECT substr(key, 1, 33 * (depth - 1)) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
x AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
subtrees AS (
  SELECT substr(key, 1, 33 * k) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM x) GROUP BY 1)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN subtrees USING (key) LEFT JOIN nodes p ON x.depth > 0 AND p.key = substr(x.key, 1, 33 * (x.depth - 1))
"""
