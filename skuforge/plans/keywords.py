"""Generic keywords of classified rows: what is certain, what a trained model says, and what hybrid search within the type's list finds.

Every keyword that is considered is one row (uid, tag, source, place, score), so the rules for flavors, lists and cuts are filters on
one table, and the table of decisions is what the result is made from.

The allowed list of a type enters before the search: rows meet the keywords of their own type alone (all keywords where a market
type has no list), then the nearest ones are kept. A food type without a list is not searched at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.functions import text as T
from skuforge.operators import classify as G
from skuforge.operators import entities as D
from skuforge.operators import vectors as V
from skuforge.plans.matcher import Tools, _none, _tokens
from skuforge.sources.shared import settled, together

#: Keywords a search returns for a row from either side, and after fusion.
SEARCHED, FUSED = 50, 30
#: Where a keyword may come from, in the order of the final list.
SOURCES = ("umbrella", "propagated", "type", "literal", "trained", "synthetic", "search")
EVERY = ""


@dataclass(frozen=True)
class Keywords:
    """rows: uid, gk, gk_confidence; considered: every keyword considered, with its source, score, and what was decided."""

    rows: DataFrame
    considered: DataFrame


def key(c: Column | str) -> Column:
    return F.lower(F.trim(c))


def _long(rows: DataFrame, tags: Column, source: str) -> DataFrame:
    """uid, tag, source, place of an array of tags for each row."""
    return rows.select("uid", F.posexplode(F.coalesce(tags, _none())).alias("place", "tag")).select("uid", "tag", F.lit(source).alias("source"), F.col("place").cast("double").alias("place"))


def certain(rows: DataFrame, propagated: DataFrame, umbrella: DataFrame, listed: DataFrame) -> DataFrame:
    """uid, tag, source, place: umbrella tags, propagated ones, the type where it is a keyword of any type, and keywords in the name.

    rows: uid, name, bt, type, known (the type's list, or null). Names are searched for the type's list, or where there is none for all keywords.
    """
    own = rows.join(umbrella.select(key("basictype").alias("_u"), "tags"), F.col("type") == F.col("_u")).select("uid", "tags")
    out = _long(own, F.col("tags"), "umbrella").unionByName(_long(propagated, F.col("propagated"), "propagated"))
    every = listed.select(key("tag").alias("alias")).distinct()
    named = rows.select("uid", "bt", key("bt").alias("_b")).join(every, F.col("_b") == F.col("alias"), "left_semi")
    out = out.unionByName(_long(named, F.array("bt"), "type"))
    mine = G.literal_keywords(F.col("name"), F.col("known"))
    mine = F.array_sort(mine, lambda a, b: F.length(b) - F.length(a))
    out = out.unionByName(_long(rows.filter("known IS NOT NULL"), mine, "literal"))
    dictionary = listed.groupBy(key("tag").alias("alias")).agg(F.min("tag").alias("canonical"))
    found = D.scan(rows.filter("known IS NULL"), dictionary, "uid", "name")
    return out.unionByName(found.select("uid", F.col("canonical").alias("tag"), F.lit("literal").alias("source"), F.col("at").cast("double").alias("place")))


@dataclass(frozen=True)
class Lists:
    """What the types' keywords give, whatever the inputs. lists: list, known (its keywords); each: list, tag; coded, words: the keywords that are
    searched (with those of the list EVERY, in a market), with their vectors, and by their words."""

    lists: DataFrame
    each: DataFrame
    coded: DataFrame
    words: DataFrame


def listed(maps: DataFrame, tools: Tools) -> Lists:
    """maps: basictype, keywords."""
    lists = settled(maps.filter(F.size("keywords") > 0).groupBy(key("basictype").alias("list")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("known")))
    each = settled(lists.select("list", F.explode("known").alias("tag")))
    pool = each if tools.domain == "food" else each.unionByName(each.groupBy(key("tag")).agg(F.min("tag").alias("tag")).select(F.lit(EVERY).alias("list"), "tag"))
    coded = lambda: settled(V.encode(pool, "tag", tools.encoder).withColumnRenamed("tag", "uid"))
    words = lambda: settled(_tokens(pool.withColumn("uid", F.col("tag")), "uid", "tag", "list"))
    return Lists(lists, each, *together(coded, words))


def search(spark: SparkSession, rows: DataFrame, listed: Lists) -> DataFrame:
    """uid, tag, fused: the best keywords of each row's list (all keywords for rows whose list is EVERY), by dense and sparse search.

    rows: uid, vector, text, list. Every (list, tag) is met by the rows of its list alone.
    """
    ask = rows.withColumnRenamed("uid", "query_id")
    dense, sparse = together(
        lambda: settled(V.dense_top_k(spark, ask.select("query_id", "vector", "list"), listed.coded, SEARCHED, same="list")),
        lambda: settled(V.sparse_top_k(settled(_tokens(ask, "query_id", "text", "list")), listed.words, SEARCHED, "list")),
    )
    return V.hybrid_search(dense, sparse, FUSED).select(F.col("query_id").alias("uid"), F.col("uid").alias("tag"), F.col("score").alias("fused"))


def _synthetic(rows: DataFrame, tools: Tools, found: DataFrame) -> DataFrame:
    """uid, tag of made-up tags that the search hasn't found."""
    made = G.synthetic_tags(tools.domain, F.col("bt"), D.longest_brand(F.col("brand")), F.col("category"), F.col("flavor"))
    made = rows.select("uid", F.explode(made).alias("tag")).select("uid", (F.initcap("tag") if tools.domain == "food" else F.col("tag")).alias("tag"))
    had = found.select(F.col("uid").alias("_u"), key("tag").alias("_t"))
    return made.join(had, (F.col("uid") == F.col("_u")) & (key("tag") == F.col("_t")), "left_anti")


def _flavors_of(tags: DataFrame, tools: Tools) -> DataFrame:
    """tag, names: the flavors that a tag names."""
    named = D.scan(tags.select("tag").distinct(), tools.flavors, "tag", "tag")
    return named.groupBy(F.col("tag").alias("named")).agg(F.collect_set("canonical").alias("names"))


def keywords(spark: SparkSession, rows: DataFrame, propagated: DataFrame, umbrella: DataFrame, maps: DataFrame, tools: Tools, trained: DataFrame | None = None, known: Lists | None = None) -> Keywords:
    """rows: uid, name, description, category, bt, brand, flavor, vector; propagated: uid, propagated; umbrella: basictype, tags;
    maps: basictype, keywords; trained: uid, keywords, confidence of fitted keyword models, if there are any; known: listed() of the maps, where it was made before.
    """
    food = tools.domain == "food"
    known = known or listed(maps, tools)
    own = rows.withColumn("type", key("bt")).join(known.lists.withColumnRenamed("list", "_l"), F.col("type") == F.col("_l"), "left").drop("_l")
    own = settled(own.withColumn("list", F.when(F.col("known").isNotNull(), F.col("type")).when(F.lit(not food), F.lit(EVERY))).withColumn("text", F.trim(F.concat_ws(" ", "name", "description"))))
    open_ = own.filter("list IS NOT NULL")  # the others are food types without a list, which take certain keywords alone
    asked = open_.select("uid", "vector", F.concat_ws(" ", "text", "category").alias("text"), "list")
    sure, found = together(lambda: settled(certain(own, propagated, umbrella, known.each)), lambda: settled(search(spark, asked, known)))
    both = found.withColumn("source", F.lit("search")).unionByName(_synthetic(open_, tools, found).select("uid", "tag", F.lit(1.0).alias("fused"), F.lit("synthetic").alias("source")))
    pairs = both.join(open_.select("uid", "text"), "uid")
    if tools.scorer is None:
        searched = pairs.withColumn("score", F.col("fused"))
    else:
        searched = V.rerank(pairs, "text", "tag", tools.scorer, "score")
    searched = searched.select("uid", "tag", "source", (-F.col("score")).alias("place"), "score")
    given = _long(trained, F.col("keywords"), "trained") if trained is not None else sure.limit(0)
    certain_ = sure.unionByName(given).withColumn("score", F.lit(None).cast("double"))
    every = certain_.unionByName(searched).join(own.select(F.col("uid").alias("_u"), "list", "known", F.col("flavor").alias("has")), F.col("uid") == F.col("_u")).drop("_u")
    every = every.filter(F.col("source").isin(*SOURCES[:4]) | F.col("list").isNotNull())
    inside = F.array_contains(F.transform("known", key), key("tag"))
    every = every.withColumn("allowed", F.col("source").isin(*SOURCES[:4]) | F.coalesce(inside, F.lit(not food)))
    if tools.scorer is None:  # without a scorer made-up tags stay; with one they must be of the list
        every = every.withColumn("allowed", F.col("allowed") | (F.col("source") == "synthetic"))
    leaks = F.lit(False)
    every = settled(every)
    if food and tools.flavors is not None:
        every = every.join(_flavors_of(every, tools), F.col("tag") == F.col("named"), "left").drop("named")
        leaks = F.col("list").isNotNull() & (F.size(F.array_except(F.coalesce("names", _none()), F.coalesce("has", _none()))) > 0)
    every = every.withColumn("leaks", leaks)
    scored = F.col("source").isin("search", "synthetic")
    if tools.scorer is None:
        every = settled(every.withColumn("above_cut", F.lit(True)))
    else:
        fit = every.filter(scored & F.col("allowed") & ~F.col("leaks")).select("uid", "tag", F.col("score").alias("rerank_score"))
        cut = G.rerank_cut(fit).select(F.col("uid").alias("_u"), F.col("tag").alias("_t")).distinct()
        every = every.join(cut, (F.col("uid") == F.col("_u")) & (F.col("tag") == F.col("_t")), "left").withColumn("above_cut", ~scored | F.col("_t").isNotNull()).drop("_u", "_t")
        every = settled(every)
    order = F.array_position(F.array(*[F.lit("synthetic" if s == "search" and tools.scorer is not None else s) for s in SOURCES]), F.when(scored & F.lit(tools.scorer is not None), "synthetic").otherwise(F.col("source")))
    kept = every.filter("allowed AND above_cut AND NOT leaks")
    lists_ = kept.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "place", "tag"))).alias("s"), F.max(F.when(scored, F.col("score"))).alias("best"))
    best = F.least(F.col("best"), F.lit(1.0)) if tools.scorer is None else F.col("best")
    out = rows.select("uid").join(lists_, "uid", "left")
    if trained is not None:
        out = out.join(trained.select("uid", F.col("confidence").alias("_c")), "uid", "left")
    told = F.col("_c") if trained is not None else F.lit(None).cast("double")
    out = out.select("uid", G.merge_keywords(F.transform("s", lambda x: x["tag"])).alias("gk"), G.keyword_confidence(told, best).alias("gk_confidence"))
    return Keywords(out, every.select("uid", "tag", "source", "score", "allowed", "above_cut", "leaks"))


def decisions(considered: DataFrame, final: DataFrame) -> DataFrame:
    """uid, tag, source, score, allowed, above_cut, selected, pruned: each considered keyword once, by its first source, and what pruned it.

    Of several sources the first one that keeps the keyword counts. final: uid, gk.
    """
    stays = F.col("allowed") & F.col("above_cut") & ~F.col("leaks")
    order = F.struct((~stays).alias("p"), F.array_position(F.array(*[F.lit(n) for n in SOURCES]), F.col("source")).alias("o"), "tag")
    first = considered.groupBy("uid", key("tag").alias("_t")).agg(F.min_by(F.struct("tag", "source", "score", "allowed", "above_cut", "leaks"), order).alias("f")).select("uid", "_t", "f.*")
    chosen = final.select("uid", F.explode(F.transform("gk", key)).alias("_t")).distinct().withColumn("_s", F.lit(True))
    out = first.join(chosen, ["uid", "_t"], "left").withColumn("selected", F.coalesce("_s", F.lit(False)))
    why = F.when(F.col("selected"), None).when(~F.col("allowed"), "not of the type").when(F.col("leaks"), "names a flavor the input lacks").when(~F.col("above_cut"), "below the cut").otherwise("merged")
    return out.select("uid", "tag", "source", "score", "allowed", "above_cut", "selected", why.alias("pruned"))
