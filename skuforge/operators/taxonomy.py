"""Taxonomy mining: class tiers, centroids, type-to-tag maps, umbrella tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.functions import similarity as S
from skuforge.functions import text as T

WARM = 15
UMBRELLA_SHARE, UMBRELLA_ROWS = 0.60, 5
#: What a region's tag stands for.
REGION_DESCRIPTIONS = {
    "asian": "Asian dishes, noodles, rice and stir fries", "western": "Western dishes, burgers, pasta and grills", "indian": "Indian dishes, curries, breads and biryani",
    "local": "Local dishes, rice and curry, kottu and hoppers", "beverage": "Drinks, juices, coffee and tea", "dessert": "Sweets, cakes and ice cream",
}


def class_tiers(observed: DataFrame, registered: DataFrame, warm: int = WARM) -> DataFrame:
    """class, n, tier of every registered or observed class. observed: a row an example with column class; registered: class."""
    n = observed.filter(~T.blank(F.col("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    every = registered.filter(~T.blank(F.col("class"))).select("class").distinct().join(n, "class", "full_outer")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return every.select("class", n.alias("n"), F.when(n == 0, "zero-shot").when(n < warm, "few-shot").otherwise("warm").alias("tier"))


def register_class(registered: DataFrame, *names: str) -> DataFrame:
    new = registered.sparkSession.createDataFrame([(n,) for n in names], "class string")
    return registered.select("class").union(new).distinct()


def centroids(vectors: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """class, vector: the unit mean vector of each class (of warm ones, where tiers are given). vectors: class, vector.

    Vectors are added up whole, before and after the shuffle, so each task sends one row a class. Rows without a vector don't count.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = vectors if tiers is None else vectors.join(tiers.filter("tier = 'warm'").select("class"), "class", "left_semi")
    whole = F.transform("vector", lambda x: x.cast("double"))
    mean = rows.filter(F.col("vector").isNotNull()).select("class", array_to_vector(whole).alias("v")).groupBy("class").agg(Summarizer.mean(F.col("v")).alias("m"))
    return mean.select("class", S.normalized(vector_to_array("m")).alias("vector"))


def type_descriptions(bt_gk: DataFrame, most: int = 8) -> DataFrame:
    """class, description: the type's name and its first keywords. bt_gk: basictype, keywords."""
    return bt_gk.select(F.col("basictype").alias("class"), F.concat_ws(": ", "basictype", F.when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, most), ", "))).alias("description"))


def region_description(c: Column) -> Column:
    out = c
    for k, v in REGION_DESCRIPTIONS.items():
        out = F.when(F.lower(F.trim(c)) == k, v).otherwise(out)
    return out


def type_to_third_tag(catalog: DataFrame, tag: str) -> DataFrame:
    """basictype, tag, n: the most frequent third tag of each type; ties go to the first by name."""
    n = catalog.filter(~T.blank(F.col("basictype")) & ~T.blank(F.col(tag))).groupBy("basictype", F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("basictype").agg(F.min(F.struct((-F.col("n")).alias("m"), "tag")).alias("b")).select("basictype", "b.tag", (-F.col("b.m")).alias("n"))


def _keywords(catalog: DataFrame) -> DataFrame:
    return catalog.filter(~T.blank(F.col("basictype"))).select("basictype", F.explode(T.comma_list(F.col("generic_keywords"))).alias("gk"))


def umbrella_tags(catalog: DataFrame, share: float = UMBRELLA_SHARE, least: int = UMBRELLA_ROWS) -> DataFrame:
    """basictype, tags: keywords in at least ``share`` of a type's rows, most frequent first, of types with ``least`` rows."""
    rows = catalog.filter(~T.blank(F.col("basictype"))).groupBy("basictype").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least)
    n = _keywords(catalog).groupBy("basictype", "gk").agg(F.count(F.lit(1)).alias("n"))
    kept = n.join(rows, "basictype").filter(F.col("n") >= share * F.col("rows"))
    return kept.groupBy("basictype").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "gk"))), lambda s: s["gk"]).alias("tags"))


def type_keywords(catalog: DataFrame) -> DataFrame:
    """basictype, keywords: the sorted distinct keywords of each type."""
    return _keywords(catalog).groupBy("basictype").agg(F.array_sort(F.collect_set("gk")).alias("keywords"))


def augmented_type_keywords(catalog: DataFrame, dictionary: DataFrame, dishes: list[str]) -> DataFrame:
    """As ``type_keywords``, but only keywords of the dictionary, in its spelling, that name no other type's dish."""
    known = dictionary.groupBy(F.lower(F.trim("tag")).alias("k")).agg(F.min("tag").alias("tag"))
    rows = _keywords(catalog).distinct().join(known, F.lower("gk") == F.col("k"))
    rows = rows.filter(~T.conflicting_dish(F.col("tag"), F.col("basictype"), dishes))
    return rows.groupBy("basictype").agg(F.array_sort(F.collect_set("tag")).alias("keywords"))


def umbrella_words(catalog: DataFrame, types: int = 10, share: float = 0.30) -> DataFrame:
    """word, n_types, in_name: words in keywords of many types that product names rarely hold."""
    rows = catalog.filter(~T.blank(F.col("basictype"))).select("basictype", F.lower("name").alias("name"), F.explode(T.comma_list(F.col("generic_keywords"))).alias("gk"))
    w = rows.select("basictype", "name", F.explode(T.words(F.lower("gk"))).alias("word"))
    seen = F.array_contains(T.words(F.col("name")), F.col("word")).cast("double")
    return w.groupBy("word").agg(F.count_distinct("basictype").alias("n_types"), F.avg(seen).alias("in_name")).filter((F.col("n_types") >= types) & (F.col("in_name") < share))
