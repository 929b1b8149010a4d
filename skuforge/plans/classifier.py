"""The whole classification plan: type cascade, third tag, and generic keywords (keywords.py)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.functions import text as T
from skuforge.operators import classify as G
from skuforge.operators import entities as D
from skuforge.operators import taxonomy as X
from skuforge.operators import vectors as V
from skuforge.plans import keywords as K
from skuforge.plans.matcher import Tools, _default, _none, enriched, with_entities, written
from skuforge.sources.shared import begun, settled, together

BOTH = {"description": "string", "category": "string"}


@dataclass(frozen=True)
class Classified:
    """rows: a row an input; keywords: every keyword considered, and why it stays or goes."""

    rows: DataFrame
    keywords: DataFrame


def field_vectors(df: DataFrame, tools: Tools, weights: tuple[float, ...]) -> DataFrame:
    """``df`` with vector, the weighted sum of its name's, description's and category's vectors."""
    fields, plain = ["name", "description", "category"], df
    for f in fields:
        df = V.encode(df, f, tools.encoder, f"_{f}", plain)
    return df.withColumn("vector", V.weighted_vector([(F.col(f), F.col(f"_{f}")) for f in fields], weights)).drop(*[f"_{f}" for f in fields])


def _described(labels: DataFrame, tools: Tools) -> DataFrame:
    """class, description with vector and description_vector."""
    return V.encode(V.encode(labels, "class", tools.encoder), "description", tools.encoder, "description_vector", labels)


@dataclass(frozen=True)
class Known:
    """What classification takes from the catalog, whatever the inputs. rows: the catalog with vectors; labels: types described, with both vectors; regions: the
    same for third tags; third: basictype, tag; maps: basictype, keywords, and lists of them; umbrella: basictype, tags."""

    rows: DataFrame
    tiers: DataFrame
    centroids: DataFrame
    labels: DataFrame
    regions: DataFrame
    third: DataFrame
    umbrella: DataFrame
    maps: DataFrame
    lists: K.Lists


def known(catalog: DataFrame, tools: Tools) -> Known:
    """catalog: source_pos, name, basictype, generic_keywords, and optionally description, category."""
    plain = settled(_default(catalog, **BOTH).select("source_pos", "name", "description", "category", "basictype", "generic_keywords"))
    observed = plain.select(F.col("basictype").alias("class"))

    def coded() -> tuple[DataFrame, DataFrame, DataFrame]:
        rows, tiers = together(lambda: settled(field_vectors(plain, tools, V.CLASSIFY_WEIGHTS)), lambda: settled(X.class_tiers(observed, observed)))
        return rows, tiers, settled(X.centroids(rows.select(F.col("basictype").alias("class"), "vector"), tiers))

    def mapped() -> tuple[DataFrame, DataFrame, K.Lists]:
        maps = settled(X.type_keywords(plain))
        return maps, *together(lambda: settled(_described(X.type_descriptions(maps), tools)), lambda: K.listed(maps, tools))

    def regions() -> DataFrame:
        names = settled(plain.filter(~T.blank(F.col("category"))).select(F.col("category").alias("class")).distinct())
        return settled(_described(names.withColumn("description", X.region_description(F.col("class"))), tools))

    third, umbrella = lambda: settled(X.type_to_third_tag(plain, "category").select("basictype", "tag")), lambda: settled(X.umbrella_tags(plain))
    (rows, tiers, centroids), (maps, labels, lists), *more = together(coded, mapped, regions, third, umbrella)
    return Known(rows, tiers, centroids, labels, *more, maps, lists)


def named(inputs: DataFrame, tools: Tools) -> DataFrame:
    """uid, name, description, category, brand, flavor: inputs as classification reads them; food names are enriched."""
    rows = settled(enriched(_default(inputs, **BOTH), tools).select("uid", "name", "description", "category"))
    text = T.squeeze(F.concat_ws(" ", "name", "description", "category"))
    return with_entities(rows.withColumn("_text", text), tools, "uid", "_text").drop("_text")


def classify(spark: SparkSession, inputs: DataFrame, catalog: DataFrame, tools: Tools, trained: DataFrame | None = None, trained_third: DataFrame | None = None, overrides: DataFrame | None = None, trained_keywords: DataFrame | None = None, neighbours: int = G.NEIGHBOURS) -> Classified:
    """inputs: uid, name and optionally description, category; catalog: source_pos, name, basictype, generic_keywords, category, ...

    trained, trained_third: predictions (uid, label, confidence) of fitted models, and trained_keywords: uid, keywords, confidence, if there
    are any. Food inputs' names are enriched first. rows: uid, bt, bt_confidence,
    bt_status, bt_source, gk, gk_confidence, gk_status, third_tag, third_confidence, third_status, third_source, reasoning.
    """
    about, tools = begun(lambda: known(catalog, tools)), written(tools)
    return classified(spark, named(inputs, tools), about, tools, trained, trained_third, overrides, trained_keywords, neighbours)


def classified(spark: SparkSession, rows: DataFrame, about: Callable[[], Known], tools: Tools, trained: DataFrame | None = None, trained_third: DataFrame | None = None, overrides: DataFrame | None = None, trained_keywords: DataFrame | None = None, neighbours: int = G.NEIGHBOURS) -> Classified:
    """As ``classify``. rows: from ``named``; about: gives ``known`` of the catalog.

    The type cascade is the trained model, then the router over centroids, neighbours and labels, then the nearest label. Its stages don't need each
    other, so they are made and written at the same time.
    """
    rows = settled(rows)
    i, c = settled(field_vectors(rows, tools, V.CLASSIFY_WEIGHTS)), about()  # after the entities, whose steps would else encode the texts again

    def neighboured() -> list[DataFrame]:
        near = V.dense_top_k(spark, i.select(F.col("uid").alias("query_id"), "vector"), c.rows.select(F.col("source_pos").alias("uid"), "vector"), neighbours)
        of = c.rows.select(F.col("source_pos").alias("uid"), "basictype", T.comma_list(F.col("generic_keywords")).alias("keywords"))
        hits = settled(near.drop("rank").join(of, "uid"))
        propagated = G.keyword_propagation(hits, neighbours).select(F.col("query_id").alias("uid"), F.col("keywords").alias("propagated"))
        return together(lambda: settled(G.neighbour_vote(hits, c.tiers).withColumnRenamed("query_id", "uid")), lambda: settled(propagated))

    (few, propagated), warm, zero, last, region = together(
        neighboured,
        lambda: settled(G.centroid_predict(i, c.centroids)),
        lambda: settled(G.zero_shot_pairs(i.select("uid", F.col("name").alias("text"), "vector"), c.labels, tools.scorer)),
        lambda: settled(G.zero_shot(i, c.labels)),
        lambda: settled(G.zero_shot(i, c.regions)),
    )
    stages = [("trained", trained, G.TRAINED)] if trained is not None else []
    types = settled(G.cascade(i, [*stages, ("router", G.router(i, warm, few, zero), G.ZERO), ("zero-shot", last, -1.0)]))
    rows = i.join(types, "uid", "left")
    if tools.flavors is not None:
        of_type = D.scan(rows.select(F.col("label").alias("t")).filter("t IS NOT NULL").distinct(), tools.flavors, "t", "t").groupBy("t").agg(F.collect_set("canonical").alias("_tf"))
        rows = rows.join(of_type, F.col("label") == F.col("t"), "left").withColumn("bt", G.flavor_conflict(F.col("label"), F.coalesce("_tf", _none()), F.col("flavor"))).drop("t", "_tf")
    else:
        rows = rows.withColumn("bt", F.col("label"))
    lost = F.col("bt").isNull() & F.col("label").isNotNull()
    rows = settled(rows.withColumn("bt_source", F.when(lost, "conflict").otherwise(F.col("source"))).withColumn("bt_confidence", F.when(lost, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))))
    third = G.third_tag(rows.select("uid", "bt"), c.third if overrides is None else overrides, trained_third, region)
    third = third.select("uid", F.col("label").alias("third_tag"), F.col("confidence").alias("third_confidence"), F.col("source").alias("third_source"))
    told = K.keywords(spark, rows, propagated, c.umbrella, c.maps, tools, trained_keywords, c.lists)
    out = settled(rows.join(told.rows, "uid").join(third, "uid", "left"))
    confidence = F.col("gk_confidence")
    final = out.select(
        "uid", "bt", "bt_confidence", G.tag_status(F.col("bt"), F.col("bt_confidence"), F.col("bt_source")).alias("bt_status"), "bt_source", "gk",
        "gk_confidence", G.tag_status(F.get("gk", F.lit(0)), confidence, F.lit("search")).alias("gk_status"),
        "third_tag", "third_confidence", G.tag_status(F.col("third_tag"), F.col("third_confidence"), F.col("third_source")).alias("third_status"), "third_source",
        G.reasoning(F.col("bt"), F.col("bt_source"), F.col("bt_confidence"), F.col("third_tag"), F.col("third_source"), F.col("gk")).alias("reasoning"),
    )
    final = settled(final)
    return Classified(final, K.decisions(told.considered, final))
