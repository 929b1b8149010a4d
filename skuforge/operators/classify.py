"""Classification: trained models, centroids, neighbours, zero-shot labels, and the cascades between them.

Predictions are tables uid, label, confidence; a cascade is a left join of such tables and one expression.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuforge.functions import similarity as S
from skuforge.functions import text as T
from skuforge.operators import vectors as V

TRAINED, WARM_FIRST, FEW, ZERO, WARM_LAST = 0.40, 0.80, 0.50, 0.40, 0.50
AUTO, REVIEW = 0.80, 0.50
KEYWORD_SHARE, NEIGHBOURS, TEMPERATURE = 0.35, 15, 0.05
EVERY = 2**31 - 1


def price_feature(df: DataFrame, price: str = "price") -> DataFrame:
    """``df`` with price_feature: log of one plus the price, standardised over the rows; 0 for no price."""
    logged = F.log1p(F.greatest(F.coalesce(F.col(price), F.lit(0.0)), F.lit(0.0)))
    stats = df.agg(F.avg(logged).alias("_m"), F.stddev_pop(logged).alias("_s"))
    scaled = F.when(F.col("_s") > 0, (logged - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return df.join(F.broadcast(stats)).withColumn("price_feature", F.when(F.coalesce(F.col(price), F.lit(0.0)) > 0, scaled).otherwise(0.0)).drop("_m", "_s")  # one row


def feature_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    """``df`` with ML column features: the vector and the price feature."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.concat(F.transform(vector, lambda x: x.cast("double")), F.array("price_feature"))))


def train_classifier(rows: DataFrame, label: str, balanced: bool = False, c: float = 5.0, least: int = 10):
    """A fitted pipeline (index, multinomial logistic regression, label names), or None with fewer than ``least`` labelled rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    known = rows.filter(~T.blank(F.col(label)))
    n = known.count()
    if n < least:
        return None
    if balanced:
        classes = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
        k = classes.count()
        known = known.join(classes, label).withColumn("_w", n / (k * F.col("_n")))
    model = LogisticRegression(labelCol="_y", regParam=1.0 / (c * n), standardization=False, family="multinomial", maxIter=50, **({"weightCol": "_w"} if balanced else {}))
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), model]).fit(known)


def predict_trained(rows: DataFrame, model) -> DataFrame:
    """uid, label, confidence of the fitted pipeline's most probable class."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    p = vector_to_array("probability")
    scored = model.stages[1].transform(rows)
    return scored.select("uid", F.get(names, F.col("prediction").cast("int")).alias("label"), F.array_max(p).alias("confidence"))


def keyword_samples(rows: DataFrame, most: int = 20000) -> DataFrame:
    """uid, vector, tag, y: about ``most`` of each keyword's rows (by hash, all if fewer) with y = 1 and twice as many others at most with y = 0.

    Other rows are met by level: level l holds the rows whose hash is below 2^-l, two levels a row on average, and a keyword asks the smallest
    level that has its share. So rows and keywords never meet in full, and the join yields about twice the rows that are kept.
    """
    hashed = rows.select("uid", "vector", "keywords", (F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) / float(1 << 20)).alias("_h"))
    sizes = rows.select(F.explode("keywords").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = max(rows.count(), 1)
    share = F.least(F.lit(1.0), most / F.col("n"))
    positives = hashed.withColumn("tag", F.explode("keywords")).join(sizes, "tag").filter(F.col("_h") < share).select("uid", "vector", "tag", F.lit(1).alias("y"))
    few = F.least(F.lit(1.0), 2.0 * F.least(F.col("n"), F.lit(most)) / total)
    levels, salts = F.lit(20), 32
    wanted = sizes.withColumn("few", few).withColumn("level", F.least(levels, F.floor(-F.log2("few")).cast("int")))
    wanted = wanted.select("tag", "few", "level", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    deepest = F.when(F.col("_h") > 0, F.least(levels, F.ceil(-F.log2("_h")).cast("int"))).otherwise(levels)
    levelled = hashed.withColumn("salt", F.pmod(F.hash("uid"), F.lit(salts))).withColumn("level", F.explode(F.sequence(F.lit(0), deepest)))
    negatives = levelled.join(wanted, ["level", "salt"]).filter((F.col("_h") < F.col("few")) & ~F.array_contains("keywords", F.col("tag")))
    negatives = negatives.select("uid", "vector", "tag", F.lit(0).alias("y"))
    return positives.unionByName(negatives)


def train_keyword_models(spark: SparkSession, rows: DataFrame, least: int = 2, rounds: int = 200, most: int = 20000) -> DataFrame:
    """tag, weights: a balanced one-vs-rest logistic model of each keyword. rows: uid, vector, keywords.

    A model is fitted on the rows of ``keyword_samples``, so each group is bounded.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.c_[np.stack(pdf["vector"].tolist()).astype(float), np.ones(len(pdf))]
        y = pdf["y"].to_numpy(float)
        if y.sum() < least or y.min() == y.max():
            return pd.DataFrame({"tag": [], "weights": []})
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-x @ w))
            w -= 4.0 * (x.T @ (weight * (p - y)) + 1e-3 * w)
        return pd.DataFrame({"tag": [pdf["tag"].iloc[0]], "weights": [w.tolist()]})

    return keyword_samples(rows, most).groupBy("tag").applyInPandas(fit, "tag string, weights array<double>")


def predict_keywords(rows: DataFrame, models: DataFrame, least: float = 0.5) -> DataFrame:
    """uid, keywords, confidence: tags with probability ``least`` or more, most probable first, and the mean of their probabilities.

    Rows and models meet in blocks, so neither side must fit in a task.
    """
    x = rows.filter(F.col("vector").isNotNull()).select(F.col("uid").alias("query_id"), F.concat(F.transform("vector", lambda v: v.cast("double")), F.array(F.lit(1.0))).alias("vector"))
    m = models.select(F.col("tag").alias("uid"), F.col("weights").alias("vector"))
    scored = V.dense_top_k(rows.sparkSession, x, m, EVERY, least=math.log(least / (1 - least)))
    scored = scored.select(F.col("query_id").alias("uid"), F.col("uid").alias("tag"), S.sigmoid(F.col("score")).alias("p"))
    return scored.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("m"), "tag"))), lambda s: s["tag"]).alias("keywords"), F.avg("p").alias("confidence"))


def _class_shares(rows: DataFrame, classes: DataFrame, scale: float) -> DataFrame:
    """uid, label, confidence: the class with the largest cosine, and its share of the softmax of scaled cosines. Classes: class, vector."""
    unit = lambda s: F.transform(S.normalized(F.col("vector")), lambda v: v * s)
    asked = rows.select(F.col("uid").alias("query_id"), unit(scale).alias("vector"))
    best = V.softmax_best(asked, classes.select(F.col("class").alias("uid"), unit(1.0).alias("vector")))
    return best.select(F.col("query_id").alias("uid"), F.col("uid").alias("label"), F.col("share").alias("confidence"))


def cosine_head(rows: DataFrame, weights: DataFrame, scale: float = 30.0, least: float = TRAINED) -> DataFrame:
    """uid, label, confidence of a trained cosine head: softmax of scaled cosines. weights: class, vector; as many rows as classes.

    Rows and classes meet in blocks.
    """
    return _class_shares(rows, weights, scale).filter(F.col("confidence") >= least)


def nearest_labels(rows: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """uid, label, score, rank: the k labels with the largest cosines, ties by name. rows: uid, vector; labels: class, vector.

    Products of blocks of rows and of labels, so neither side must fit in a task. Rows and labels without a vector take no part.
    """
    unit = lambda df, c, out: df.filter(F.col("vector").isNotNull()).select(F.col(c).alias(out), S.normalized(F.col("vector")).alias("vector"))
    hits = V.dense_top_k(rows.sparkSession, unit(rows, "uid", "query_id"), unit(labels, "class", "uid"), k)
    return hits.select(F.col("query_id").alias("uid"), F.col("uid").alias("label"), "score", "rank")


def zero_shot(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """uid, label, confidence: the nearest label by its name's or its description's vector. labels: class, vector, description_vector."""
    either = labels.select("class", F.explode(F.array("vector", "description_vector")).alias("vector"))
    return nearest_labels(rows, either, 1).select("uid", "label", F.col("score").alias("confidence"))


def centroid_predict(rows: DataFrame, centroids: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """uid, label, confidence by softmax over cosines to the centroids, in blocks of rows and centroids."""
    return _class_shares(rows, centroids, 1 / temperature)


def neighbour_vote(hits: DataFrame, tiers: DataFrame | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, label, confidence: each class's share of the k best hits' similarity; few-shot classes are preferred.

    hits: query_id, uid, basictype, score; negative scores count as none.
    """
    near = V.top_k(hits, "query_id", "score", "uid", k).withColumn("s", F.greatest("score", F.lit(0.0)))
    total = near.groupBy("query_id").agg(F.sum("s").alias("total"))
    votes = near.filter(~T.blank(F.col("basictype"))).groupBy("query_id", F.col("basictype").alias("class")).agg(F.sum("s").alias("s")).join(total.filter("total > 0"), "query_id")
    few = F.lit(False)
    if tiers is not None:
        votes = votes.join(tiers.select("class", "tier"), "class", "left")
        few = F.coalesce(F.col("tier") == "few-shot", F.lit(False))
    best = votes.groupBy("query_id").agg(F.min(F.struct((~few).alias("other"), (-F.col("s") / F.col("total")).alias("m"), "class")).alias("b"))
    return best.select("query_id", F.col("b.class").alias("label"), (-F.col("b.m")).alias("confidence"))


def keyword_propagation(hits: DataFrame, k: int = NEIGHBOURS, share: float = KEYWORD_SHARE) -> DataFrame:
    """query_id, keywords: keywords of the k best hits with at least ``share`` of their similarity, heaviest first. hits: also keywords."""
    near = V.top_k(hits, "query_id", "score", "uid", k).withColumn("s", F.greatest("score", F.lit(0.0)))
    total = near.groupBy("query_id").agg(F.sum("s").alias("total")).filter("total > 0")
    w = near.select("query_id", "s", F.explode(F.array_distinct("keywords")).alias("gk")).groupBy("query_id", "gk").agg(F.sum("s").alias("s")).join(total, "query_id")
    kept = w.filter(F.col("s") / F.col("total") >= share)
    return kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("m"), "gk"))), lambda x: x["gk"]).alias("keywords"))


def zero_shot_pairs(rows: DataFrame, labels: DataFrame, scorer, top: int = 5) -> DataFrame:
    """uid, label, confidence: the ``top`` labels by cosine are reranked on their descriptions. rows: uid, text, vector."""
    near = nearest_labels(rows, labels, top).join(labels.select(F.col("class").alias("label"), "description"), "label")
    claim = F.concat(F.lit("Basic Type: "), "label", F.lit(" - "), "description")
    pairs = near.join(rows.select("uid", "text"), "uid").select("uid", "text", "label", claim.alias("claim"))
    ranked = V.rerank(pairs, "text", "claim", scorer)
    best = ranked.groupBy("uid").agg(F.min(F.struct((-F.col("rerank_score")).alias("m"), "label")).alias("b"))
    return best.select("uid", "b.label", S.sigmoid(-F.col("b.m")).alias("confidence"))


def router(uids: DataFrame, warm: DataFrame, few: DataFrame, zero: DataFrame) -> DataFrame:
    """uid, label, confidence, tier: warm centroids, few-shot neighbours and zero-shot labels, each from its own threshold."""
    pack = lambda df, n: df.select("uid", F.struct("label", "confidence").alias(n))
    rows = uids.select("uid").join(pack(warm, "w"), "uid", "left").join(pack(few, "f"), "uid", "left").join(pack(zero, "z"), "uid", "left")
    at = lambda n, t: F.col(f"{n}.confidence") >= t
    steps = [("w", at("w", WARM_FIRST), "warm"), ("f", at("f", FEW), "few-shot"), ("z", at("z", ZERO), "zero-shot"), ("w", at("w", WARM_LAST), "warm"), ("w", F.col("w").isNotNull(), "zero-shot")]
    chosen = F.coalesce(*[F.when(cond, F.struct(F.col(f"{n}.label").alias("label"), F.col(f"{n}.confidence").alias("confidence"), F.lit(tier).alias("tier"))) for n, cond, tier in steps])
    return rows.select("uid", chosen.alias("c")).select("uid", "c.label", "c.confidence", "c.tier")


def cascade(uids: DataFrame, stages: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """uid, label, confidence, source: of the stages (name, predictions, threshold) the first that reaches its threshold."""
    rows, found = uids.select("uid"), []
    for k, (name, df, least) in enumerate(stages):
        rows = rows.join(df.select("uid", F.struct("label", "confidence").alias(f"_{k}")), "uid", "left")
        found.append(F.when(F.col(f"_{k}.confidence") >= least, F.struct(F.col(f"_{k}.label").alias("label"), F.col(f"_{k}.confidence").alias("confidence"), F.lit(name).alias("source"))))
    return rows.select("uid", F.coalesce(*found).alias("c")).select("uid", "c.label", "c.confidence", "c.source")


def third_tag(rows: DataFrame, overrides: DataFrame, trained: DataFrame | None, zero: DataFrame) -> DataFrame:
    """As ``cascade``: a type's override (confidence 1) before the trained model and the nearest label. rows: uid, bt; overrides: basictype, tag."""
    fixed = rows.join(overrides.select("basictype", "tag"), F.lower(F.trim("bt")) == F.lower(F.trim("basictype"))).select("uid", F.col("tag").alias("label"), F.lit(1.0).alias("confidence"))
    return cascade(rows, [("override", fixed, 1.0), *([("trained", trained, TRAINED)] if trained is not None else []), ("zero-shot", zero, -1.0)])


def flavor_conflict(bt: Column, bt_flavors: Column, input_flavors: Column) -> Column:
    """The type, or null where it names flavors of which the input has none while it has others."""
    clash = (F.size(bt_flavors) > 0) & (F.size(input_flavors) > 0) & ~F.arrays_overlap(bt_flavors, input_flavors)
    return F.when(~clash, bt)


def guaranteed_keywords(umbrella: Column, propagated: Column, bt: Column, known: Column, literal: Column) -> Column:
    """Umbrella, propagated, the type itself where it is a known keyword, and keywords named literally (longest first)."""
    none = F.array().cast("array<string>")
    own = F.when(F.array_contains(known, bt), F.array(bt)).otherwise(none)
    by_length = F.array_sort(literal, lambda a, b: F.length(b) - F.length(a))
    return F.array_distinct(F.concat(F.coalesce(umbrella, none), F.coalesce(propagated, none), own, F.coalesce(by_length, none)))


def literal_keywords(name: Column, keywords: Column) -> Column:
    """Keywords that stand in the name as whole words."""
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return F.filter(keywords, lambda k: padded.contains(F.concat(F.lit(" "), F.lower(k), F.lit(" "))))


def allowed_tags(candidates: DataFrame, bt_map: DataFrame, domain: str) -> DataFrame:
    """The (uid, bt, tag) candidates that their type's map allows. A type without a map allows none (food) or all (market)."""
    lists = bt_map.select(F.lower("basictype").alias("_k"), F.transform("keywords", F.lower).alias("_allowed"))
    rows = candidates.join(lists, F.lower("bt") == F.col("_k"), "left")
    ok = F.array_contains("_allowed", F.lower("tag"))
    return rows.filter(F.coalesce(ok, F.lit(domain == "market"))).drop("_k", "_allowed")


def synthetic_tags(domain: str, bt: Column, brand: Column, category: Column, flavors: Column) -> Column:
    """Tags put in front: brand with type and category (market), or each flavor and their pairs (food)."""
    if domain == "market":
        made = F.array(F.when(~T.blank(brand) & ~T.blank(bt), F.concat_ws(" ", brand, bt)), F.when(~T.blank(brand) & ~T.blank(category), F.concat_ws(" ", brand, category)))
        return F.filter(made, lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(flavors, lambda a, i: F.transform(F.slice(flavors, i + 2, F.size(flavors)), lambda b: F.concat(a, F.lit(" & "), b))))
    return F.concat(flavors, pairs)


def drop_leaked_flavors(tags: Column, tag_flavors: Column, input_flavors: Column) -> Column:
    """Tags less those naming a flavor that the input lacks. tag_flavors: an array of flavors for each tag, in order."""
    both = F.arrays_zip(tags.alias("t"), tag_flavors.alias("f"))
    return F.transform(F.filter(both, lambda x: F.size(F.array_except(x["f"], input_flavors)) == 0), lambda x: x["t"])


def rerank_cut(scored: DataFrame, least: float = 0.0, margin: float = 2.5) -> DataFrame:
    """Rows scoring ``least`` or more and within ``margin`` of their uid's best."""
    best = F.max("rerank_score").over(Window.partitionBy("uid"))
    return scored.withColumn("_b", best).filter((F.col("rerank_score") >= least) & (F.col("rerank_score") >= F.col("_b") - margin)).drop("_b")


def merge_keywords(*lists: Column) -> Column:
    """Arrays in order; of spellings that differ in case alone the first stays."""
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("low"))
    return F.aggregate(every, empty, lambda a, k: F.when(F.array_contains(a["low"], F.lower(k)), a).otherwise(F.struct(F.concat(a["out"], F.array(k)).alias("out"), F.concat(a["low"], F.array(F.lower(k))).alias("low"))))["out"]


def keyword_confidence(trained: Column, best: Column) -> Column:
    """The trained model's where that is sure, else the best rerank or fused score."""
    return F.when(trained >= AUTO, trained).otherwise(F.coalesce(best, F.lit(0.0)))


def tag_status(tag: Column, confidence: Column, source: Column) -> Column:
    return F.when(T.blank(tag), "LOW").when(source.isin("override", "keyword"), "AUTO").when(confidence >= AUTO, "AUTO").when(confidence >= REVIEW, "REVIEW").otherwise("LOW")


def reasoning(bt: Column, bt_source: Column, bt_conf: Column, third: Column, third_source: Column, keywords: Column) -> Column:
    return F.format_string("BT '%s' by %s (%.2f); third tag '%s' by %s; %d keywords", F.coalesce(bt, F.lit("-")), F.coalesce(bt_source, F.lit("-")), F.coalesce(bt_conf, F.lit(0.0)), F.coalesce(third, F.lit("-")), F.coalesce(third_source, F.lit("-")), F.size(keywords))
