"""Queries of classification, templates, plans and rules (G, H, I, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.operators import classify as G
from skuforge.operators import entities as D
from skuforge.operators import rules as R
from skuforge.operators import taxonomy as X
from skuforge.operators import templates as H
from skuforge.operators import vectors as V
from skuforge.plans import classifier, matcher
from skuforge.plans import ratio_sql as Q
from skuforge.plans import tagging as P
from skuforge.plans.cases_match import _DENSE, _queries
from skuforge.plans.samples import Samples, sql_of
from skuforge.sources.shared import together

CASES: dict = {}
NONE = "CAST([] AS VARCHAR[])"


def case(name: str, sql: str | None = None):
    def add(f):
        CASES[name] = (f, sql)
        return f

    return add


def _none():
    return F.array().cast("array<string>")


# --- G: features, models and taxonomy


@case("g01_price_feature", "SELECT o_orderkey, round(CASE WHEN p > 0 THEN (ln(1 + greatest(p, 0)) - m) / s ELSE 0 END, 6) AS f FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice END AS p FROM orders) AS x, (SELECT avg(ln(1 + p)) AS m, stddev_pop(ln(1 + p)) AS s FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice END AS p FROM orders) AS y) AS z")
def g01(s: Samples) -> DataFrame:
    rows = s.base("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("price"))
    return G.price_feature(rows).select("o_orderkey", F.round("price_feature", 6).alias("f"))


def _features(s: Samples) -> DataFrame:
    rows = s.vectors.withColumn("price", (F.col("uid") % 50).cast("double"))
    return G.feature_vectors(G.price_feature(rows))


@case("g02_trained_type")
def g02(s: Samples) -> DataFrame:
    rows = _features(s)
    return G.predict_trained(rows, G.train_classifier(rows, "class")).select("uid", "label")


@case("g03_trained_third_tag")
def g03(s: Samples) -> DataFrame:
    rows = _features(s)
    return G.predict_trained(rows, G.train_classifier(rows, "class", balanced=True)).select("uid", "label")


def _tagged(s: Samples) -> DataFrame:
    return s.vectors.withColumn("keywords", F.array_distinct(F.array("class", F.concat(F.lit("parity "), (F.substring("class", -1, 1).cast("int") % 2).cast("string")))))


@case("g04_keyword_models")
def g04(s: Samples) -> DataFrame:
    rows = _tagged(s)
    return G.predict_keywords(rows, G.train_keyword_models(s.spark, rows)).select("uid", F.array_sort("keywords").alias("keywords"))


_CENTROID = sql_of("vectors") + """, u AS (SELECT class, uid, unnest(range(1, 65)) AS i, unnest(vector)::DOUBLE AS x FROM vectors), m AS (SELECT class, i, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT class, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
  c AS (SELECT class, list(x / n ORDER BY i) AS v FROM m JOIN n USING (class) GROUP BY class), t AS (SELECT uid, c.class, list_cosine_similarity(vector::DOUBLE[], v) AS s FROM vectors, c)"""


@case("g05_cosine_head", _CENTROID + ", e AS (SELECT uid, class, exp(30 * s) / sum(exp(30 * s)) OVER (PARTITION BY uid) AS p FROM t) SELECT uid, arg_max(class, p) AS label, round(max(p), 6) AS confidence FROM e GROUP BY uid HAVING max(p) >= 0.4")
def g05(s: Samples) -> DataFrame:
    return G.cosine_head(s.vectors, X.centroids(s.vectors)).select("uid", "label", F.round("confidence", 6).alias("confidence"))


@case("g06_zero_shot", _CENTROID + ", z AS (SELECT uid, c.class, greatest(list_cosine_similarity(vector::DOUBLE[], v), list_cosine_similarity(vector::DOUBLE[], list_reverse(v))) AS s FROM vectors, c) SELECT uid, arg_max(class, s) AS label, round(max(s), 6) AS confidence FROM z GROUP BY uid")
def g06(s: Samples) -> DataFrame:
    labels = X.centroids(s.vectors).withColumn("description_vector", F.reverse("vector"))
    return G.zero_shot(s.vectors, labels).select("uid", "label", F.round("confidence", 6).alias("confidence"))


def _tiers(s: Samples) -> DataFrame:
    registered = s.base("nation").select(F.concat(F.lit("class "), "n_nationkey").alias("class"))
    return X.class_tiers(s.vectors.select("class"), registered, warm=60)


@case("g07_class_tiers", sql_of("vectors") + ", n AS (SELECT class, count(*) AS n FROM vectors GROUP BY 1), r AS (SELECT 'class ' || n_nationkey AS class FROM nation) SELECT coalesce(n.class, r.class) AS class, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'zero-shot' WHEN n < 60 THEN 'few-shot' ELSE 'warm' END AS tier FROM n FULL JOIN r ON n.class = r.class")
def g07(s: Samples) -> DataFrame:
    return _tiers(s)


@case("g08_centroids", _CENTROID + " SELECT class, round(v[1], 6) AS first, round(list_inner_product(v, v), 6) AS norm FROM c")
def g08(s: Samples) -> DataFrame:
    return X.centroids(s.vectors).select("class", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@case("g09_centroid_predict", _CENTROID + ", e AS (SELECT uid, class, exp((s - max(s) OVER w) / 0.05) AS e FROM t WINDOW w AS (PARTITION BY uid)), p AS (SELECT uid, class, e / sum(e) OVER (PARTITION BY uid) AS p FROM e) SELECT uid, arg_max(class, p) AS label, round(max(p), 6) AS confidence FROM p GROUP BY uid")
def g09(s: Samples) -> DataFrame:
    return G.centroid_predict(s.vectors, X.centroids(s.vectors)).select("uid", "label", F.round("confidence", 6).alias("confidence"))


def _hits(s: Samples) -> DataFrame:
    hits = V.dense_top_k(s.spark, _queries(s), s.vectors, 15).drop("rank")
    return hits.join(s.vectors.select("uid", "basictype", F.array("class", F.concat(F.lit("p"), F.col("uid") % 2)).alias("keywords")), "uid")


_VOTE = _DENSE + """, h AS (SELECT query_id, dr.uid, greatest(score, 0) AS s, class FROM dr JOIN vectors v ON v.uid = dr.uid WHERE rank <= 15), tot AS (SELECT query_id, sum(s) AS t FROM h GROUP BY 1)"""


@case("g10_neighbour_vote", _VOTE + ", c AS (SELECT query_id, class, sum(s) AS s FROM h GROUP BY ALL) SELECT query_id, arg_max(class, s) AS label, round(max(s) / any_value(t), 6) AS confidence FROM c JOIN tot USING (query_id) GROUP BY query_id")
def g10(s: Samples) -> DataFrame:
    return G.neighbour_vote(_hits(s)).select("query_id", "label", F.round("confidence", 6).alias("confidence"))


@case("g11_keyword_propagation", _VOTE + ", k AS (SELECT query_id, s, unnest([class, 'p' || (uid % 2)]) AS gk FROM h), w AS (SELECT query_id, gk, sum(s) AS s FROM k GROUP BY ALL) SELECT query_id, list(gk ORDER BY s DESC, gk) AS keywords FROM w JOIN tot USING (query_id) WHERE s / t >= 0.35 GROUP BY query_id")
def g11(s: Samples) -> DataFrame:
    return G.keyword_propagation(_hits(s))


@case("g12_zero_shot_pairs", _CENTROID + """, tops AS (SELECT uid, class AS label, row_number() OVER (PARTITION BY uid ORDER BY s DESC, class) AS k FROM t),
  pairs AS (SELECT uid, label, 'a thing of ' || v.class AS a, 'Basic Type: ' || label || ' - things of ' || label AS b FROM tops JOIN vectors v USING (uid) WHERE k <= 5), """ + Q.token_sorted("pairs", "q") + """,
  ranked AS (SELECT uid, label, r, row_number() OVER (PARTITION BY uid ORDER BY r DESC, label) AS k FROM pairs JOIN q USING (a, b)) SELECT uid, label, round(1 / (1 + exp(-(r / 10 - 5))), 6) AS confidence FROM ranked WHERE k = 1""")
def g12(s: Samples) -> DataFrame:
    labels = X.centroids(s.vectors).withColumn("description", F.concat(F.lit("things of "), "class"))
    return G.zero_shot_pairs(s.vectors.withColumn("text", F.concat(F.lit("a thing of "), "class")), labels, V.token_logit).select("uid", "label", F.round("confidence", 6).alias("confidence"))


def _predictions(s: Samples) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o = s.base("orders").select(F.col("o_orderkey").alias("uid"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    p = lambda label, c: o.select("uid", F.col(label).alias("label"), F.round(F.pmod(F.col("o_totalprice") * c, F.lit(1.0)), 4).alias("confidence"))
    return o, p("o_orderstatus", 1), p("o_orderpriority", 3).filter("uid % 2 = 0"), p("o_orderpriority", 7).filter("uid % 3 = 0")


_PRED = """p AS (SELECT o_orderkey AS uid, o_orderstatus AS wl, round((o_totalprice * 1) % 1, 4) AS w, CASE WHEN o_orderkey % 2 = 0 THEN round((o_totalprice * 3) % 1, 4) END AS f, CASE WHEN o_orderkey % 3 = 0 THEN round((o_totalprice * 7) % 1, 4) END AS z, o_orderpriority AS ol FROM orders)"""


@case("g13_router", f"WITH {_PRED} SELECT uid, CASE WHEN w >= 0.8 THEN wl WHEN f >= 0.5 THEN ol WHEN z >= 0.4 THEN ol ELSE wl END AS label, CASE WHEN w >= 0.8 THEN w WHEN f >= 0.5 THEN f WHEN z >= 0.4 THEN z ELSE w END AS confidence, CASE WHEN w >= 0.8 THEN 'warm' WHEN f >= 0.5 THEN 'few-shot' WHEN z >= 0.4 THEN 'zero-shot' WHEN w >= 0.5 THEN 'warm' ELSE 'zero-shot' END AS tier FROM p")
def g13(s: Samples) -> DataFrame:
    return G.router(*_predictions(s))


@case("g14_register_class", "SELECT 'class ' || n_nationkey AS class FROM nation UNION SELECT 'brand new' UNION SELECT 'class 3'")
def g14(s: Samples) -> DataFrame:
    return X.register_class(s.base("nation").select(F.concat(F.lit("class "), "n_nationkey").alias("class")), "brand new", "class 3")


@case("g15_type_cascade", f"WITH {_PRED} SELECT uid, CASE WHEN f >= 0.4 THEN ol WHEN z >= 0.4 THEN ol ELSE wl END AS label, CASE WHEN f >= 0.4 THEN 'trained' WHEN z >= 0.4 THEN 'router' ELSE 'nearest' END AS source FROM p")
def g15(s: Samples) -> DataFrame:
    o, w, f, z = _predictions(s)
    return G.cascade(o, [("trained", f, 0.4), ("router", z, 0.4), ("nearest", w, -1.0)]).select("uid", "label", "source")


@case("g16_third_tag", f"WITH {_PRED} SELECT uid, CASE WHEN wl = 'O' THEN 'open tag' WHEN f >= 0.4 THEN ol ELSE wl END AS label, CASE WHEN wl = 'O' THEN 'override' WHEN f >= 0.4 THEN 'trained' ELSE 'zero-shot' END AS source FROM p")
def g16(s: Samples) -> DataFrame:
    o, w, f, _ = _predictions(s)
    overrides = s.base("orders").filter("o_orderstatus = 'O'").select(F.lit("o").alias("basictype"), F.lit("open tag").alias("tag")).distinct()
    return G.third_tag(o.withColumn("bt", F.col("o_orderstatus")), overrides, f, w).select("uid", "label", "source")


@case("g17_type_descriptions", sql_of("catalog") + ", k AS (SELECT DISTINCT basictype, unnest([flavor, split_part(generic_keywords, ', ', 2)]) AS gk FROM catalog), l AS (SELECT basictype, list(gk ORDER BY gk) AS k FROM k GROUP BY 1) SELECT basictype AS class, basictype || ': ' || list_aggregate(k[1:8], 'string_agg', ', ') AS description FROM l")
def g17(s: Samples) -> DataFrame:
    return X.type_descriptions(X.type_keywords(s.catalog))


@case("g18_type_to_third_tag", sql_of("catalog") + ", n AS (SELECT basictype, category AS tag, count(*) AS n FROM catalog GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY basictype ORDER BY n DESC, tag) AS k FROM n) SELECT basictype, tag, n FROM r WHERE k = 1")
def g18(s: Samples) -> DataFrame:
    return X.type_to_third_tag(s.catalog, "category")


@case("g19_umbrella_tags", sql_of("catalog") + ", k AS (SELECT basictype, gk, count(*) AS n FROM (SELECT source_pos, basictype, unnest([flavor, split_part(generic_keywords, ', ', 2)]) AS gk FROM catalog) x GROUP BY ALL), r AS (SELECT basictype, count(*) AS r FROM catalog GROUP BY 1) SELECT basictype, list(gk ORDER BY n DESC, gk) AS tags FROM k JOIN r USING (basictype) WHERE r >= 5 AND n >= 0.12 * r GROUP BY 1")
def g19(s: Samples) -> DataFrame:
    return X.umbrella_tags(s.catalog, share=0.12)


@case("g20_type_keywords", sql_of("catalog") + " SELECT basictype, list_sort(list(DISTINCT gk)) AS keywords FROM (SELECT basictype, unnest([flavor, split_part(generic_keywords, ', ', 2)]) AS gk FROM catalog) x GROUP BY 1")
def g20(s: Samples) -> DataFrame:
    return X.type_keywords(s.catalog)


@case("g21_augmented_keywords", sql_of("catalog") + " SELECT basictype, list_sort(list(DISTINCT upper(gk))) AS keywords FROM (SELECT basictype, unnest([flavor, split_part(generic_keywords, ', ', 2)]) AS gk FROM catalog) x WHERE gk NOT IN ('bolt') GROUP BY 1")
def g21(s: Samples) -> DataFrame:
    words = s.base("part").select(F.explode(F.split("p_name", " ")).alias("w")).filter("w <> 'bolt'").distinct().select(F.upper("w").alias("tag"))
    return X.augmented_type_keywords(s.catalog, words, ["standard", "bolt"])


@case("g22_umbrella_words", sql_of("catalog") + ", k AS (SELECT basictype, name, unnest(['tools', flavor]) AS w FROM catalog) SELECT w AS word, count(DISTINCT basictype) AS n_types, 0.0::DOUBLE AS in_name FROM k WHERE w = 'tools' GROUP BY 1")
def g22(s: Samples) -> DataFrame:
    c = s.catalog.withColumn("generic_keywords", F.concat(F.lit("tools, "), "flavor"))
    return X.umbrella_words(c, types=6)


@case("g23_flavor_conflict", sql_of("catalog") + " SELECT source_pos, CASE WHEN flavor = 'red' THEN basictype END AS bt FROM catalog")
def g23(s: Samples) -> DataFrame:
    return s.catalog.select("source_pos", G.flavor_conflict(F.col("basictype"), F.array(F.lit("red")), F.array("flavor")).alias("bt"))


@case("g24_guaranteed_keywords", sql_of("catalog") + " SELECT source_pos, ['top', 'near'] || CASE WHEN basictype = 'PROMO' THEN ['PROMO'] ELSE [] END || [flavor || ' ' || split_part(generic_keywords, ', ', 2), flavor] AS gk FROM catalog")
def g24(s: Samples) -> DataFrame:
    pair = F.array_join(F.slice(F.split("name", " "), 1, 2), " ")
    literal = G.literal_keywords(F.col("name"), F.array("flavor", F.lit("absent"), pair))
    return s.catalog.select("source_pos", G.guaranteed_keywords(F.array(F.lit("top")), F.array(F.lit("near")), F.col("basictype"), F.array(F.lit("PROMO")), literal).alias("gk"))


@case("g25_g26_allowed_tags", sql_of("catalog") + " SELECT source_pos AS uid, flavor AS tag FROM catalog WHERE flavor IN ('red', 'blue') OR basictype = 'PROMO'")
def g25(s: Samples) -> DataFrame:
    c = s.catalog.select(F.col("source_pos").alias("uid"), F.col("basictype").alias("bt"), F.col("flavor").alias("tag"))
    known = s.catalog.filter("basictype <> 'PROMO'").select("basictype").distinct().withColumn("keywords", F.array(F.lit("Red"), F.lit("BLUE")))
    return G.allowed_tags(c, known, "market").select("uid", "tag")


@case("g27_synthetic_tags", sql_of("catalog") + " SELECT source_pos, CASE WHEN domain = 'market' THEN [brand || ' ' || basictype, brand || ' ' || category] ELSE [flavor, 'egg', flavor || ' & egg'] END AS tags FROM catalog")
def g27(s: Samples) -> DataFrame:
    make = lambda d: G.synthetic_tags(d, F.col("basictype"), F.col("brand"), F.col("category"), F.array("flavor", F.lit("egg")))
    return s.catalog.select("source_pos", F.when(F.col("domain") == "market", make("market")).otherwise(make("food")).alias("tags"))


@case("g28_leaked_flavors", sql_of("catalog") + " SELECT source_pos, CASE WHEN flavor = 'red' THEN ['a', 'b'] ELSE ['b'] END AS tags FROM catalog")
def g28(s: Samples) -> DataFrame:
    return s.catalog.select("source_pos", G.drop_leaked_flavors(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("red")), F.array("flavor")), F.array("flavor")).alias("tags"))


@case("g29_rerank_cut", "SELECT l_orderkey AS uid, l_linenumber, l_quantity - 20 AS rerank_score FROM lineitem WHERE l_quantity >= 20 QUALIFY l_quantity >= max(l_quantity) OVER (PARTITION BY l_orderkey) - 2.5".replace("WHERE l_quantity >= 20 QUALIFY", "QUALIFY l_quantity >= 20 AND"))
def g29(s: Samples) -> DataFrame:
    return G.rerank_cut(s.base("lineitem").select(F.col("l_orderkey").alias("uid"), "l_linenumber", (F.col("l_quantity") - 20).alias("rerank_score")))


@case("g30_merge_keywords", sql_of("catalog") + " SELECT source_pos, [upper(flavor), 'x'] AS gk FROM catalog")
def g30(s: Samples) -> DataFrame:
    return s.catalog.select("source_pos", G.merge_keywords(F.array(F.upper("flavor")), F.lit(None).cast("array<string>"), F.array("flavor", F.lit("x"), F.lit("X"))).alias("gk"))


@case("g31_g32_status", f"WITH {_PRED} SELECT uid, CASE WHEN w >= 0.8 THEN w ELSE coalesce(f, 0) END AS confidence, CASE WHEN wl = 'P' THEN 'LOW' WHEN uid % 10 = 0 THEN 'AUTO' WHEN CASE WHEN w >= 0.8 THEN w ELSE coalesce(f, 0) END >= 0.8 THEN 'AUTO' WHEN CASE WHEN w >= 0.8 THEN w ELSE coalesce(f, 0) END >= 0.5 THEN 'REVIEW' ELSE 'LOW' END AS status FROM p")
def g31(s: Samples) -> DataFrame:
    _, w, f, _ = _predictions(s)
    rows = w.withColumnRenamed("confidence", "w").join(f.select("uid", F.col("confidence").alias("f")), "uid", "left")
    c = G.keyword_confidence(F.col("w"), F.col("f"))
    return rows.select("uid", c.alias("confidence"), G.tag_status(F.when(F.col("label") != "P", F.col("label")), c, F.when(F.col("uid") % 10 == 0, "override").otherwise("trained")).alias("status"))


@case("g33_reasoning", sql_of("catalog") + " SELECT source_pos, 'BT ''' || basictype || ''' by trained (0.50); third tag ''-'' by -; 1 keywords' AS reasoning FROM catalog")
def g33(s: Samples) -> DataFrame:
    null = F.lit(None).cast("string")
    return s.catalog.select("source_pos", G.reasoning(F.col("basictype"), F.lit("trained"), F.lit(0.5), null, null, F.array("flavor")).alias("reasoning"))


# --- H: templates


def _template_tables(s: Samples) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = s.catalog.select("source_pos", "name", F.lower("name").alias("clean_text"), F.concat("basictype", F.lit(" "), "flavor").alias("basictype"), F.array(F.concat("flavor", F.lit(" thing")), F.lit("goods")).alias("keywords"), _none().alias("brand"), F.array("flavor").alias("flavor"))
    i = s.catalog.select(F.col("source_pos").alias("uid"), "name", F.concat(F.lit("green"), F.substring("name", F.length("flavor") + 1, F.lit(99))).alias("clean_text"), _none().alias("brand"), F.array(F.lit("green")).alias("flavor"))
    d = s.catalog.select(F.lit("gk").alias("tag_type"), F.lit("Green Thing").alias("tag")).unionByName(s.catalog.select(F.lit("gk").alias("tag_type"), F.lit("Goods").alias("tag"))).unionByName(s.catalog.select(F.lit("bt").alias("tag_type"), F.concat("basictype", F.lit(" GREEN")).alias("tag"))).distinct()
    return i, c, d


@case("h01_modifiers", sql_of("catalog") + " SELECT source_pos, 'flavor' AS kind, flavor AS entity FROM catalog WHERE length(flavor) < 0.65 * length(name)")
def h01(s: Samples) -> DataFrame:
    return H.modifiers(_template_tables(s)[1], "source_pos")


@case("h02_h03_best_template")
def h02(s: Samples) -> DataFrame:
    i, c, _ = _template_tables(s)
    return H.best_templates(i, c).select("uid", "source_pos", "old_entity", F.round("ratio", 4).alias("ratio"))


@case("h04_swap_entity", sql_of("catalog") + " SELECT source_pos, 'green' || substr(name, length(flavor) + 1) AS name FROM catalog")
def h04(s: Samples) -> DataFrame:
    return s.catalog.select("source_pos", H.swap_entity(F.col("name"), F.upper("flavor"), F.lit("green")).alias("name"))


@case("h05_snap_tags")
def h05(s: Samples) -> DataFrame:
    i, c, d = _template_tables(s)
    raw = s.catalog.select(F.lit("gk").alias("tag_type"), F.concat("flavor", F.lit(" thing")).alias("raw"), F.col("flavor").alias("entity")).distinct()
    return H.snap_tags(raw.unionByName(raw.withColumn("raw", F.lit("green things"))), d)


@case("h06_suggest")
def h06(s: Samples) -> DataFrame:
    return H.suggest(*_template_tables(s)).select("uid", "suggested_bt", "suggested_gk")


@case("h07_enrich", sql_of("catalog") + " SELECT source_pos AS uid, CASE WHEN source_pos % 2 = 0 THEN 'NEW' ELSE basictype END AS bt, CASE WHEN source_pos % 2 = 0 THEN [flavor, 'x'] ELSE [flavor] END AS gk, CASE WHEN source_pos % 2 = 0 THEN 0.95 ELSE 0.5 END::DOUBLE AS bt_confidence, CASE WHEN source_pos % 2 = 0 THEN 'High Confidence' WHEN source_pos % 3 = 0 THEN 'AUTO' ELSE 'REVIEW' END AS status FROM catalog")
def h07(s: Samples) -> DataFrame:
    k = F.col("source_pos")
    r = s.catalog.select(k.alias("uid"), F.col("basictype").alias("bt"), F.array("flavor").alias("gk"), F.lit(0.5).alias("bt_confidence"), F.when((k % 2 == 1) & (k % 3 == 0), "AUTO").otherwise("REVIEW").alias("status"))
    sug = s.catalog.filter(k % 6 != 3).filter((k % 2 == 0) | (k % 3 == 0)).select(k.alias("uid"), F.lit("NEW").alias("suggested_bt"), F.array(F.upper("flavor"), F.lit("x")).alias("suggested_gk"))
    return H.enrich(r, sug, "matcher")


@case("h08_dictionary_fallback", sql_of("catalog") + " SELECT DISTINCT 'bt' AS tag_type, basictype AS tag FROM catalog UNION SELECT DISTINCT 'gk', flavor FROM catalog")
def h08(s: Samples) -> DataFrame:
    empty = s.spark.createDataFrame([], "tag_type string, tag string")
    return H.dictionary_or_catalog(empty, s.catalog.select("basictype", F.array("flavor").alias("keywords")))


# --- I: plans


@case("i01_shape", "SELECT p_partkey AS uid, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_retailprice END::DOUBLE AS price, '' AS description, p_type AS category FROM part")
def i01(s: Samples) -> DataFrame:
    return P.shape(s.base("part").select(F.col("p_partkey").alias("uid"), F.concat(F.lit(" "), "p_name").alias("sku"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_retailprice")).alias("price"), F.col("p_type").alias("category")))


def _tools(s: Samples) -> matcher.Tools:
    brands = D.alias_dictionary(s.brands.select("source_pos", "name", F.lit(None).cast("string").alias("aliases"), "is_weak"), ["is_weak"])
    return matcher.Tools(V.hashed_words(), V.token_logit, "market", brands, D.flavor_dictionary(s.flavors))


def _plain(s: Samples) -> DataFrame:
    """The catalog without its entity columns, so that both sides' entities come from the dictionaries."""
    return s.catalog.drop("brand", "flavor")


def _mixed(s: Samples) -> DataFrame:
    """The inputs, every seventh under a name that no catalog row resembles, so that it goes on to classification."""
    return s.inputs.withColumn("name", F.when(F.col("uid") % 7 == 0, F.concat(F.lit("unheard of item "), "uid")).otherwise(F.col("name")))


@case("i02_match_plan")
def i02(s: Samples) -> DataFrame:
    return matcher.match(s.spark, s.inputs, _plain(s), _tools(s))


@case("i03_classify_plan")
def i03(s: Samples) -> DataFrame:
    return P.classify(s.spark, s.inputs, _plain(s), _tools(s), _rules())


@case("i04_pipeline_plan")
def i04(s: Samples) -> DataFrame:
    return P.run(s.spark, _mixed(s), _plain(s), _tools(s), _rules())[0]


@case("i04_keys_and_maps")
def i04c(s: Samples) -> DataFrame:
    # every row is matched and classified, with predictions of a trained model for four rows of five
    p = s.inputs.select("uid", F.col("predicted_bt").alias("label"), F.col("bt_confidence").alias("confidence")).filter("uid % 5 <> 0")
    tools = matcher.written(_tools(s))
    classified, matched = together(lambda: classifier.classify(s.spark, _mixed(s), _plain(s), tools, trained=p).rows, lambda: matcher.match(s.spark, _mixed(s), _plain(s), tools))
    return P.with_rules(P.escalate(matched, classified), _rules())


@case("i04_escalation", sql_of("inputs") + ", m AS (SELECT uid, uid % 3 = 0 AS sure, bt_confidence AS c FROM inputs) SELECT uid, CASE WHEN sure OR c <= 0.3 THEN 'Matcher' ELSE 'Classifier' END AS pipeline_source, NOT sure AS escalated, CASE WHEN sure OR c <= 0.3 THEN 'm' ELSE 'c' END AS bt, CASE WHEN sure OR c <= 0.3 THEN 'note' ELSE 'Escalated from matcher [note] -> why' END AS logic_notes FROM m")
def i04b(s: Samples) -> DataFrame:
    sure = F.col("uid") % 3 == 0
    m = s.inputs.select("uid", "name", F.lit(None).cast("string").alias("matched_catalog_name"), F.lit(0.3).alias("score"), F.when(sure, "High Confidence").otherwise("Rejected").alias("status"), F.lit("m").alias("bt"), _none().alias("gk"), F.lit("note").alias("logic_notes"))
    c = s.inputs.select("uid", F.lit("c").alias("bt"), F.col("bt_confidence"), F.lit("AUTO").alias("bt_status"), _none().alias("gk"), F.lit("why").alias("reasoning"))
    return P.escalate(m, c).select("uid", "pipeline_source", "escalated", "bt", "logic_notes")


@case("i05_run_statistics", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS high, count(*) FILTER (o_orderstatus = 'O') AS medium, count(*) FILTER (o_orderstatus = 'P') AS low, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS match_rate FROM orders")
def i05(s: Samples) -> DataFrame:
    st = F.col("o_orderstatus")
    return P.run_statistics(s.base("orders").select(F.when(st == "F", "High Confidence").when(st == "O", "Medium Confidence").otherwise("Rejected").alias("status")), "matcher")


@case("i06_stage_trace")
def i06(s: Samples) -> DataFrame:
    t = P.run(s.spark, _mixed(s), _plain(s), _tools(s), _rules())[1]
    return t.select("uid", "input.name", "keys.match_source", F.size("candidates").alias("candidates"), F.size("gates").alias("gated"), "match.status", "escalation.pipeline_source", F.size("keywords").alias("keywords"), "final.bt", "final.rules_applied")


@case("i07_candidate_trace", "SELECT l_orderkey AS uid, l_linenumber AS cand, CAST(r AS INTEGER) AS rank, CASE WHEN l_returnflag = 'R' THEN -2.0 ELSE 0.0 END::DOUBLE AS token_penalty, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS brand_boost FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) x WHERE r <= 10")
def i07(s: Samples) -> DataFrame:
    long = F.when(F.col("l_returnflag") == "R", "one two three four Acme").otherwise("one two")
    rows = s.base("lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("cand"), F.lit("one two").alias("input_text"), long.alias("cand_text"), F.lit("acme").alias("brand"), F.col("l_extendedprice").alias("rerank_score"))
    return P.candidate_trace(rows).select("uid", "cand", "rank", "token_penalty", "brand_boost")


@case("i08_win_loss", "SELECT l_orderkey AS uid, l_linenumber AS cand, l_linenumber = first_value(l_linenumber) OVER w AS won FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)")
def i08(s: Samples) -> DataFrame:
    return P.win_loss(s.base("lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("cand"), F.col("l_extendedprice").alias("score"))).select("uid", "cand", "won")


@case("i09_keyword_decisions", sql_of("catalog") + " SELECT source_pos AS uid, flavor AS tag, 'map' AS source, 1.0::DOUBLE AS score, true AS selected FROM catalog UNION ALL SELECT source_pos, 'extra', 'search', 0.5, false FROM catalog")
def i09(s: Samples) -> DataFrame:
    t = lambda c, x: s.catalog.select(F.col("source_pos").alias("uid"), c.alias("tag"), F.lit(x).alias("score"))
    return P.keyword_decisions([("map", t(F.col("flavor"), 1.0)), ("search", t(F.upper("flavor"), 0.7).unionByName(t(F.lit("extra"), 0.5)))], t(F.col("flavor"), 0.0))


@case("i10_audit_rows", sql_of("inputs") + " SELECT uid AS sku_uid, 'j1' AS job_id, 'classifier' AS match_source, bt_confidence AS confidence, 'market' AS domain FROM inputs")
def i10(s: Samples) -> DataFrame:
    return P.audit_rows(s.inputs, "classifier", "market", "j1").select("sku_uid", "job_id", "match_source", "confidence", "domain")


# --- J: rules


def _rules() -> list[R.Rule]:
    c = lambda t, v, g=1, n=0: {"condition_group": g, "condition_type": t, "value": v, "negate": n}
    a = lambda t, v: {"action_type": t, "value": v}
    return [
        R.Rule("r1", priority=1, description="bolts", conditions=[c("sku_contains", "BOLT"), c("price_below", "1000")], actions=[a("set_bt", "Bolt"), a("add_gk", "fastener")]),
        R.Rule("r2", priority=2, description="rings", condition_logic="AND", conditions=[c("sku_contains", "ring"), c("sku_contains", "rod"), c("bt_is", "bolt", 2, 1)], actions=[a("add_gk", "round"), a("normalize_sku", "ring|Ring")]),
        R.Rule("r3", priority=3, description="renamed", conditions=[c("bt_is", " bolt ")], actions=[a("set_visibility", "hidden"), a("remove_gk", "base")]),
        R.Rule("r4", priority=4, description="always", actions=[a("set_region", "all")]),
    ]


def _records(s: Samples) -> DataFrame:
    return s.base("part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("sku_name"), F.col("p_type").alias("bt"), F.array(F.lit("base")).alias("gk"), F.lit(None).cast("string").alias("region"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"), F.lit(None).cast("string").alias("visibility"))


_RULES = """r AS (SELECT p_partkey AS uid, p_name, p_type, p_retailprice, p_name LIKE '%bolt%' AND p_retailprice < 1000 AS f1, (p_name LIKE '%ring%' OR p_name LIKE '%rod%') AS f2 FROM part)"""


@case("j02_j15_rules_in_order", f"WITH {_RULES} SELECT uid, CASE WHEN f2 THEN replace(p_name, 'ring', 'Ring') ELSE p_name END AS sku_name, CASE WHEN f1 THEN 'Bolt' ELSE p_type END AS bt, CASE WHEN f1 THEN ['fastener'] WHEN f2 THEN ['base', 'round'] ELSE ['base'] END AS gk, 'all' AS region, CASE WHEN f1 THEN 'hidden' END AS visibility, CASE WHEN f1 THEN ['r1', 'r3', 'r4'] WHEN f2 THEN ['r2', 'r4'] ELSE ['r4'] END AS rules FROM r")
def j15(s: Samples) -> DataFrame:
    return R.apply_rules(_records(s), _rules()).select("uid", "sku_name", "bt", "gk", "region", "visibility", F.transform("rules_applied", lambda x: x["rule_id"]).alias("rules"))


@case("j07_price_conditions", "SELECT p_partkey AS uid, p_partkey % 4 <> 0 AND p_retailprice < 950 AS below, p_partkey % 4 <> 0 AND p_retailprice > 950 AS above, p_partkey % 4 = 0 OR p_retailprice >= 950 AS not_below FROM part")
def j07(s: Samples) -> DataFrame:
    rows = _records(s).withColumn("price", F.when(F.col("uid") % 4 != 0, F.col("price")))
    c = lambda t, n=0: R.condition({"condition_type": t, "value": "950", "negate": n})
    return rows.select("uid", c("price_below").alias("below"), c("price_above").alias("above"), c("price_below", 1).alias("not_below"))


@case("j08_j09_flavor_conditions", "SELECT p_partkey AS uid, split_part(p_name, ' ', 1) = 'blue' OR p_name LIKE '%bolt' AS contains, split_part(p_name, ' ', 1) = 'blue' OR p_name LIKE '%bolt' AS veg FROM part")
def j08(s: Samples) -> DataFrame:
    rows = R.flavor_hits(_records(s), D.flavor_dictionary(s.flavors), "uid")
    return rows.select("uid", R.condition({"condition_type": "flavor_contains", "value": "Blue"}).alias("contains"), R.condition({"condition_type": "flavor_is", "value": "veg"}).alias("veg"))


@case("j11_group_logic", "SELECT p_partkey AS uid, p_type = 'PROMO' AND p_brand LIKE '%1%' AS all_groups, p_type = 'PROMO' OR p_brand LIKE '%1%' AS any_group FROM part")
def j11(s: Samples) -> DataFrame:
    c = [{"condition_group": 1, "condition_type": "bt_is", "value": "promo"}, {"condition_group": 2, "condition_type": "category_contains", "value": "1"}]
    return _records(s).select("uid", R.fires(R.Rule("x", condition_logic="AND", conditions=c)).alias("all_groups"), R.fires(R.Rule("x", conditions=c)).alias("any_group"))


@case("j16_dry_run", f"WITH {_RULES} SELECT uid, f1 AS fired, CASE WHEN f1 THEN 'BT changed to ''Bolt''; Added GK ''fastener''' ELSE '' END AS change FROM r")
def j16(s: Samples) -> DataFrame:
    return R.dry_run(_records(s), _rules()[0]).select("uid", "fired", "change")


@case("j17_rerun_rules", f"WITH {_RULES} SELECT uid, CASE WHEN f1 THEN 'Bolt' ELSE p_type END AS bt FROM r")
def j17(s: Samples) -> DataFrame:
    return R.apply_rules(R.apply_rules(_records(s), _rules()), _rules()).select("uid", "bt")


def _rule_tables(s: Samples) -> tuple[DataFrame, DataFrame, DataFrame]:
    sup = s.base("supplier")
    rid = F.concat(F.lit("r"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("rule_id")
    rules = sup.select(rid, F.when(F.col("s_suppkey") % 7 == 0, "pets").when(F.col("s_suppkey") % 2 == 0, "market").otherwise("shared").alias("domain"), (F.col("s_suppkey") % 5).cast("int").alias("priority"), F.col("s_name").alias("description"), F.lit("").alias("reasoning"), F.lit("OR").alias("condition_logic"), (F.col("s_suppkey") % 3 != 0).alias("is_active"))
    conditions = sup.filter("s_suppkey % 2 = 0").select(F.lit(1).alias("id"), rid, F.lit(1).alias("condition_group"), F.lit("price_below").alias("condition_type"), F.when(F.col("s_suppkey") % 4 == 0, "cheap").otherwise("10").alias("value"), F.lit(0).alias("negate"))
    actions = sup.select(F.lit(1).alias("id"), rid, F.lit("add_gk").alias("action_type"), F.col("s_name").alias("value"))
    return rules, conditions, actions


@case("j01_rule_selection", "SELECT rank, 'r' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS rule_id FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 5, s_suppkey % 2 = 0, s_suppkey) AS rank FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0) x")
def j01(s: Samples) -> DataFrame:
    return R.selected(R.assemble(*_rule_tables(s)), "market").select("rank", "rule_id")


@case("j18_rule_validation", "SELECT 'r' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS rule_id, unnest(list_filter([CASE WHEN s_suppkey % 7 = 0 THEN 'domain' END, CASE WHEN s_suppkey % 5 = 0 THEN 'priority' END, CASE WHEN s_suppkey % 4 = 0 THEN 'condition_value' END], lambda x: x IS NOT NULL)) AS problem FROM supplier")
def j18(s: Samples) -> DataFrame:
    return R.violations(R.assemble(*_rule_tables(s)))


@case("j19_rule_assembly", "SELECT 'r' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS rule_id, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS n_conditions, 1 AS n_actions FROM supplier")
def j19(s: Samples) -> DataFrame:
    return R.assemble(*_rule_tables(s)).select("rule_id", F.coalesce(F.size("conditions"), F.lit(0)).alias("n_conditions"), F.size("actions").alias("n_actions"))
