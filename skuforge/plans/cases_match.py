"""Queries of entities, vectors and matching (D, E, F)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.functions import similarity as S
from skuforge.operators import entities as D
from skuforge.operators import gates as GT
from skuforge.operators import matching as M
from skuforge.operators import vectors as V
from skuforge.plans import ratio_sql as Q
from skuforge.plans.samples import Samples, sql_of
from skuforge.sources.shared import checkpointed

CASES: dict = {}


def case(name: str, sql: str | None = None):
    def add(f):
        CASES[name] = (f, sql)
        return f

    return add


# --- D: dictionaries and entities

_FLAVORS = sql_of("flavors", "inputs") + """, fl AS (SELECT DISTINCT lower(name) AS canonical, unnest(list_filter(list_transform(string_split(coalesce(lower(aliases), '') || ',' || lower(name), ','), lambda x: trim(x)), lambda x: x <> '')) AS alias FROM flavors),
  kinds AS (SELECT lower(name) AS canonical, bool_or(is_meat) AS m, bool_or(is_vegetable) AS v, bool_or(is_seafood) AS s FROM flavors GROUP BY 1),
  words AS (SELECT uid, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM inputs),
  found AS (SELECT DISTINCT uid, canonical FROM words JOIN fl ON w = alias)"""


def _flavors(s: Samples) -> DataFrame:
    return D.flavor_dictionary(s.flavors)


def _flavor_sets(s: Samples) -> DataFrame:
    hits = D.scan(s.inputs, _flavors(s), "uid", "name").groupBy("uid").agg(F.array_sort(F.collect_set("canonical")).alias("flavor"))
    return s.inputs.select("uid", "name").join(hits, "uid", "left").withColumn("flavor", F.coalesce("flavor", F.array().cast("array<string>")))


@case("d01_alias_dictionary", sql_of("brands") + """, a AS (SELECT source_pos, lower(name) AS canonical, unnest([lower(name), lower(name) || 's', lower(split_part(aliases, ', ', 2))]) AS alias FROM brands)
  SELECT alias, arg_max(canonical, source_pos) AS canonical FROM a GROUP BY alias""")
def d01(s: Samples) -> DataFrame:
    return D.alias_dictionary(s.brands).select("alias", "canonical")


@case("d02_flavor_dictionary", _FLAVORS + " SELECT DISTINCT alias, canonical, m AS is_meat, v AS is_vegetable, s AS is_seafood FROM fl JOIN kinds USING (canonical)")
def d02(s: Samples) -> DataFrame:
    return _flavors(s).drop("words")


@case("d03_entity_scan", _FLAVORS + " SELECT uid, canonical AS flavor FROM found")
def d03(s: Samples) -> DataFrame:
    return D.scan(s.inputs, _flavors(s), "uid", "name").select("uid", F.col("canonical").alias("flavor")).distinct()


@case("d03_entities", _FLAVORS + ", b AS (SELECT uid, CASE WHEN uid % 4 = 1 THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS x FROM inputs JOIN part ON uid = p_partkey), f AS (SELECT uid, list_sort(list(canonical)) AS flavor FROM found GROUP BY uid) SELECT inputs.uid, coalesce(flavor, []) AS flavor FROM inputs LEFT JOIN f USING (uid)")
def d03b(s: Samples) -> DataFrame:
    brands = D.alias_dictionary(s.brands, ["is_weak"])
    return D.entities(s.inputs, brands, _flavors(s), "uid", "name").select("uid", "flavor")


@case("d04_fuzzy_entities", sql_of("brands", "inputs") + f""", al AS (SELECT source_pos, lower(name) AS canonical, unnest([lower(name), lower(name) || 's', lower(split_part(aliases, ', ', 2))]) AS alias FROM brands),
  dict AS (SELECT alias, arg_max(canonical, source_pos) AS canonical FROM al GROUP BY alias), tk AS (SELECT uid, regexp_extract_all(regexp_replace(lower(name), 'widget', 'widgget', 'g'), '[a-z0-9]+') AS t FROM inputs),
  spots AS (SELECT uid, t, unnest(range(len(t))) AS i FROM tk),
  grams AS (SELECT uid, 2 * i AS pos, t[i + 1] AS g FROM spots WHERE length(t[i + 1]) >= 4 UNION ALL SELECT uid, 2 * i + 1, t[i + 1] || ' ' || t[i + 2] FROM spots WHERE i + 2 <= len(t)),
  pairs AS (SELECT g AS a, alias AS b FROM (SELECT DISTINCT g FROM grams) AS d, dict WHERE 200.0 * least(length(g), length(alias)) >= 85 * (length(g) + length(alias))), {Q.ratio("pairs", "q")},
  best AS (SELECT a AS g, (min(struct_pack(r := -r, b := b))).b AS alias FROM q WHERE r >= 85 GROUP BY a)
  SELECT uid, (min(struct_pack(pos := pos, alias := alias, c := canonical))).c AS canonical FROM grams JOIN best USING (g) JOIN dict USING (alias) GROUP BY uid""")
def d04(s: Samples) -> DataFrame:
    misspelt = s.inputs.select("uid", F.regexp_replace(F.lower("name"), "widget", "widgget").alias("name"))
    return D.fuzzy_entities(misspelt, D.alias_dictionary(s.brands), "uid", "name")


#: Pairs that could be alike: by length, and by the characters that they share, counted one by one.
_C04 = sql_of("inputs", "catalog") + f"""
, chars AS (SELECT string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', '') AS cs),
counted AS (SELECT t, list_transform(cs, lambda ch: length(t) - length(replace(t, ch, ''))) AS n
            FROM chars, (SELECT DISTINCT lower(name) AS t FROM inputs UNION SELECT DISTINCT name FROM catalog) AS x),
pairs AS (
  SELECT x.t AS a, y.t AS b FROM counted x, counted y
  WHERE x.t IN (SELECT lower(name) FROM inputs) AND y.t IN (SELECT name FROM catalog)
    AND 200.0 * least(length(x.t), length(y.t)) >= 85 * (length(x.t) + length(y.t))
    AND 200.0 * (list_sum(list_transform(range(1, 38), lambda k: least(x.n[k], y.n[k]))) + least(length(x.t) - list_sum(x.n), length(y.t) - list_sum(y.n)))
        >= 85 * (length(x.t) + length(y.t))),
{Q.ratio("pairs", "q")}
SELECT a AS text, (min(struct_pack(r := -r, b := b))).b AS choice, round(-(min(struct_pack(r := -r, b := b))).r, 4) AS ratio FROM q WHERE r >= 85 GROUP BY a"""


@case("c04_best_in_dictionary", _C04)
def c04(s: Samples) -> DataFrame:
    best = D.best_in_dictionary(s.inputs.select(F.lower("name").alias("text")), s.catalog.select(F.col("name").alias("choice")), "text", "choice", 85.0)
    return best.withColumn("ratio", F.round("ratio", 4))


@case("d05_prefilled", sql_of("catalog") + " SELECT source_pos, CASE WHEN source_pos % 2 = 0 THEN [lower(brand)] ELSE ['scanned'] END AS brand FROM catalog")
def d05(s: Samples) -> DataFrame:
    own = F.when(F.col("source_pos") % 2 == 0, F.col("brand")).otherwise(" ")
    return s.catalog.select("source_pos", D.prefilled(own, F.array(F.lit("scanned"))).alias("brand"))


@case("d06_resolve_words", sql_of("catalog") + " SELECT source_pos, list_distinct_ordered AS resolved FROM (SELECT source_pos, CASE flavor WHEN 'hot' THEN ['hot', 'zest'] ELSE [flavor, 'hot', 'zest'] END AS list_distinct_ordered FROM catalog) AS x")
def d06(s: Samples) -> DataFrame:
    return D.resolve_words(s.catalog.select("source_pos", F.array("flavor", F.lit("spicy hot"), F.lit("zest")).alias("e")), _flavors(s), "source_pos", "e")


@case("d07_flavors_of_text", _FLAVORS + " SELECT canonical AS flavor, count(*) AS n FROM found GROUP BY 1")
def d07(s: Samples) -> DataFrame:
    return D.scan(s.inputs, _flavors(s), "uid", "name").select("uid", "canonical").distinct().groupBy(F.col("canonical").alias("flavor")).agg(F.count(F.lit(1)).alias("n"))


_TRIAGE = _FLAVORS + """, t AS (SELECT inputs.uid, any_value(name) AS name, coalesce(list_sort(list(canonical) FILTER (m AND NOT s)), []) AS land_meats, coalesce(list_sort(list(canonical) FILTER (s)), []) AS seafood,
  coalesce(list_sort(list(canonical) FILTER (v AND NOT m AND NOT s)), []) AS vegetables FROM inputs LEFT JOIN found USING (uid) LEFT JOIN kinds USING (canonical) GROUP BY inputs.uid)"""


_SETS = sql_of("catalog", "flavors") + """, a AS (SELECT DISTINCT lower(trim(unnest(list_append(string_split(coalesce(aliases, ''), ','), name)))) AS alias, lower(name) AS canonical FROM flavors),
  al AS (SELECT alias, min(canonical) AS canonical FROM a WHERE alias <> '' GROUP BY alias), e AS (SELECT source_pos AS uid, unnest([lower(flavor), 'very ' || lower(flavor) || ' thing', 'no such']) AS e FROM catalog),
  x AS (SELECT uid, coalesce(q.canonical, w.canonical) AS c FROM e LEFT JOIN al q ON q.alias = e LEFT JOIN al w ON w.alias = string_split(e, ' ')[2]) """


@case("d08_canonical_flavors", _SETS + "SELECT uid, coalesce(list(DISTINCT c ORDER BY c) FILTER (c IS NOT NULL), CAST([] AS VARCHAR[])) AS flavors FROM x GROUP BY uid")
def d08(s: Samples) -> DataFrame:
    sets = s.catalog.select(F.col("source_pos").alias("uid"), F.array(F.upper("flavor"), F.concat(F.lit("Very "), "flavor", F.lit(" thing")), F.lit("no such")).alias("flavor"))
    return D.canonical_flavors(sets, D.flavor_dictionary(s.flavors))


@case("d09_flavor_triage", _TRIAGE + " SELECT uid, land_meats, seafood, vegetables FROM t")
def d09(s: Samples) -> DataFrame:
    return D.triage(_flavor_sets(s), _flavors(s))


@case("d10_name_enrichment", _TRIAGE + " SELECT uid, CASE WHEN (len(land_meats) > 0 AND len(seafood) > 0) OR len(land_meats) > 1 THEN name || ' mixed' WHEN len(land_meats) = 0 AND len(seafood) = 0 AND len(vegetables) > 0 THEN name || ' veg' ELSE name END AS name FROM t")
def d10(s: Samples) -> DataFrame:
    rows = s.inputs.select("uid", "name").join(D.triage(_flavor_sets(s), _flavors(s)), "uid")
    return rows.select("uid", D.enrich_name(F.col("name"), F.col("land_meats"), F.col("seafood"), F.col("vegetables")).alias("name"))


@case("d11_special_terms", _FLAVORS + " SELECT DISTINCT 'specific' AS kind, canonical AS term FROM fl")
def d11(s: Samples) -> DataFrame:
    return D.special_terms(_flavors(s))


@case("d12_strip_brands", sql_of("catalog") + " SELECT source_pos, split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 3) AS rest FROM catalog")
def d12(s: Samples) -> DataFrame:
    return s.catalog.select("source_pos", D.strip_brands(F.col("name"), F.array(F.split_part("name", F.lit(" "), F.lit(2)), F.lit("g"))).alias("rest"))


@case("d13_longest_brand", "SELECT p_partkey, 'Brand ' || upper(substr(w, 1, 1)) || substr(w, 2) AS brand FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS w FROM part) AS x")
def d13(s: Samples) -> DataFrame:
    w = F.split_part("p_name", F.lit(" "), F.lit(2))
    return s.base("part").select("p_partkey", D.longest_brand(F.array(F.lit("ab"), w, F.concat(F.lit("brand "), w))).alias("brand"))


# --- E: vectors. The corpus is the whole table; queries are the stated set vec_id divisible by 20

_QUERY = "query_id IN (SELECT uid FROM vectors WHERE uid % 20 = 0)"
_DENSE = sql_of("vectors") + """, sc AS (SELECT q.uid AS query_id, c.uid, CAST(list_inner_product(q.vector::DOUBLE[], c.vector::DOUBLE[]) AS DOUBLE) AS score, q.class = c.class AS same FROM vectors q JOIN vectors c ON q.uid % 20 = 0),
  dr AS (SELECT query_id, uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM sc)"""


def _queries(s: Samples) -> DataFrame:
    return s.vectors.filter(F.col("uid") % 20 == 0).select(F.col("uid").alias("query_id"), "vector", "class")


_LETTERS = "aegt"


def _letter_counts(texts: list[str]) -> np.ndarray:
    """An encoder that SQL can repeat."""
    return np.array([[t.count(c) for c in _LETTERS] for t in texts], dtype=np.float32).reshape(-1, len(_LETTERS))


_COUNTS = ", ".join(f"length(name) - length(replace(name, '{c}', ''))" for c in _LETTERS)


@case("e01_encode_distinct", sql_of("catalog") + f", v AS (SELECT source_pos, [{_COUNTS}]::DOUBLE[] AS v FROM catalog), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v) SELECT source_pos, list_transform(v, lambda x: CASE WHEN n > 0 THEN round(x / n, 4) ELSE 0 END) AS vector FROM n")
def e01(s: Samples) -> DataFrame:
    coded = V.encode(s.catalog.select("source_pos", "name"), "name", _letter_counts)
    return coded.select("source_pos", F.transform("vector", lambda x: F.round(x.cast("double"), 4)).alias("vector"))


@case("e02_weighted_vector", """SELECT vec_id, round(list_cosine_similarity(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 0.3 * embedding[65 - i]::DOUBLE END), embedding::DOUBLE[]), 6) AS cosine FROM embeddings""")
def e02(s: Samples) -> DataFrame:
    e = s.base("embeddings")
    v = V.weighted_vector([(F.lit("name"), F.col("embedding")), (F.when(F.col("vec_id") % 2 == 0, " ").otherwise("text"), F.reverse("embedding")), (F.lit("nan"), F.col("embedding"))], V.MATCH_WEIGHTS)
    return e.select("vec_id", F.round(S.cosine(v, F.col("embedding")), 6).alias("cosine"))


@case("e03_merged_sparse", "SELECT event_id, greatest(value, 0.3 * value * 4) AS a, 0.3 * value AS b FROM events".replace("greatest(value, 0.3 * value * 4)", "round(greatest(value, 0.3 * (value * 4)), 6)").replace("0.3 * value AS b", "round(0.3 * value, 6) AS b"))
def e03(s: Samples) -> DataFrame:
    v = F.col("value")
    m = V.merged_sparse([F.create_map(F.lit(1), v), F.create_map(F.lit(1), v * 4, F.lit(2), v)], (1.0, 0.3))
    return s.base("events").select("event_id", F.round(F.element_at(m, 1), 6).alias("a"), F.round(F.element_at(m, 2), 6).alias("b"))


@case("e04_encode_missing", "SELECT p_partkey AS uid, 64 AS width FROM part WHERE p_partkey % 3 <> 0")
def e04(s: Samples) -> DataFrame:
    rows = s.base("part").select(F.col("p_partkey").alias("uid"), "p_name")
    return V.encode_missing(rows, rows.filter("uid % 3 = 0").select("uid"), "uid", "p_name", V.hashed_words()).select("uid", F.size("vector").alias("width"))


@case("e05_upsert", "SELECT p_partkey AS uid, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS x FROM part UNION ALL SELECT p_partkey + 1000000000, p_retailprice FROM part WHERE p_partkey % 5 = 1")
def e05(s: Samples) -> DataFrame:
    rows = s.base("part").select(F.col("p_partkey").alias("uid"), F.col("p_retailprice").alias("x"))
    new = rows.filter("uid % 5 = 0").select("uid", (F.col("x") + 1).alias("x")).union(rows.filter("uid % 5 = 1").select(F.col("uid") + 1000000000, "x"))
    return V.upsert(rows, new, "uid")


@case("e06_dense_top_k", _DENSE + " SELECT query_id, uid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM dr WHERE rank <= 10")
def e06(s: Samples) -> DataFrame:
    hits = V.dense_top_k(s.spark, _queries(s), s.vectors, 10)
    return hits.select("query_id", "uid", F.round("score", 6).alias("score"), "rank")


@case("e06_filtered_top_k", _DENSE + ", f AS (SELECT query_id, uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM sc WHERE same AND score >= 0.2) SELECT query_id, uid, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 5")
def e06b(s: Samples) -> DataFrame:
    return V.dense_top_k(s.spark, _queries(s), s.vectors, 5, least=0.2, same="class").select("query_id", "uid", "rank")


_SPARSE = """dw AS (SELECT doc_id, w AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents) x GROUP BY ALL),
  bw AS (SELECT item_id, w AS token, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM benchmark) x GROUP BY ALL),
  ss AS (SELECT item_id AS query_id, doc_id AS uid, CAST(sum(bw.n * dw.n) AS DOUBLE) AS score FROM bw JOIN dw USING (token) GROUP BY ALL),
  sr AS (SELECT query_id, uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM ss)"""


#: Characters of text whose words one task counts.
TASK_TEXT = 4 << 20


def _counts(df: DataFrame, key: str, out: str) -> DataFrame:
    # by key first: a row's words then stay together, while they are counted and while scores of its pairs are added up; a task's share has a fixed length
    length = df.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-length // TASK_TEXT))
    w = df.select(key, "text").repartition(parts, key).select(F.col(key).alias(out), F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return w.groupBy(out, "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _sparse(s: Samples, k: int) -> DataFrame:
    return V.sparse_top_k(_counts(s.base("benchmark"), "item_id", "query_id"), _counts(s.base("documents"), "doc_id", "uid"), k)


def _pair_scores(s: Samples) -> DataFrame:
    return V.sparse_scores(_counts(s.base("benchmark"), "item_id", "query_id"), _counts(s.base("documents"), "doc_id", "uid"))


def _scores(s: Samples) -> DataFrame:
    """All scores, written once: the searches below read them several times."""
    return checkpointed(_pair_scores(s))


@case("c07_sparse_scores", f"WITH {_SPARSE} SELECT query_id, count(*) AS n, sum(score) AS total FROM ss GROUP BY 1")
def c07(s: Samples) -> DataFrame:
    return _pair_scores(s).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@case("e07_sparse_top_k", f"WITH {_SPARSE} SELECT query_id, uid, score, CAST(rank AS INTEGER) AS rank FROM sr WHERE rank <= 10")
def e07(s: Samples) -> DataFrame:
    return _sparse(s, 10).select("query_id", "uid", "score", "rank")


@case("e08_hybrid_search", _DENSE + ", rv AS (SELECT query_id, uid, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product((SELECT vector FROM vectors v WHERE v.uid = query_id)::DOUBLE[], list_reverse((SELECT vector FROM vectors v WHERE v.uid = sc.uid))::DOUBLE[]) DESC, uid) AS rank FROM sc), f AS (SELECT query_id, uid, sum(s) AS score FROM (SELECT query_id, uid, 1.0 / (60 + rank) AS s FROM dr WHERE rank <= 50 UNION ALL SELECT query_id, uid, 1.0 / (60 + rank) FROM rv WHERE rank <= 50) u GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, uid) AS rank FROM f) SELECT query_id, uid, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 30")
def e08(s: Samples) -> DataFrame:
    dense = V.dense_top_k(s.spark, _queries(s), s.vectors, 50)
    other = V.dense_top_k(s.spark, _queries(s), s.vectors.select("uid", F.reverse("vector").alias("vector")), 50)
    fused = V.reciprocal_rank_fusion([dense, other]).withColumn("score", F.round("score", 12))
    return V.top_k(fused, "query_id", "score", "uid", 30).select("query_id", "uid", F.round("score", 9).alias("score"), "rank")


@case("e09_allowed_tags", f"WITH {_SPARSE}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS r FROM ss WHERE (uid + query_id) % 2 = 0) SELECT query_id, uid, score, CAST(r AS INTEGER) AS rank FROM a WHERE r <= 50")
def e09(s: Samples) -> DataFrame:
    scores = _scores(s)
    return V.allowed_tag_search(scores, scores.filter((F.col("uid") + F.col("query_id")) % 2 == 0).select("query_id", "uid"))


@case("e10_rank_fusion", f"WITH {_SPARSE}, other AS (SELECT query_id, uid, row_number() OVER (PARTITION BY query_id ORDER BY score, uid) AS rank FROM ss) SELECT query_id, uid, round(sum(s), 9) AS score FROM (SELECT query_id, uid, 1.0 / (60 + rank) AS s FROM sr WHERE rank <= 20 UNION ALL SELECT query_id, uid, 1.0 / (60 + rank) FROM other WHERE rank <= 20) u GROUP BY ALL")
def e10(s: Samples) -> DataFrame:
    scores = _scores(s)
    worst = V.top_k(scores.withColumn("score", -F.col("score")), "query_id", "score", "uid", 20)
    return V.reciprocal_rank_fusion([V.top_k(scores, "query_id", "score", "uid", 20), worst]).select("query_id", "uid", F.round("score", 9).alias("score"))


@case("e11_weighted_fusion", f"WITH {_SPARSE} SELECT query_id, uid, round(0.5 * score + 0.5 * score / 2, 6) AS score FROM ss")
def e11(s: Samples) -> DataFrame:
    scores = _scores(s)
    return V.weighted_fusion(scores, scores.withColumn("score", F.col("score") / 2)).select("query_id", "uid", F.round("score", 6).alias("score"))


@case("e12_expand_queries", sql_of("catalog") + " SELECT source_pos, 'filtered' AS kind, name AS query, basictype AS bt FROM catalog UNION ALL SELECT source_pos, 'open', name, NULL FROM catalog UNION ALL SELECT source_pos, 'stripped', split_part(name, ' ', 1), NULL FROM catalog")
def e12(s: Samples) -> DataFrame:
    return V.expand_queries(s.catalog, "source_pos", F.col("name"), F.col("basictype"), F.split_part("name", F.lit(" "), F.lit(1)))


@case("e13_candidate_pool", sql_of("catalog") + ", h AS (SELECT basictype AS query_id, source_pos AS uid, name AS clean_text, price AS score FROM catalog), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, clean_text ORDER BY score DESC, uid) AS n FROM h), r AS (SELECT query_id, uid, clean_text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS pool_rank FROM p WHERE n = 1) SELECT query_id, uid, clean_text, CAST(pool_rank AS INTEGER) AS pool_rank FROM r WHERE pool_rank <= 15")
def e13(s: Samples) -> DataFrame:
    hits = s.catalog.select(F.col("basictype").alias("query_id"), F.col("source_pos").alias("uid"), F.col("name").alias("clean_text"), F.col("price").alias("score"))
    return V.candidate_pool(hits).drop("score")


@case("e14_rerank", sql_of("catalog") + ", pairs AS (SELECT source_pos, name AS a, basictype AS b FROM catalog), " + Q.token_sorted("pairs", "q") + " SELECT source_pos, round(r / 10 - 5, 6) AS rerank_score FROM pairs JOIN q USING (a, b)")
def e14(s: Samples) -> DataFrame:
    return V.rerank(s.catalog.select("source_pos", "name", "basictype"), "name", "basictype", V.token_logit).select("source_pos", F.round("rerank_score", 6).alias("rerank_score"))


@case("e14_missing_scorer", sql_of("catalog") + " SELECT source_pos, CAST(-10 AS DOUBLE) AS rerank_score FROM catalog")
def e14b(s: Samples) -> DataFrame:
    return V.rerank(s.catalog.select("source_pos", "name", "basictype"), "name", "basictype", None).select("source_pos", "rerank_score")


@case("e15_reconcile_hashes", "SELECT coalesce(l.p_partkey, r.p_partkey) AS uid, coalesce(l.p_name, r.p_brand) AS row_hash FROM (SELECT * FROM part WHERE p_size > 10) l FULL JOIN (SELECT * FROM part WHERE p_size < 40) r USING (p_partkey)")
def e15(s: Samples) -> DataFrame:
    p = s.base("part").withColumnRenamed("p_partkey", "uid")
    return V.reconcile_hashes(p.filter("p_size < 40").select("uid", F.col("p_brand").alias("row_hash")), p.filter("p_size > 10").select("uid", F.col("p_name").alias("row_hash")))


@case("e16_semantic_dedup", sql_of("vectors") + """, near AS (SELECT b.uid, list(a.uid) AS e FROM vectors a JOIN vectors b ON a.uid < b.uid AND list_inner_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) >= 0.7 GROUP BY b.uid),
  x AS (SELECT list(list_concat([v.uid], coalesce(e, [])) ORDER BY v.uid) AS xs FROM vectors v LEFT JOIN near USING (uid))
  SELECT unnest(list_reduce(xs, lambda acc, x: CASE WHEN list_has_any(acc, x[2:]) THEN acc ELSE list_append(acc, x[1]) END, CAST([] AS BIGINT[]))) AS uid FROM x""")
def e16(s: Samples) -> DataFrame:
    return V.semantic_dedup(s.spark, s.vectors.select("uid", "vector"), 0.7)


# --- F: matching

_MATCH = sql_of("catalog", "inputs") + """, c AS (SELECT *, lower(name) AS clean, split_part(name, ' ', 1) AS a, split_part(name, ' ', 2) AS b, CAST(regexp_extract(name, '([0-9]+)g', 1) AS BIGINT) AS w FROM catalog),
  i AS (SELECT uid, p.p_size AS size, split_part(p.p_name, ' ', 1) AS a, split_part(p.p_name, ' ', 2) AS b, uid % 4 AS k, CASE WHEN bt_confidence >= CASE WHEN bt_source = 'zero-shot' THEN 0.4 ELSE 0.5 END THEN predicted_bt END AS bt FROM inputs JOIN part p ON uid = p.p_partkey),
  ic AS (SELECT *, CASE k WHEN 0 THEN a || ' ' || b || ' ' || size || 'g' WHEN 1 THEN b || ' ' || a || ' ' || size || 'g' WHEN 2 THEN a || ' ' || b || ' ' || 2 * size || 'g' ELSE a || ' ' || b || ' pro' END AS clean FROM i),
  ex AS (SELECT uid, min(source_pos) FILTER (ic.bt IS NULL OR ic.bt = c.basictype) AS exact_pos, true AS key_known FROM ic JOIN c USING (clean) GROUP BY uid)"""
# the word-sorted key of a two-word name is the same for both orders; the closest weight, then the lowest position
_TOKEN = _MATCH + """, tk AS (SELECT uid, min(struct_pack(gap := abs(iw - w) / greatest(iw, w) * 100, pos := source_pos, w := w)) AS best, any_value(iw) AS iw FROM
   (SELECT ic.uid, ic.bt, c.basictype, CASE ic.k WHEN 2 THEN size WHEN 3 THEN NULL ELSE size END AS iw, c.w, source_pos FROM ic JOIN c ON least(ic.a, ic.b) = least(c.a, c.b) AND greatest(ic.a, ic.b) = greatest(c.a, c.b) WHERE ic.k <> 3) x
   WHERE bt IS NULL OR bt = basictype GROUP BY uid)"""


def _prepared(s: Samples) -> tuple[DataFrame, DataFrame]:
    """Both sides cleaned once: the matches below read them several times."""
    return checkpointed(M.prepare(s.inputs)), checkpointed(M.prepare(s.catalog))


@case("f01_exact_match", _MATCH + " SELECT uid, exact_pos, key_known FROM ex")
def f01(s: Samples) -> DataFrame:
    return M.exact_matches(*_prepared(s))


@case("f02_f03_token_match", _TOKEN + " SELECT uid, best.pos AS token_pos, CASE WHEN best.gap < 1 THEN 'Weight Match (' || iw || ')' ELSE 'Weight Mismatch (' || iw || ' vs ' || best.w || ')' END AS weight_note FROM tk")
def f02(s: Samples) -> DataFrame:
    return M.token_matches(*_prepared(s))


@case("f4_match_cascade", _TOKEN + """ SELECT ic.uid, CASE WHEN exact_pos IS NOT NULL THEN exact_pos WHEN key_known IS NULL THEN best.pos END AS matched_pos,
  CASE WHEN exact_pos IS NOT NULL OR (key_known IS NULL AND best IS NOT NULL) THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN exact_pos IS NOT NULL THEN 'exact' WHEN key_known IS NULL AND best IS NOT NULL THEN 'token' ELSE 'vector' END AS match_source,
  CASE WHEN exact_pos IS NOT NULL THEN 'Exact Text Match' WHEN key_known IS NULL AND best IS NOT NULL THEN 'Fuzzy Match (100%) | ' || CASE WHEN best.gap < 1 THEN 'Weight Match (' || iw || ')' ELSE 'Weight Mismatch (' || iw || ' vs ' || best.w || ')' END ELSE '' END AS logic_notes,
  cc.name AS matched_catalog_name, cc.basictype AS matched_bt
  FROM ic LEFT JOIN ex USING (uid) LEFT JOIN tk USING (uid) LEFT JOIN catalog cc ON cc.source_pos = CASE WHEN exact_pos IS NOT NULL THEN exact_pos WHEN key_known IS NULL THEN best.pos END""")
def f4(s: Samples) -> DataFrame:
    i, c = _prepared(s)
    return M.named(M.cascade(i, c), c).select("uid", "matched_pos", "score", "match_source", "logic_notes", "matched_catalog_name", "matched_bt")


@case("f05_bt_threshold", sql_of("inputs") + " SELECT uid, bt_confidence >= CASE WHEN bt_source = 'zero-shot' THEN 0.4 ELSE 0.5 END AS confident FROM inputs")
def f05(s: Samples) -> DataFrame:
    return s.inputs.select("uid", M.bt_is_confident(F.col("bt_confidence"), F.col("bt_source")).alias("confident"))


def _word(c: str, n: int):
    return F.split_part(c, F.lit(" "), F.lit(n))


def _gate_pairs(s: Samples) -> DataFrame:
    """Each input with the catalog row of the same key, and with the row after it; by their keys' remainders they differ in words, form, weight, price, brand and flavor."""
    i, c = _prepared(s)
    u, p = F.col("uid"), F.col("source_pos")
    entity = lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))
    brand_in = F.when(u % 5 == 0, "widget").when(u % 5 == 1, "widgets")
    brand_cat = F.when(p % 3 == 0, "widgett").when(p % 3 == 1, "gadget")
    left = i.select(
        "uid", "clean_text", F.concat("clean_no_weights", F.when(u % 9 == 5, " xq").otherwise("")).alias("clean_no_weights"), "weight_val", "price", F.when(u % 3 == 0, "small").otherwise("large").alias("category"), "predicted_bt",
        F.struct(entity(brand_in).alias("brand"), entity(F.when(u % 7 > 0, _word("clean_text", 1))).alias("flavor")).alias("entities"),
    )
    w = F.col("weight_val")
    weight = F.struct(F.when(p % 11 == 0, w["value"] * 10).otherwise(w["value"]).alias("value"), w["unit"].alias("unit"), F.when(p % 13 == 0, "liquid").otherwise(w["form"]).alias("form"))
    right = c.select(
        "source_pos", F.col("clean_text").alias("c_clean_text"), F.col("clean_no_weights").alias("c_clean_no_weights"), weight.alias("c_weight_val"), (F.col("price") + F.when(p % 4 == 0, 100).otherwise(0)).alias("c_price"), F.col("basictype").alias("c_basictype"),
        F.array("flavor").alias("c_generic_keywords"), F.concat("category", F.when(p % 6 == 0, " Ice Cream").otherwise("")).alias("c_categories"),
        F.struct(entity(brand_cat).alias("brand"), entity(F.when(p % 10 > 0, F.col("flavor"))).alias("flavor")).alias("c_entities"),
    )
    keys = left.select("uid", F.explode(F.array("uid", F.col("uid") + 1)).alias("source_pos"))
    rows = keys.join(left, "uid").join(right, "source_pos").withColumn("raw_score", (F.col("source_pos") % 9 - 3).cast("double"))
    return GT.with_ratios(rows)


# the pairs of _gate_pairs, their ratios, and the entity checks ck: v and w are the one brand or flavor of each side, null where there is none
_GATES = sql_of("catalog", "inputs") + f""", i AS (SELECT uid, price, p_size AS w, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS g, predicted_bt AS bt, unnest([uid, uid + 1]) AS source_pos FROM inputs JOIN part ON uid = p_partkey),
  gi AS (SELECT uid, source_pos, price, bt, CASE WHEN uid % 4 = 3 THEN NULL ELSE w END AS w, CASE uid % 4 WHEN 1 THEN g || ' ' || f WHEN 3 THEN f || ' ' || g || ' pro' ELSE f || ' ' || g END AS base,
      CASE uid % 4 WHEN 0 THEN ' ' || w || 'g' WHEN 1 THEN ' ' || w || 'g' WHEN 2 THEN ' ' || 2 * w || 'g' ELSE '' END AS tail, CASE WHEN uid % 3 = 0 THEN 'small' ELSE 'large' END AS category,
      CASE uid % 5 WHEN 0 THEN 'widget' WHEN 1 THEN 'widgets' END AS brand, CASE WHEN uid % 7 > 0 THEN CASE WHEN uid % 4 = 1 THEN g ELSE f END END AS flavor FROM i),
  gc AS (SELECT source_pos, price + CASE WHEN source_pos % 4 = 0 THEN 100 ELSE 0 END AS c_price, basictype AS c_bt, p_name AS b, p_name || ' ' || p_size || 'g' AS c_text, p_size * CASE WHEN source_pos % 11 = 0 THEN 10 ELSE 1 END AS c_w, CASE WHEN source_pos % 13 = 0 THEN 'liquid' ELSE 'solid' END AS c_form,
      category || CASE WHEN source_pos % 6 = 0 THEN ' Ice Cream' ELSE '' END AS c_category, CASE source_pos % 3 WHEN 0 THEN 'widgett' WHEN 1 THEN 'gadget' END AS c_brand, CASE WHEN source_pos % 10 > 0 THEN flavor END AS c_flavor
    FROM catalog JOIN part ON source_pos = p_partkey),
  g AS (SELECT *, base || CASE WHEN uid % 9 = 5 THEN ' xq' ELSE '' END AS a, base || tail AS text, CAST(source_pos % 9 - 3 AS DOUBLE) AS raw FROM gi JOIN gc USING (source_pos)),
  {Q.token_sorted("g", "tr")}, {Q.typo("g", "ty")},
  ek AS (SELECT DISTINCT brand AS v, c_brand AS w, text, c_text FROM g UNION SELECT flavor, c_flavor, text, c_text FROM g),
  vw AS (SELECT v AS a, w AS b FROM ek WHERE v IS NOT NULL AND w IS NOT NULL), {Q.ratio("vw", "vr")},
  al AS (SELECT coalesce(v, w) AS a, CASE WHEN v IS NULL THEN text ELSE c_text END AS b FROM ek WHERE (v IS NULL) <> (w IS NULL)), {Q.partial("al", "pr")},
  ck AS (SELECT v, w, text, c_text, CASE WHEN v IS NULL AND w IS NULL THEN 'Neutral'
      WHEN v IS NULL OR w IS NULL THEN CASE WHEN contains(pr.b, pr.a) OR (length(pr.a) >= 5 AND pr.r >= 80) THEN 'Match' ELSE 'Conflict' END
      WHEN contains(v, w) OR contains(w, v) OR (least(length(v), length(w)) >= 5 AND vr.r >= 80) THEN 'Match' ELSE 'Conflict' END AS c
    FROM ek LEFT JOIN vr ON vr.a = v AND vr.b = w LEFT JOIN pr ON (v IS NULL) <> (w IS NULL) AND pr.a = coalesce(v, w) AND pr.b = CASE WHEN v IS NULL THEN text ELSE c_text END),
  k AS (SELECT g.*, tr.r AS tok, ty.r AS typ, x.c AS bc, y.c AS fc FROM g JOIN tr ON tr.a = g.a AND tr.b = g.b JOIN ty ON ty.a = g.a AND ty.b = g.b
    JOIN ck x ON x.v IS NOT DISTINCT FROM brand AND x.w IS NOT DISTINCT FROM c_brand AND x.text = g.text AND x.c_text = g.c_text
    JOIN ck y ON y.v IS NOT DISTINCT FROM flavor AND y.w IS NOT DISTINCT FROM c_flavor AND y.text = g.text AND y.c_text = g.c_text)"""


def _package(w: str) -> str:
    return f"CASE WHEN {w} BETWEEN 0 AND 78 THEN 'Stick/Bar' WHEN {w} BETWEEN 78 AND 110 THEN 'Cup' WHEN {w} BETWEEN 111 AND 160 THEN 'Cone' WHEN {w} BETWEEN 450 AND 10000 THEN 'Tub' END"


_STATUS = "CASE WHEN rejected THEN 'Rejected' WHEN s >= 4 THEN 'High Confidence' WHEN s > 0 THEN 'Medium Confidence' ELSE 'Low / Rejected' END AS status"
_SCORE = "CASE WHEN rejected THEN -10 WHEN s = -10 THEN 0 WHEN bypass OR s >= 90 THEN least(1, s / 100) ELSE round(1 / (1 + exp(-0.55 * s)), 4) END AS score"


@case("f06_f17_market_gates", _GATES + f""",
  m AS (SELECT *, tok >= 90 OR typ >= 90 AS bypass, w IS NOT NULL AS weights, w IS NOT NULL AND c_form <> 'solid' AS form, abs(w - c_w) / greatest(w, c_w) * 100 AS gap, {_package("w")} AS p, {_package("c_w")} AS c_p FROM k),
  n AS (SELECT *, coalesce(contains(c_category, 'Ice Cream') AND weights AND p <> c_p, false) AS package, NOT bypass AND bc = 'Conflict' AS brand_no, NOT bypass AND fc = 'Conflict' AS flavor_no, coalesce(gap < 1 AND (bypass OR tok >= 80), false) AS weighed FROM m),
  o AS (SELECT *, form OR package OR brand_no OR flavor_no AS rejected, CASE WHEN bypass THEN greatest(raw, 100) ELSE raw END + CASE WHEN weighed THEN 2 ELSE 0 END AS s1, abs(price - c_price) <= 75 AS close,
    contains(c_category, category) AS in_category, NOT bypass AND lower(bt) = lower(c_bt) AND bc <> 'Conflict' AND fc <> 'Conflict' AS aligned FROM n),
  q AS (SELECT *, s1 < 6 AND weighed AND price > 0 AND c_price > 0 AS priced FROM o),
  z AS (SELECT *, s1 + CASE WHEN priced AND close THEN 3 WHEN priced THEN -2 ELSE 0 END + CASE WHEN in_category THEN 1 ELSE 0 END + CASE WHEN aligned THEN 3.5::DOUBLE ELSE 0 END AS s FROM q)
  SELECT uid, source_pos, {_SCORE}, {_STATUS}, CASE WHEN form THEN 'Physical Form Conflict: solid vs ' || c_form WHEN package THEN 'Ice Cream Packaging Mismatch (' || p || ' vs ' || c_p || ')'
    WHEN brand_no THEN 'Brand Conflict: ' || coalesce(brand, '') || ' vs ' || coalesce(c_brand, '') WHEN flavor_no THEN 'Flavor Conflict: ' || coalesce(flavor, '') || ' vs ' || coalesce(c_flavor, '')
    ELSE concat_ws('; ', CASE WHEN bypass THEN 'Whole-SKU Fuzzy Match (' || CAST(round_even(CASE WHEN tok >= 90 THEN tok ELSE typ END, 0) AS BIGINT) || '%)' END, CASE WHEN gap < 1 THEN 'Weight Match (' || w || CASE WHEN weighed THEN ')' ELSE ') [Low Text Sim]' END END,
      CASE WHEN gap > 10 THEN 'Weight Mismatch (' || w || ' vs ' || c_w || ')' END, CASE WHEN priced AND close THEN 'Price Match' END, CASE WHEN priced AND NOT close THEN 'Price Mismatch' END,
      CASE WHEN in_category THEN 'Category Match Bonus' END, CASE WHEN aligned THEN 'Predicted BT Alignment Boost (+3.5: ' || bt || ')' END) END AS notes FROM z""")
def f06(s: Samples) -> DataFrame:
    return GT.market_gates(_gate_pairs(s)).select("uid", "source_pos", "score", "status", "notes")


@case("f15_f17_food_gates", _GATES + f""",
  m AS (SELECT *, tok >= 90 AS near, flavor IS NOT NULL AS hi, c_flavor IS NOT NULL AS hc, lower(bt) = lower(c_bt) AS same FROM k),
  n AS (SELECT *, hi AND hc AND flavor <> c_flavor AS rejected, CASE WHEN near THEN greatest(raw, 100) ELSE raw END AS s1, near AND NOT (hc AND NOT hi) AND same AS bypass FROM m),
  z AS (SELECT *, CASE WHEN hc AND NOT hi THEN least(s1, 3.5::DOUBLE) WHEN hi AND NOT hc THEN s1 - 2 ELSE s1 END + CASE WHEN same THEN 2 ELSE -3 END AS s FROM n)
  SELECT uid, source_pos, {_SCORE}, {_STATUS}, CASE WHEN coalesce(rejected, false) THEN 'Flavor Conflict: ' || flavor || ' vs ' || c_flavor ELSE concat_ws('; ', CASE WHEN near THEN 'Whole-SKU Fuzzy Match (' || CAST(round_even(tok, 0) AS BIGINT) || '%)' END,
    CASE WHEN hc AND NOT hi THEN 'Flavor Mismatch: catalog has ' || c_flavor || ', input unspecified' END, CASE WHEN hi AND NOT hc THEN 'Flavor Mismatch: input has ' || flavor || ', catalog unspecified' END,
    CASE WHEN same THEN 'BasicType Match (' || bt || ')' ELSE 'BasicType Mismatch: catalog has ''' || lower(c_bt) || ''' vs predicted ''' || bt || '''' END) END AS notes FROM z""")
def f15(s: Samples) -> DataFrame:
    return GT.food_gates(_gate_pairs(s)).select("uid", "source_pos", "score", "status", "notes")


@case("f16_probability", "SELECT event_id, CASE WHEN x = -10 THEN 0 WHEN x >= 90 THEN least(1, x / 100) ELSE round(1 / (1 + exp(-0.55 * x)), 4) END AS p FROM (SELECT event_id, CAST(floor(value) - 10 AS DOUBLE) AS x FROM events) AS e")
def f16(s: Samples) -> DataFrame:
    return s.base("events").select("event_id", GT.probability(F.floor("value").cast("double") - 10, F.lit(False)).alias("p"))


@case("f17_match_status", "SELECT event_id, CASE WHEN value >= 4 THEN 'High Confidence' WHEN value > 0 THEN 'Medium Confidence' ELSE 'Low / Rejected' END AS status FROM events")
def f17(s: Samples) -> DataFrame:
    return s.base("events").select("event_id", GT.status(F.col("value")).alias("status"))


def _pools(s: Samples) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = s.base("lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("cand"), F.round("l_quantity", 0).alias("score"), F.col("l_extendedprice").alias("rerank_score"), "l_returnflag")
    li = li.groupBy("uid", "cand").agg(F.max("score").alias("score"), F.max("rerank_score").alias("rerank_score"), F.max("l_returnflag").alias("flag"))
    rows = li.withColumns({"status": F.when(F.col("score") >= 45, "High Confidence").otherwise("Medium Confidence"), "notes": F.lit("n")})
    return s.base("orders").select(F.col("o_orderkey").alias("uid")), rows.filter("flag = 'R'"), rows


_POOL = """li AS (SELECT l_orderkey AS uid, l_linenumber AS cand, max(round(l_quantity, 0)) AS score, max(l_extendedprice) AS rerank, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY rerank DESC, cand) AS n FROM li), w AS (SELECT uid, max(struct_pack(score := score, rerank := rerank, c := -cand)) AS b FROM t WHERE n <= 5 GROUP BY uid),
  tr AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY rerank DESC, cand) AS n FROM li WHERE flag = 'R'), wr AS (SELECT uid, max(struct_pack(score := score, rerank := rerank, c := -cand)) AS b FROM tr WHERE n <= 5 GROUP BY uid)"""


@case("f18_winner_pick", f"WITH {_POOL} SELECT uid, -b.c AS cand, b.score AS score FROM w")
def f18(s: Samples) -> DataFrame:
    return M.pick_winner(_pools(s)[2]).select("uid", "cand", "score")


@case("f19_f20_pool_choice", f"WITH {_POOL} SELECT o_orderkey AS uid, CASE WHEN wr.b.score >= 45 OR w.b IS NULL OR wr.b.score >= w.b.score THEN coalesce(wr.b.score, 0) ELSE coalesce(w.b.score, 0) END AS score, CASE WHEN w.b IS NULL AND wr.b IS NULL THEN 'No candidates' WHEN wr.b.score >= 45 THEN 'BT-filtered: n' WHEN w.b IS NULL OR wr.b.score >= w.b.score THEN 'BT-filtered fallback: n' ELSE 'Unfiltered: n' END AS notes FROM orders LEFT JOIN w ON w.uid = o_orderkey LEFT JOIN wr ON wr.uid = o_orderkey")
def f19(s: Samples) -> DataFrame:
    i, f, o = _pools(s)
    return M.choose_pool(i, M.pick_winner(f), M.pick_winner(o)).select("uid", "score", "notes")


@case("f21_food_keywords", sql_of("catalog") + " SELECT source_pos, CASE WHEN source_pos % 2 = 0 THEN [flavor || ' dish', 'plain'] ELSE ['plain'] END AS gk FROM catalog")
def f21(s: Samples) -> DataFrame:
    have = F.when(F.col("source_pos") % 2 == 0, F.array("flavor")).otherwise(F.array().cast("array<string>"))
    return s.catalog.select("source_pos", M.filter_food_keywords(F.array(F.concat("flavor", F.lit(" dish")), F.lit("plain")), have, F.array("flavor", F.lit("seafood"))).alias("gk"))


@case("f22_market_keywords", sql_of("catalog") + " SELECT source_pos, ['plain'] AS gk FROM catalog")
def f22(s: Samples) -> DataFrame:
    return s.catalog.select("source_pos", M.filter_market_keywords(F.array(F.concat("flavor", F.lit("ish")), F.lit("plain")), F.array("flavor")).alias("gk"))


@case("f23_entity_swap", sql_of("catalog") + " SELECT source_pos, 'NEW' || substr(name, length(flavor) + 1) AS name FROM catalog")
def f23(s: Samples) -> DataFrame:
    return s.catalog.select("source_pos", M.swap_entities(F.col("name"), F.upper("flavor"), F.lit("NEW")).alias("name"))
