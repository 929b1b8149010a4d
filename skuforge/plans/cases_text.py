"""Queries of sources, sinks, cleaning functions and similarities (A, B, C)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.functions import similarity as S
from skuforge.functions import text as T
from skuforge.plans import ratio_sql as Q
from skuforge.plans.samples import Samples, sql_of
from skuforge.sources import readers, shared, sinks

CASES: dict = {}


def case(name: str, sql: str | None = None):
    def add(f):
        CASES[name] = (f, sql)
        return f

    return add


def _folder(s: Samples, name: str) -> str:
    return f"{shared.folder(s.spark)}/{name}-{uuid.uuid4().hex}"


# --- A: sources and sinks; each writes what it then reads, in the shared folder


@case("a01_catalog_csv", sql_of("catalog") + " SELECT name, price, domain, basictype, CAST(NULL AS VARCHAR) AS description FROM (SELECT *, name AS n FROM catalog) AS c".replace("domain,", "'market' AS domain,"))
def a01(s: Samples) -> DataFrame:
    path = _folder(s, "a01")
    c = s.catalog
    c.select(F.col("name").alias("NAME"), F.col("basictype").alias("Basic Type"), F.concat(F.lit("$"), F.format_number("price", 2)).alias("Price"), F.lit("x").alias("Unnamed: 3")).write.option("header", True).csv(path)
    return readers.read_catalog_csv(s.spark, path, "market").select("name", "price", "domain", "basictype", "description")


@case("a02_product_list", sql_of("inputs") + " SELECT trim(name) AS name, price, '' AS description, '' AS category FROM inputs")
def a02(s: Samples) -> DataFrame:
    path = _folder(s, "a02")
    s.inputs.select(F.col("name").alias("Title"), F.concat(F.lit("Rs "), F.col("price").cast("string")).alias("MRP")).write.option("header", True).csv(path)
    return readers.read_product_list(s.spark, path)


@case("a03_separator_sniff", sql_of("inputs") + " SELECT name || chr(10) || 'second line' AS name, price, description, '' AS category FROM inputs")
def a03(s: Samples) -> DataFrame:
    path = _folder(s, "a03")
    s.inputs.select(F.concat("name", F.lit("\nsecond line")).alias("sku"), F.col("price").alias("cost"), F.col("description").alias("desc")).write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_product_list(s.spark, path)


@case("a04_dictionary_file", "SELECT DISTINCT trim(p_name) AS tag FROM part")
def a04(s: Samples) -> DataFrame:
    path = _folder(s, "a04")
    s.base("part").select(F.concat(F.lit(" "), "p_name", F.lit(" "))).distinct().write.text(path)
    return readers.read_dictionary(s.spark, path)


@case("a06_manifest")
def a06(s: Samples) -> DataFrame:
    path = _folder(s, "a06")
    sinks.write_csv(s.catalog.select("name", "domain"), path)
    return readers.read_manifest(s.spark, path).filter(F.col("source").endswith(".csv")).select(F.length("md5").alias("md5_length"), "size")


@case("a07_domain_scan", sql_of("catalog") + " SELECT source_pos, name, domain FROM catalog WHERE domain = 'food'")
def a07(s: Samples) -> DataFrame:
    path = _folder(s, "a07")
    sinks.write_cache(s.catalog, path)
    return readers.read_domain(s.spark, path, "food").select("source_pos", "name", F.col("domain").cast("string").alias("domain"))


@case("a09_audit_append", sql_of("results") + " SELECT id, domain, confidence FROM results UNION ALL SELECT id, domain, confidence FROM results")
def a09(s: Samples) -> DataFrame:
    path = _folder(s, "a09")
    for _ in range(2):
        rows = s.results.withColumn("created_at", F.date_trunc("year", "created_at"))
        sinks.append_results(rows, path)
    return s.spark.read.parquet(path).select("id", F.col("domain").cast("string").alias("domain"), "confidence")


@case("a10_history_export", sql_of("results") + " SELECT id, CASE WHEN sku_name LIKE '=%' THEN chr(9) || sku_name ELSE sku_name END AS sku_name FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '=' || sku_name ELSE sku_name END AS sku_name FROM results) AS r ORDER BY id DESC, sku_name LIMIT 50000")
def a10(s: Samples) -> DataFrame:
    rows = s.results.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("="), "sku_name")).otherwise(F.col("sku_name")).alias("sku_name"))
    return sinks.export_history(rows)


@case("a11_clean_export", sql_of("results") + " SELECT sku_name, bt, gk_json AS gk, region FROM results WHERE domain = 'food'")
def a11(s: Samples) -> DataFrame:
    return sinks.clean_export(s.results.withColumn("gk", F.col("gk_json")), "food")


@case("a12_audit_export", sql_of("results") + " SELECT sku_name, domain, bt, gk_json AS gk, region, confidence, match_source, match_score, bt_confidence, gk_confidence, region_confidence FROM results")
def a12(s: Samples) -> DataFrame:
    return sinks.audit_export(s.results.withColumn("gk", F.from_json("gk_json", "array<string>")))


@case("a13_multi_job_export", sql_of("results", "jobs") + " SELECT id, job_id, 'job_' || job_id || '_' || substr(replace(job_name, '/', '_'), 1, 20) AS sheet FROM results JOIN jobs USING (job_id)")
def a13(s: Samples) -> DataFrame:
    return sinks.multi_job_export(s.results.select("id", "job_id"), s.jobs).select("id", "job_id", "sheet")


@case("a14_catalog_documents", sql_of("catalog") + """ SELECT source_pos AS uid, '{"brand":["' || brand || '"],"flavor":["' || flavor || '"],"generic_keywords":["' || flavor || '","' || split_part(generic_keywords, ', ', 2) || '"],"name":"' || name || '","uid":' || source_pos || '}' AS doc FROM catalog""")
def a14(s: Samples) -> DataFrame:
    return sinks.catalog_documents(s.catalog.select(F.col("source_pos").alias("uid"), "name", "brand", "flavor", "generic_keywords"))


@case(
    "a15_dictionary_documents",
    sql_of("catalog", "brands")
    + """ SELECT 'bt' AS kind, domain, basictype AS name, CAST([] AS VARCHAR[]) AS related, count(*) AS catalog_count FROM catalog GROUP BY ALL
    UNION ALL SELECT 'brand', domain, name, CASE WHEN name = '' THEN [] ELSE list_distinct_sorted END, catalog_count FROM (SELECT *, [name || 's', split_part(aliases, ', ', 2)] AS list_distinct_sorted FROM brands) b
    UNION ALL SELECT 'bt_gk_map', domain, basictype, [min(flavor)], count(*) FROM catalog GROUP BY domain, basictype""",
)
def a15(s: Samples) -> DataFrame:
    c = s.catalog
    tags = c.groupBy("domain", F.lit("bt").alias("tag_type"), F.col("basictype").alias("tag")).agg(F.count(F.lit(1)).alias("catalog_count"))
    bt = c.groupBy("domain", "basictype").agg(F.min("flavor").alias("generic_keywords"), F.count(F.lit(1)).alias("catalog_count"))
    return sinks.dictionary_documents(tags, s.brands, bt)


# --- B: cleaning


@case("b01_drop_invalid_names", "SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN 'none' ELSE p_name END AS name FROM part) AS x WHERE lower(trim(name)) NOT IN ('', 'nan', 'none')")
def b01(s: Samples) -> DataFrame:
    k = F.col("p_partkey") % 5
    return T.drop_invalid_names(s.base("part").select("p_partkey", F.when(k == 0, " ").when(k == 1, "NaN").when(k == 2, "none").otherwise(F.col("p_name")).alias("name")), "name")


@case("b02_catalog_price", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders")
def b02(s: Samples) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2)))
    return s.base("orders").select("o_orderkey", T.catalog_price(raw).alias("price"))


@case("b03_input_price", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice END AS price FROM orders")
def b03(s: Samples) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 10 == 0, "ask us").otherwise(F.concat(F.lit("Rs "), F.format_number("o_totalprice", 2), F.lit("/=")))
    return s.base("orders").select("o_orderkey", T.input_price(raw).alias("price"))


@case(
    "b04_standardize_units",
    """SELECT p_partkey, p_name || CASE p_partkey % 8 WHEN 0 THEN ' ' || p_size || 'g' WHEN 1 THEN ' ' || (3 * p_size) || 'g  tray' WHEN 2 THEN ' ' || (4 * p_size) || 'g' WHEN 3 THEN ' ' || (1000 * p_size + 500) || 'ml'
    WHEN 4 THEN ' ' || p_size || 'pc' WHEN 5 THEN ' ' || p_size || 'pc' WHEN 6 THEN '  only' ELSE ' 0g' END AS clean FROM part""",
)
def b04(s: Samples) -> DataFrame:
    k, n = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    tail = (
        F.when(k == 0, F.concat(n, F.lit("G"))).when(k == 1, F.concat(F.lit("3 x "), n, F.lit("g tray"))).when(k == 2, F.concat(n, F.lit("g x 4"))).when(k == 3, F.concat(n, F.lit(".5 Liters")))
        .when(k == 4, F.concat(F.lit("pack of "), n)).when(k == 5, F.concat(n, F.lit(" pieces"))).when(k == 6, F.lit("100g - 200g only")).otherwise(F.lit("750mg"))
    )
    return s.base("part").select("p_partkey", T.standardize_units(F.concat("p_name", F.lit(" "), tail)).alias("clean"))


@case("b05_unit_value", """SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE) * CASE l_linenumber % 4 WHEN 0 THEN 1000e0 WHEN 1 THEN 0.001e0 WHEN 2 THEN 10e0 END, 6) AS value,
    CASE l_linenumber % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'g' WHEN 2 THEN 'ml' END AS unit, CASE l_linenumber % 4 WHEN 0 THEN 'solid' WHEN 1 THEN 'solid' WHEN 2 THEN 'liquid' END AS form FROM lineitem""")
def b05(s: Samples) -> DataFrame:
    k = F.col("l_linenumber") % 4
    u = T.normalize_unit(F.col("l_quantity"), F.when(k == 0, "KGs").when(k == 1, "milligrams").when(k == 2, "cl").otherwise("boxes"))
    return s.base("lineitem").select("l_orderkey", "l_linenumber", u.alias("u")).select("l_orderkey", "l_linenumber", F.round("u.value", 6).alias("value"), "u.unit", "u.form")


@case("b06_first_weight", """SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1500 END AS DOUBLE) AS value,
    CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'g' END AS unit FROM part""")
def b06(s: Samples) -> DataFrame:
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat("p_name", F.lit(" "), "p_size", F.lit("g"))).when(k == 1, F.concat("p_name", F.lit(" "), "p_size", F.lit(" Litre can"))).when(k == 2, F.concat(F.col("p_name"), F.lit(" "), (F.col("p_size") * 1.5).cast("string"), F.lit("kg 2 pc"))).otherwise(F.col("p_name"))
    return s.base("part").select("p_partkey", T.extract_weight(t).alias("w")).select("p_partkey", F.round("w.value", 6).alias("value"), "w.unit")


@case("b07_final_text", "SELECT c_custkey, lower(replace(c_name, '#', ' ')) || ' x' AS clean FROM customer")
def b07(s: Samples) -> DataFrame:
    return s.base("customer").select("c_custkey", T.normalize_final(F.concat("c_name", F.lit(" 12345 - SKU 77 |  X!"))).alias("clean"))


@case("b08_strip_weights", "SELECT p_partkey, p_name || ' box' AS plain FROM part")
def b08(s: Samples) -> DataFrame:
    return s.base("part").select("p_partkey", T.strip_weights(F.concat("p_name", F.lit(" "), "p_size", F.lit("g 1.5kg Box "), "p_size")).alias("plain"))


@case("b09_token_count", "SELECT doc_id, CAST(len(list_filter(string_split_regex(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda w: w <> '')) AS BIGINT) AS n FROM documents")
def b09(s: Samples) -> DataFrame:
    return s.base("documents").select("doc_id", T.token_count(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


@case("b10_token_sorted", "SELECT p_partkey, least(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) || ' ' || greatest(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS token_key FROM part")
def b10(s: Samples) -> DataFrame:
    return s.base("part").select("p_partkey", T.token_sorted(F.col("p_name")).alias("token_key"))


@case("b11_entity_input", "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || p_brand END || ' ' || p_type AS line, 'Product: ' || p_name || ' Box' AS prompt FROM part")
def b11(s: Samples) -> DataFrame:
    d = F.when(F.col("p_partkey") % 2 == 0, "NaN").otherwise(F.col("p_brand"))
    return s.base("part").select("p_partkey", T.entity_input(F.col("p_name"), d, F.col("p_type")).alias("line"), T.entity_prompt(F.concat("p_name", F.lit(" "), "p_size", F.lit("g Box 12"))).alias("prompt"))


@case("b12_package_type", "SELECT l_orderkey, l_linenumber, CASE WHEN w <= 78 THEN 'Stick/Bar' WHEN w <= 110 THEN 'Cup' WHEN w BETWEEN 111 AND 160 THEN 'Cone' WHEN w BETWEEN 450 AND 10000 THEN 'Tub' END AS package FROM (SELECT *, l_quantity * 12 AS w FROM lineitem) AS x")
def b12(s: Samples) -> DataFrame:
    return s.base("lineitem").select("l_orderkey", "l_linenumber", T.package_type((F.col("l_quantity") * 12).cast("string")).alias("package"))


@case("b13_aggressive_clean", "SELECT p_partkey, p_name || ' Fresh' AS clean FROM part")
def b13(s: Samples) -> DataFrame:
    return s.base("part").select("p_partkey", T.aggressive_clean(F.concat("p_name", F.lit(" 6 x "), "p_size", F.lit("ml 2 pcs සිංහල Fresh! 99"))).alias("clean"))


@case("b14_keyword_sanitizer", "SELECT s_suppkey, 'Supplier' || substr(s_name, 10) || ' ' || s_suppkey || 'Pc Deal' AS k FROM supplier")
def b14(s: Samples) -> DataFrame:
    return s.base("supplier").select("s_suppkey", T.sanitize_keyword(F.concat("s_name", F.lit("   "), "s_suppkey", F.lit("pc  deal!"))).alias("k"))


@case("b15_title_case", """SELECT p_partkey, upper(substr(a, 1, 1)) || substr(a, 2) || ' with ' || upper(substr(b, 1, 1)) || substr(b, 2) || '-' || upper(substr(a, 1, 1)) || substr(a, 2) AS title
    FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) AS x""")
def b15(s: Samples) -> DataFrame:
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    return s.base("part").select("p_partkey", T.title_case(F.concat(a, F.lit(" WITH "), b, F.lit("-"), a)).alias("title"))


@case("b16_comma_list", sql_of("catalog") + " SELECT source_pos, [split_part(generic_keywords, ', ', 1), split_part(generic_keywords, ', ', 2)] AS parts FROM catalog")
def b16(s: Samples) -> DataFrame:
    return s.catalog.select("source_pos", T.comma_list(F.concat("generic_keywords", F.lit(", ,"))).alias("parts"))


@case("b17_row_hash", "SELECT p_partkey, md5(p_brand || chr(1) || p_name || chr(1) || printf('%.2f', p_retailprice) || chr(1) || 'market') AS row_hash FROM part")
def b17(s: Samples) -> DataFrame:
    return s.base("part").select("p_partkey", T.row_hash(["p_name", "p_brand", "p_retailprice"], "p_retailprice", "market").alias("row_hash"))


@case("b18_dataset_fingerprint", "SELECT count(*) AS n, true AS order_free FROM part")
def b18(s: Samples) -> DataFrame:
    p = s.base("part")
    a = T.dataset_fingerprint(p, ["p_name", "p_brand"], "p_retailprice")
    b = T.dataset_fingerprint(p.repartition(7, "p_size"), ["p_name", "p_brand"], "p_retailprice").select(F.col("fingerprint").alias("_f"))
    return a.join(F.broadcast(b)).select(F.col("rows").alias("n"), (F.col("fingerprint") == F.col("_f")).alias("order_free"))  # one row each


@case("b19_occurrence_ids", "SELECT p_partkey, lower(trim(p_name)) || '#occ_' || (row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) - 1) AS uid FROM part")
def b19(s: Samples) -> DataFrame:
    return T.occurrence_ids(s.base("part"), "p_name", "p_partkey").select("p_partkey", "uid")


@case("b20_first_non_blank", sql_of("results") + " SELECT id, coalesce(nullif(trim(region), ''), nullif(trim(bt), ''), '-') AS shown FROM results")
def b20(s: Samples) -> DataFrame:
    return s.results.select("id", F.coalesce(T.first_non_blank(F.col("region"), F.col("bt")), F.lit("-")).alias("shown"))


@case("b21_keyword_decode", sql_of("results") + " SELECT id, CASE WHEN id % 2 = 0 THEN CAST(CAST(gk_json AS JSON) AS VARCHAR[]) ELSE ['a', 'b c'] END AS gk FROM results")
def b21(s: Samples) -> DataFrame:
    return s.results.select("id", T.keyword_decode(F.when(F.col("id") % 2 == 0, F.col("gk_json")).otherwise("a, b c, a")).alias("gk"))


@case("b22_redact", """SELECT event_id, '{"user":{"password":"***REDACTED***","id":' || user_id || '},"api_token":"***REDACTED***","type":"' || event_type || '"}' AS body FROM events""")
def b22(s: Samples) -> DataFrame:
    body = F.concat(F.lit('{"user":{"password":"x\\"y","id":'), "user_id", F.lit('},"api_token":'), "event_id", F.lit(',"type":"'), "event_type", F.lit('"}'))
    return s.base("events").select("event_id", T.redact_json(body).alias("body"))


@case("b23_degenerate_name", "SELECT p_partkey, p_partkey % 3 = 0 AS degenerate FROM part")
def b23(s: Samples) -> DataFrame:
    return s.base("part").select("p_partkey", T.is_degenerate_name(F.when(F.col("p_partkey") % 3 == 0, " Chicken ").otherwise(F.col("p_name"))).alias("degenerate"))


@case("b24_enriched_query", "SELECT p_partkey, p_name || ' | ' || p_type AS query FROM part")
def b24(s: Samples) -> DataFrame:
    return s.base("part").select("p_partkey", T.enriched_query(F.col("p_name"), F.lit("none"), F.col("p_type")).alias("query"))


@case("b25_conflicting_dish", "SELECT p_partkey, split_part(p_name, ' ', 2) = 'bolt' AS conflict FROM part")
def b25(s: Samples) -> DataFrame:
    return s.base("part").select("p_partkey", T.conflicting_dish(F.col("p_name"), F.lit("Red Ring"), ["bolt", "ring"]).alias("conflict"))


@case("b26_unit_score", "SELECT o_orderkey, round(CASE WHEN o_totalprice / 300000 > 1 THEN o_totalprice / 300000 / 100 ELSE o_totalprice / 300000 END, 9) AS score FROM orders")
def b26(s: Samples) -> DataFrame:
    return s.base("orders").select("o_orderkey", F.round(T.unit_score(F.col("o_totalprice") / 300000), 9).alias("score"))


@case("b27_display_confidence", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice / 7000000, 4) END AS shown FROM orders")
def b27(s: Samples) -> DataFrame:
    return s.base("orders").select("o_orderkey", T.display_confidence(F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise((F.col("o_totalprice") / 7000000).cast("string"))).alias("shown"))


# --- C: similarities of each input with the catalog row of its key and the row after it

_PAIRS = sql_of("catalog", "inputs") + """, keys AS (SELECT uid, lower(name) AS a, unnest([uid, uid + 1]) AS source_pos FROM inputs),
  pairs AS (SELECT uid, source_pos, a, lower(name) AS b FROM keys JOIN catalog USING (source_pos)), """
_RATIO = " SELECT uid, source_pos, round(r, 6) AS ratio FROM {0} JOIN q USING (a, b)"


def _pairs(s: Samples) -> DataFrame:
    keys = s.inputs.select("uid", F.lower("name").alias("a"), F.explode(F.array("uid", F.col("uid") + 1)).alias("source_pos"))
    return keys.join(s.catalog.select("source_pos", F.lower("name").alias("b")), "source_pos")


@case("c01_ratio", _PAIRS + Q.ratio("pairs", "q") + _RATIO.format("pairs"))
def c01(s: Samples) -> DataFrame:
    return _pairs(s).select("uid", "source_pos", F.round(S.ratio("a", "b"), 6).alias("ratio"))


@case("c02_partial_ratio", _PAIRS + "firsts AS (SELECT uid, source_pos, split_part(a, ' ', 1) AS a, b FROM pairs), " + Q.partial("firsts", "q") + _RATIO.format("firsts"))
def c02(s: Samples) -> DataFrame:
    return _pairs(s).select("uid", "source_pos", F.round(S.partial_ratio(F.split_part("a", F.lit(" "), F.lit(1)), "b"), 6).alias("ratio"))


@case("c03_token_sort_ratio", _PAIRS + Q.token_sorted("pairs", "q") + _RATIO.format("pairs"))
def c03(s: Samples) -> DataFrame:
    return _pairs(s).select("uid", "source_pos", F.round(S.token_sort_ratio("a", "b"), 6).alias("ratio"))


@case("c05_typo_ratio", _PAIRS + Q.typo("pairs", "q") + _RATIO.format("pairs"))
def c05(s: Samples) -> DataFrame:
    return _pairs(s).select("uid", "source_pos", F.round(S.typo_ratio("a", "b"), 6).alias("ratio"))


@case("c06_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS cosine FROM embeddings")
def c06(s: Samples) -> DataFrame:
    return s.base("embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"))


@case("c08_softmax", "SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM (SELECT vec_id, i, exp((x - max(x) OVER (PARTITION BY vec_id)) / 0.05) AS e FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) AS u) AS v")
def c08(s: Samples) -> DataFrame:
    p = S.softmax(F.transform("embedding", lambda x: x.cast("double")), 0.05)
    return s.base("embeddings").select("vec_id", F.posexplode(p).alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", 6).alias("p"))


@case("c09_sigmoid", "SELECT event_id, round(1 / (1 + exp(-0.55 * (value / 10 - 5))), 6) AS p FROM events")
def c09(s: Samples) -> DataFrame:
    return s.base("events").select("event_id", F.round(S.sigmoid(F.col("value") / 10 - 5, 0.55), 6).alias("p"))
