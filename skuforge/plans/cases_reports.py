"""Queries of catalog maintenance, reports and streams (K, L, M)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.functions import text as T
from skuforge.operators import catalog as K
from skuforge.operators import reports as L
from skuforge.operators import vectors as V
from skuforge.plans import matcher
from skuforge.plans.samples import Samples, sql_of
from skuforge.sources import shared, sinks
from skuforge.streaming import streams as M

CASES: dict = {}


def case(name: str, sql: str | None = None):
    def add(f):
        CASES[name] = (f, sql)
        return f

    return add


def _folder(s: Samples, name: str) -> str:
    return f"{shared.folder(s.spark)}/{name}-{uuid.uuid4().hex}"


# --- K: catalog maintenance


def _versions(s: Samples) -> tuple[DataFrame, DataFrame]:
    h = lambda df: df.withColumns({"uid": F.col("source_pos"), "row_hash": T.row_hash(["name", "brand", "basictype", "price"], "price")})
    return h(s.stored), h(s.revised)


_CHANGES = sql_of("stored", "revised") + """, d AS (SELECT coalesce(o.source_pos, n.source_pos) AS uid, o.source_pos IS NOT NULL AS a, n.source_pos IS NOT NULL AS b, o.price AS op, n.price AS np,
  CASE WHEN o.source_pos IS NULL THEN 'insert' WHEN n.source_pos IS NULL THEN 'delete' WHEN o.price <> n.price THEN 'update' ELSE 'same' END AS change FROM stored o FULL JOIN revised n ON o.source_pos = n.source_pos)"""


@case("k01_changes", _CHANGES + " SELECT uid, change FROM d")
def k01(s: Samples) -> DataFrame:
    return K.changes(*_versions(s))


@case("k02_apply_changes", sql_of("revised") + " SELECT source_pos AS uid, price FROM revised")
def k02(s: Samples) -> DataFrame:
    return K.apply_changes(*_versions(s)).select("uid", "price")


@case("k02_change_counts", _CHANGES + " SELECT count(*) FILTER (change = 'insert') AS n_insert, count(*) FILTER (change = 'update') AS n_update, count(*) FILTER (change = 'delete') AS n_delete, count(*) FILTER (change = 'same') AS n_same FROM d")
def k02b(s: Samples) -> DataFrame:
    return K.change_counts(K.changes(*_versions(s)))


@case("k03_brand_changes", sql_of("brands") + " SELECT source_pos AS uid, CASE WHEN source_pos % 10 = 0 THEN 'update' ELSE 'same' END AS change FROM brands")
def k03(s: Samples) -> DataFrame:
    h = lambda df: df.select(F.col("source_pos").alias("uid"), T.row_hash(["name", "aliases"], salt="brands").alias("row_hash"))
    new = s.brands.withColumn("aliases", F.when(F.col("source_pos") % 10 == 0, "other").otherwise(F.col("aliases")))
    return K.changes(h(s.brands), h(new))


@case("k04_field_preview", _CHANGES + """, n AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY uid) AS k, count(*) OVER (PARTITION BY change) > 5 AS capped FROM d WHERE change <> 'same')
  SELECT uid, change, 'price' AS "column", CASE WHEN change = 'insert' THEN NULL ELSE op END AS old_price, CASE WHEN change = 'delete' THEN NULL ELSE np END AS new_price, capped FROM n WHERE k <= 5""")
def k04(s: Samples) -> DataFrame:
    rows = K.field_preview(*_versions(s), ["price"], 5)
    return rows.select("uid", "change", "column", F.col("old_value").cast("double").alias("old_price"), F.col("new_value").cast("double").alias("new_price"), "capped")


@case("k05_dictionary_counts", sql_of("catalog") + ", t AS (SELECT domain, 'bt' AS tag_type, basictype AS tag FROM catalog UNION ALL SELECT domain, 'gk', unnest([flavor, split_part(generic_keywords, ', ', 2)]) FROM catalog UNION ALL SELECT domain, 'category', category FROM catalog) SELECT domain, tag_type, tag, count(*) AS catalog_count FROM t GROUP BY ALL UNION ALL SELECT DISTINCT domain, 'bt', 'UNUSED', 0 FROM catalog")
def k05(s: Samples) -> DataFrame:
    c = s.catalog
    d = c.select("domain", F.lit("bt").alias("tag_type"), F.col("basictype").alias("tag")).unionByName(c.select("domain", F.lit("gk").alias("tag_type"), F.explode(T.comma_list(F.col("generic_keywords"))).alias("tag")))
    d = d.unionByName(c.select("domain", F.lit("category").alias("tag_type"), F.col("category").alias("tag"))).unionByName(c.select("domain", F.lit("bt").alias("tag_type"), F.lit("UNUSED").alias("tag")))
    return K.dictionary_counts(c, d)


@case("k06_type_map_counts", sql_of("catalog") + " SELECT domain, basictype, 'a, b, a' AS generic_keywords, 2 AS gk_count, count(*) AS catalog_count FROM catalog GROUP BY ALL")
def k06(s: Samples) -> DataFrame:
    return K.type_map_counts(s.catalog.select("domain", "basictype", F.lit("a, b, a").alias("generic_keywords")).distinct(), s.catalog)


@case("k07_changed_rows", _CHANGES + " SELECT uid FROM d WHERE change IN ('insert', 'update')")
def k07(s: Samples) -> DataFrame:
    return K.changed_rows(*_versions(s)).select("uid")


@case("k08_write_modes", sql_of("catalog") + " SELECT domain, 2 * count(*) AS n FROM catalog WHERE domain = 'food' GROUP BY 1 UNION ALL SELECT domain, count(*) FROM catalog WHERE domain = 'market' GROUP BY 1")
def k08(s: Samples) -> DataFrame:
    path = _folder(s, "k08")
    K.write_domain(s.catalog, path, "rebuild")
    K.write_domain(s.catalog.filter("domain = 'food'"), path, "sync")
    K.write_domain(s.catalog.filter("domain = 'market'"), path, "rebuild")
    return s.spark.read.parquet(path).groupBy(F.col("domain").cast("string").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@case("k09_staged_type_map", sql_of("catalog") + " SELECT basictype, string_agg(DISTINCT flavor, ', ' ORDER BY flavor) AS generic_keywords FROM catalog GROUP BY 1")
def k09(s: Samples) -> DataFrame:
    return K.staged_type_map(s.catalog.select("basictype", F.concat(F.lit(" "), "flavor").alias("gk")))


@case("g34_needs_training", "SELECT count(*) AS n, true AS changed_rows, false AS changed_order FROM part")
def g34(s: Samples) -> DataFrame:
    f = lambda df: T.dataset_fingerprint(df, ["name", "brand"], "price")
    a = K.needs_training(f(s.revised), f(s.stored)).select(F.col("rows").alias("n"), F.col("changed").alias("changed_rows"))
    b = K.needs_training(f(s.stored.repartition(5, "price")), f(s.stored)).select(F.col("changed").alias("changed_order"))
    return a.join(F.broadcast(b))  # one row each


# --- L: reports

_CATALOG_TEXT = ["name", "brand", "basictype", "generic_keywords", "category", "description", "flavor"]


@case("l01_catalog_search", sql_of("catalog") + ", f AS (SELECT * FROM catalog WHERE price BETWEEN 900 AND 1500 AND lower(basictype) LIKE '%e%' AND lower(generic_keywords) LIKE '%bolt%' AND (lower(name) LIKE '%red%' OR lower(category) LIKE '%red%')) SELECT source_pos, price, (SELECT count(*) FROM f) AS total FROM f ORDER BY price DESC, source_pos LIMIT 20 OFFSET 0")
def l01(s: Samples) -> DataFrame:
    found = L.catalog_filter(s.catalog, 900, 1500, {"basictype": "E"}, ["bolt"], "red", _CATALOG_TEXT)
    return L.page(found, [F.desc("price"), F.asc("source_pos")], 1, 20).select("source_pos", "price", "total")


@case("l02_dictionary_search", sql_of("catalog") + ", d AS (SELECT domain, basictype AS tag, count(*) AS catalog_count FROM catalog GROUP BY ALL), f AS (SELECT * FROM d WHERE domain = 'food' AND lower(tag) LIKE '%m%') SELECT tag, catalog_count, (SELECT count(*) FROM f) AS total FROM f ORDER BY catalog_count DESC, tag LIMIT 2 OFFSET 2")
def l02(s: Samples) -> DataFrame:
    d = s.catalog.groupBy("domain", F.lit("bt").alias("tag_type"), F.col("basictype").alias("tag")).agg(F.count(F.lit(1)).alias("catalog_count"))
    return L.page(L.dictionary_filter(d, "food", "M", "bt"), [F.desc("catalog_count"), F.asc("tag")], 2, 2).select("tag", "catalog_count", "total")


@case("l03_dataset_counts", sql_of("catalog", "results") + " SELECT 'catalog' AS dataset, domain, count(*) AS n FROM catalog GROUP BY ALL UNION ALL SELECT 'results', domain, count(*) FROM results GROUP BY ALL")
def l03(s: Samples) -> DataFrame:
    return L.dataset_counts({"catalog": s.catalog, "results": s.results})


@case("l04_job_list", sql_of("jobs") + " SELECT job_id, status, (SELECT count(*) FROM jobs WHERE status = 'done') AS total FROM jobs WHERE status = 'done' ORDER BY job_id DESC LIMIT 25")
def l04(s: Samples) -> DataFrame:
    return L.page(s.jobs.filter("status = 'done'"), [F.desc("job_id")], 1, 25).select("job_id", "status", "total")


@case("l05_history", sql_of("results") + " SELECT id FROM results WHERE lower(bt) LIKE '%type 1%' AND gk_json LIKE '%kw2%' AND match_source = 'Matcher' AND confidence >= 0.7")
def l05(s: Samples) -> DataFrame:
    return L.history_filter(s.results.withColumn("gk", T.keyword_decode(F.col("gk_json"))), "TYPE 1", "kw2", "matcher", 0.7).select("id")


@case("l06_headline", sql_of("results") + " SELECT count(*) AS total, round(avg(confidence), 4) AS mean_confidence, count(*) FILTER (confidence >= 0.85) AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.85) AS medium, count(*) FILTER (confidence < 0.6) AS low, round(100.0 * count(*) FILTER (confidence >= 0.85) / count(*), 1) AS high_pct, round(100.0 * count(*) FILTER (confidence >= 0.6 AND confidence < 0.85) / count(*), 1) AS medium_pct, round(100.0 * count(*) FILTER (confidence < 0.6) / count(*), 1) AS low_pct FROM results")
def l06(s: Samples) -> DataFrame:
    return L.headline(s.results)


@case("l07_source_breakdown", sql_of("results") + " SELECT match_source AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM results), 1) AS pct FROM results GROUP BY 1")
def l07(s: Samples) -> DataFrame:
    return L.breakdown(s.results, "match_source")


@case("l08_domain_breakdown", sql_of("results") + " SELECT domain AS value, count(*) AS n FROM results GROUP BY 1")
def l08(s: Samples) -> DataFrame:
    return L.breakdown(s.results, "domain").select("value", "n")


@case("l09_volume_trend", "WITH b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-02-05 00:00:00', INTERVAL 1 HOUR)) AS bucket), n AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1) SELECT bucket, strftime(bucket + INTERVAL 330 MINUTE, '%H:00') AS label, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (bucket)")
def l09(s: Samples) -> DataFrame:
    return L.volume_trend(s.base("events"), "hour", "ts", "2024-01-10 00:00:00", "2024-02-05 00:00:00", "Asia/Colombo")


@case("l10_window_counters", "SELECT count(*) AS n_all, count(*) FILTER (ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20') AS n_1d, count(*) FILTER (ts > TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20') AS n_7d, count(*) FILTER (ts > TIMESTAMP '2023-12-21' AND ts <= TIMESTAMP '2024-01-20') AS n_30d FROM events")
def l10(s: Samples) -> DataFrame:
    return L.window_counters(s.base("events"), "ts", "2024-01-20 00:00:00")


@case("l11_top_types", sql_of("results") + " SELECT bt AS value, count(*) AS n FROM results WHERE bt IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def l11(s: Samples) -> DataFrame:
    return L.top_values(s.results, F.col("bt"))


@case("l12_top_third_tags", sql_of("results") + " SELECT coalesce(nullif(trim(region), ''), bt) AS value, count(*) AS n FROM results GROUP BY 1 HAVING count(*) >= 5 AND value IS NOT NULL ORDER BY n DESC, value LIMIT 10")
def l12(s: Samples) -> DataFrame:
    return L.top_values(s.results, T.first_non_blank(F.col("region"), F.col("bt")), 10, 5)


@case("l13_status_counts", sql_of("results") + ", u AS (SELECT 'bt' AS kind, bt_confidence AS c FROM results UNION ALL SELECT 'gk', gk_confidence FROM results UNION ALL SELECT 'region', region_confidence FROM results) SELECT kind, count(*) FILTER (c >= 0.8) AS auto, count(*) FILTER (c >= 0.5 AND c < 0.8) AS review, count(*) FILTER (c < 0.5) AS low FROM u GROUP BY 1")
def l13(s: Samples) -> DataFrame:
    return L.status_counts(s.results, {"bt": "bt_confidence", "gk": "gk_confidence", "region": "region_confidence"})


@case("l14_job_summaries", sql_of("results", "jobs") + ", n AS (SELECT job_id, count(*) AS t, count(*) FILTER (confidence >= 0.8) AS h FROM results GROUP BY 1) SELECT job_id, coalesce(total_count, t, 0) AS total, coalesce(high_count, h, 0) AS high FROM jobs LEFT JOIN n USING (job_id)")
def l14(s: Samples) -> DataFrame:
    return L.job_summaries(s.jobs, s.results)


@case("l15_job_details", sql_of("results", "jobs") + " SELECT id, round(CASE WHEN match_source = 'Matcher' THEN match_score ELSE bt_confidence END, 4) AS shown_confidence FROM results WHERE job_id IN (SELECT job_id FROM jobs WHERE status = 'done')")
def l15(s: Samples) -> DataFrame:
    return L.job_details(s.results, s.jobs.filter("status = 'done'")).select("id", "shown_confidence")


@case("l16_table_query", sql_of("jobs") + " SELECT job_id, upper(status) AS state FROM jobs WHERE s_acctbal > 0")
def l16(s: Samples) -> DataFrame:
    s.jobs.createOrReplaceTempView("skuforge_jobs")
    return L.query_table(s.spark, "skuforge_jobs", ["job_id", "upper(status) AS state"], "s_acctbal > 0", ["-job_id"])


@case("l17_free_select", sql_of("results") + " SELECT job_id, count(*) AS n, max(confidence) AS best FROM results GROUP BY job_id")
def l17(s: Samples) -> DataFrame:
    s.results.createOrReplaceTempView("skuforge_results")
    return L.run_select(s.spark, "SELECT job_id, count(*) AS n, max(confidence) AS best FROM skuforge_results GROUP BY job_id")


@case("l18_table_list", "SELECT 'part' AS table_name, count(*) AS n_rows, 6 AS n_columns FROM part UNION ALL SELECT 'nation', count(*), 3 FROM nation")
def l18(s: Samples) -> DataFrame:
    return L.table_list({t: s.base(t) for t in ("part", "nation")}).select("table_name", "n_rows", "n_columns")


@case("l19_request_filter", sql_of("requests") + " SELECT id FROM requests WHERE status_code >= 400 AND duration_ms >= 20 AND method = 'POST' AND path LIKE '%err%'")
def l19(s: Samples) -> DataFrame:
    return L.request_filter(s.requests, "post", "ERR", 400, 20).select("id")


@case("l20_log_lines", "SELECT event_id || ' [' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'debug' ELSE 'x' END || '] user 7' AS value, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS severity FROM events WHERE event_type IN ('error', 'click', 'view')".replace(" WHERE event_type IN ('error', 'click', 'view')", ""))
def l20(s: Samples) -> DataFrame:
    path = _folder(s, "l20")
    kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "debug").otherwise("x")
    s.base("events").select(F.concat("event_id", F.lit(" ["), kind, F.lit("] user 7"))).write.text(path)
    return L.log_lines(s.spark.read.text(path), "USER 7")


@case("l21_low_confidence", sql_of("results", "jobs") + " SELECT DISTINCT sku_name FROM results WHERE job_id IN (SELECT job_id FROM jobs WHERE status = 'done') AND (confidence < 0.75 OR bt IS NULL OR match_source <> 'Matcher')")
def l21(s: Samples) -> DataFrame:
    return L.low_confidence_names(s.results, s.jobs.filter("status = 'done'"))


@case("l22_few_shots", sql_of("catalog") + ", o AS (SELECT *, row_number() OVER (PARTITION BY category, basictype ORDER BY source_pos) AS n FROM catalog), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('7|' || category || '|' || basictype), basictype) AS k FROM o WHERE n = 1) SELECT category, basictype, name, [flavor, split_part(generic_keywords, ', ', 2)] AS keywords FROM k WHERE k <= 3")
def l22(s: Samples) -> DataFrame:
    return L.few_shots(s.catalog, 3)


@case("l23_keyword_groups", sql_of("catalog") + ", k AS (SELECT DISTINCT basictype, upper(substr(flavor, 1, 1)) || substr(flavor, 2) AS k FROM catalog) SELECT basictype, list(k ORDER BY k) AS keywords, CAST(count(*) AS INTEGER) AS n, (SELECT count(DISTINCT k) FROM k) AS n_unique FROM k GROUP BY 1")
def l23(s: Samples) -> DataFrame:
    return L.merge_keyword_groups(s.catalog.select("basictype", F.array(F.concat("flavor", F.lit("!")), F.upper("flavor")).alias("keywords")))


# --- A5, A8 and M: folders and streams


@case("a05_tabs", sql_of("catalog") + " SELECT 'Market_Category' AS tab, count(*) AS n FROM catalog UNION ALL SELECT 'Brands', count(DISTINCT brand) FROM catalog")
def a05(s: Samples) -> DataFrame:
    path = _folder(s, "a05")
    lines = s.catalog.select("name", F.lit("Market_Cat").alias("t")).unionByName(s.catalog.select("brand", F.lit("Brands").alias("t")).distinct().withColumnRenamed("brand", "name"))
    lines.repartition(2, "t").write.partitionBy("t").text(path)
    # a folder of tabs, here one folder a tab: the tab's name comes from the path
    tab = F.regexp_extract(F.input_file_name(), r"t=([^/]+)/", 1)
    rows = s.spark.read.option("recursiveFileLookup", "true").text(path).select(F.when(tab == "Market_Cat", "Market_Category").otherwise(tab).alias("tab"))
    return rows.groupBy("tab").agg(F.count(F.lit(1)).alias("n"))


@case("a08_columnar_cache", sql_of("catalog") + " SELECT source_pos, price FROM catalog")
def a08(s: Samples) -> DataFrame:
    path = _folder(s, "a08")
    sinks.write_cache(s.catalog, path)
    return s.spark.read.parquet(path).select("source_pos", "price")


@case("m01_tag_stream", sql_of("inputs") + " SELECT uid, price FROM inputs")
def m01(s: Samples) -> DataFrame:
    source, out = _folder(s, "m01"), _folder(s, "m01")
    s.inputs.write.parquet(source)
    stream = s.spark.readStream.schema(s.inputs.schema).parquet(source)
    catalog, tools = s.catalog.drop("brand", "flavor"), matcher.Tools(V.hashed_words(), V.token_logit)
    M.tag_stream(stream, lambda df: matcher.match(s.spark, df, catalog, tools).join(df.select("uid", "price"), "uid"), out, _folder(s, "m01")).awaitTermination()
    return s.spark.read.parquet(out).select("uid", "price")


@case("m02_live_volume", "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def m02(s: Samples) -> DataFrame:
    out = _folder(s, "m02")
    e = s.base("events")
    source = _folder(s, "m02")
    e.write.parquet(source)
    live = M.live_volume(s.spark.readStream.schema(e.schema).parquet(source), value="value")
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(s, "m02")).trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.parquet(out).select("start", "n", F.round("mean", 6).alias("mean"))


@case("m03_upsert_stream", "SELECT user_id AS uid, arg_max(value, ts) AS value FROM events GROUP BY 1")
def m03(s: Samples) -> DataFrame:
    e = s.base("events").select(F.col("user_id").alias("uid"), "value", "ts", F.md5(F.col("event_id").cast("string").cast("binary")).alias("row_hash"))
    source, out = _folder(s, "m03"), _folder(s, "m03")
    e.union(e).write.parquet(source)
    M.upsert_stream(s.spark, s.spark.readStream.schema(e.schema).parquet(source), out, _folder(s, "m03"), late="60 days").awaitTermination()
    return M.current(s.spark, out).select("uid", "value")
