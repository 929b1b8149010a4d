"""Tables of the product domain, derived from the given star schema by SQL that Spark and the oracle share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> (base tables, SELECT). All rows of the base tables take part.
VIEWS = {
    "catalog": """SELECT p_partkey AS source_pos, CASE WHEN p_partkey % 2 = 0 THEN 'market' ELSE 'food' END AS domain,
        concat(p_name, ' ', p_size, 'g') AS name, p_brand AS brand, p_type AS basictype,
        concat(split_part(p_name, ' ', 1), ', ', split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1)) AS generic_keywords,
        p_retailprice AS price, CASE WHEN p_size <= 15 THEN 'small goods' WHEN p_size <= 30 THEN 'mid goods' ELSE 'large goods' END AS category,
        concat('sku ', p_partkey) AS description, split_part(p_name, ' ', 1) AS flavor FROM {part}""",
    "inputs": """SELECT p_partkey AS uid, CASE p_partkey % 4 WHEN 0 THEN concat(upper(p_name), ' ', p_size, 'G')
          WHEN 1 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), ' ', p_size, 'g')
          WHEN 2 THEN concat(p_name, ' 2 x ', p_size, 'g') ELSE concat(p_name, ' pro') END AS name,
        p_retailprice AS price, concat('sku ', p_partkey) AS description, '' AS category,
        p_type AS predicted_bt, (p_partkey % 10) / 10.0e0 AS bt_confidence, CASE WHEN p_partkey % 3 = 0 THEN 'zero-shot' ELSE 'trained' END AS bt_source FROM {part}""",
    "results": """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS job_id, concat('item ', l_partkey) AS sku_name,
        CASE WHEN l_suppkey % 2 = 0 THEN 'market' ELSE 'food' END AS domain, CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('type ', l_partkey % 17) END AS bt,
        concat('["kw', l_partkey % 5, '","kw', l_partkey % 3, '"]') AS gk_json, CASE WHEN l_linenumber % 2 = 0 THEN concat('region ', l_partkey % 7) ELSE ' ' END AS region,
        1 - l_discount * 5 AS confidence, CASE WHEN l_linestatus = 'O' THEN 'Matcher' ELSE 'Classifier' END AS match_source,
        1 - l_tax AS match_score, 1 - l_discount AS bt_confidence, l_tax * 10 AS gk_confidence, l_discount * 10 AS region_confidence, l_shipdate AS created_at FROM {lineitem}""",
    "jobs": """SELECT s_suppkey AS job_id, concat('job/', s_name) AS job_name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS BIGINT) END AS total_count,
        CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS BIGINT) END AS high_count, CASE WHEN s_acctbal > 5000 THEN 'done' ELSE 'failed' END AS status, s_acctbal FROM {supplier}""",
    "requests": """SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, concat('/', event_type) AS path,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS duration_ms, ts AS created_at, props FROM {events}""",
    "vectors": """SELECT vec_id AS uid, embedding AS vector, concat('class ', label) AS class, concat('class ', label) AS basictype FROM {embeddings}""",
    "flavors": """SELECT n_nationkey AS source_pos, CASE n_nationkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'hot' WHEN 3 THEN 'small' ELSE 'old' END AS name,
        CASE n_nationkey % 5 WHEN 0 THEN 'widget, crimson' WHEN 1 THEN 'bolt' WHEN 2 THEN 'gear, spicy hot' WHEN 3 THEN 'ring' ELSE NULL END AS aliases,
        n_nationkey % 5 IN (0, 2) AS is_meat, n_nationkey % 5 = 1 AS is_vegetable, n_nationkey % 5 = 3 AS is_seafood FROM {nation}""",
    "brands": """SELECT p_partkey AS source_pos, split_part(p_name, ' ', 2) AS name, concat(split_part(p_name, ' ', 2), 's, ', p_name) AS aliases, p_partkey % 7 = 0 AS is_weak,
        CASE WHEN p_partkey % 2 = 0 THEN 'market' ELSE 'food' END AS domain, CAST(p_size AS BIGINT) AS catalog_count FROM {part}""",
    "revised": """SELECT * FROM (SELECT p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 1000000000 ELSE 0 END AS source_pos, p_name AS name, p_brand AS brand, p_type AS basictype,
        p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS price FROM {part}) AS r""",
    "stored": """SELECT p_partkey AS source_pos, p_name AS name, p_brand AS brand, p_type AS basictype, p_retailprice AS price FROM {part}""",
}


def sql_of(*names: str) -> str:
    """The views as leading common table expressions of an oracle query."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in names)


class Samples:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        return self.spark.sql(text, **{t: self.base(t) for t in set(re.findall(r"{(\w+)}", text))})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)
