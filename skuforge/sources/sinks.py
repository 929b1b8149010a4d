"""Sinks: audit rows, exports and search documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.functions import text as T

CLEAN_COLUMNS = {"market": ["sku_name", "bt", "gk", "category"], "food": ["sku_name", "bt", "gk", "region"]}
AUDIT_COLUMNS = ["sku_name", "domain", "bt", "gk", "region", "confidence", "match_source", "matched_catalog_name", "match_score", "bt_confidence", "gk_confidence", "region_confidence", "logic_notes", "rules_applied"]


def append_results(rows: DataFrame, path: str) -> None:
    """Append audit rows; each carries its sku_uid, so that no order links input and result."""
    rows.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("domain", "created_date").parquet(path)


def write_cache(df: DataFrame, path: str, partition: str = "domain") -> None:
    """A columnar cache by domain; a rewrite replaces the partitions it holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def safe_cell(c: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets a tab in front."""
    text = c.cast("string")
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("\t"), text)).otherwise(text)


def export_history(rows: DataFrame, ids: DataFrame | None = None, newest: int = 50000) -> DataFrame:
    """Rows with the given ids (a table with column id), or the newest ones (of one id the first by the other columns), with safe text cells."""
    chosen = rows.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else rows.orderBy(F.desc("id"), *[c for c in rows.columns if c != "id"]).limit(newest)
    return chosen.select(*[safe_cell(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in chosen.dtypes])


def clean_export(rows: DataFrame, domain: str) -> DataFrame:
    return rows.filter(F.col("domain") == domain).select(*CLEAN_COLUMNS[domain])


def audit_export(rows: DataFrame) -> DataFrame:
    """Every score, note and rule; nested columns as JSON text."""
    kinds = dict(rows.dtypes)
    have = [c for c in AUDIT_COLUMNS if c in kinds]
    return rows.select(*[F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in have])


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.option("header", "true").option("escape", '"').mode("overwrite")
    (w.partitionBy(by) if by else w).csv(path)


def multi_job_export(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of the chosen jobs with the job's id and label. Write with ``write_csv(..., by='job_id')`` and once combined."""
    label = F.concat(F.lit("job_"), F.col("job_id").cast("string"), F.lit("_"), F.substring(F.regexp_replace("job_name", r"[\[\]:*?/\\]", "_"), 1, 20))
    return rows.join(jobs.select("job_id", "job_name"), "job_id").withColumn("sheet", label).drop("job_name")


def catalog_documents(catalog: DataFrame) -> DataFrame:
    """uid, doc (JSON) for a search engine: comma lists become arrays, nulls empty ones."""
    lists = {c: T.comma_list(F.col(c)) for c in ("generic_keywords", "brand", "flavor") if c in catalog.columns}
    rows = catalog.withColumns(lists)
    return rows.select("uid", F.to_json(F.struct(*sorted(c for c in rows.columns))).alias("doc"))


def dictionary_documents(tags: DataFrame, brands: DataFrame, bt_gk: DataFrame) -> DataFrame:
    """Tags, brands or flavors, and the type-keyword map in one shape: kind, domain, name, related, catalog_count."""
    none = F.array().cast("array<string>")
    return (
        tags.select(F.col("tag_type").alias("kind"), "domain", F.col("tag").alias("name"), none.alias("related"), F.col("catalog_count").cast("long").alias("catalog_count"))
        .unionByName(brands.select(F.lit("brand").alias("kind"), "domain", "name", T.comma_list(F.col("aliases")).alias("related"), F.col("catalog_count").cast("long").alias("catalog_count")))
        .unionByName(bt_gk.select(F.lit("bt_gk_map").alias("kind"), "domain", F.col("basictype").alias("name"), T.comma_list(F.col("generic_keywords")).alias("related"), F.col("catalog_count").cast("long").alias("catalog_count")))
    )
