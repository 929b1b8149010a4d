"""Readers of catalogs, product lists and dictionaries. Files of one format are read in parallel by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.functions import text as T

#: Headings of catalog tabs by domain, and headings that product lists use.
CATALOG_COLUMNS = {
    "market": {"Name": "name", "Brand": "brand", "basictype": "basictype", "Generic keywords": "generic_keywords", "Price": "price", "category": "category", "Description": "description"},
    "food": {"Name": "name", "Flavor": "flavor", "basictype": "basictype", "Generic keywords": "generic_keywords", "Price": "price", "region": "region", "Description": "description"},
}
LIST_COLUMNS = {"name": ["name", "sku_name", "sku", "title"], "price": ["price", "cost", "mrp"], "description": ["description", "desc"], "category": ["category", "cat", "type"]}


def _plain(name: str) -> str:
    return name.lower().replace(" ", "").replace("_", "")


def _all_text(spark: SparkSession, path: str, sep: str = ",", header: bool = True, multi_line: bool = False) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header, mode="PERMISSIVE", multiLine=multi_line, escape='"', inferSchema=False)


def read_catalog_csv(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """A catalog tab: unnamed columns go, headings are found without regard to case and spaces, rows need a name."""
    raw = _all_text(spark, path)
    by_name = {_plain(c): c for c in raw.columns if not _plain(c).startswith(("unnamed", "_c"))}
    chosen = [F.col(f"`{by_name[_plain(k)]}`").alias(v) if _plain(k) in by_name else F.lit(None).cast("string").alias(v) for k, v in CATALOG_COLUMNS[domain].items()]
    rows = T.drop_invalid_names(raw.select(*chosen), "name")
    return rows.withColumns({"price": T.catalog_price(F.col("price")), "domain": F.lit(domain)})


def shape_product_list(raw: DataFrame) -> DataFrame:
    """name, price, description, category from columns found by alias; the first column is the name if none is called so."""
    by_name = {_plain(c): c for c in reversed(raw.columns)}

    def find(field: str):
        return next((by_name[_plain(a)] for a in LIST_COLUMNS[field] if _plain(a) in by_name), None)

    text = lambda field: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) if (c := find(field)) else F.lit("")
    name = F.trim(F.col(f"`{find('name') or raw.columns[0]}`").cast("string"))
    return raw.select(name.alias("name"), T.input_price(text("price")).alias("price"), text("description").alias("description"), text("category").alias("category")).filter(F.coalesce(F.col("name"), F.lit("")) != "")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Tab if the first line holds one, else comma. Reads one line."""
    first = spark.read.text(path).limit(1).collect()
    return "\t" if first and "\t" in first[0][0] else ","


def read_product_list(spark: SparkSession, path: str) -> DataFrame:
    return shape_product_list(_all_text(spark, path, sniff_separator(spark, path), multi_line=True))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A file with one tag a line and no heading."""
    tag = F.trim(F.col("_c0"))
    return _all_text(spark, path, header=False).select(tag.alias("tag")).filter(F.coalesce(F.col("tag"), F.lit("")) != "")


def read_tabs(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of a folder of tabs with the tab's name; the two spellings of the market category tab are one."""
    tab = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return spark.read.option("recursiveFileLookup", "true").text(folder).select(F.when(tab == "Market_Cat", "Market_Category").otherwise(tab).alias("tab"), F.col("value").alias("line"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """source, md5, size and time of each staged file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), F.md5("content").alias("md5"), F.col("length").alias("size"), F.col("modificationTime").alias("staged_at"))


def read_domain(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """One domain of a table partitioned by domain; the other partitions are not read."""
    return spark.read.parquet(path).filter(F.col("domain") == domain)
