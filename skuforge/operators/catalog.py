"""Catalog maintenance: change detection, application, previews, and dictionary counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuforge.functions import text as T


def changes(old: DataFrame, new: DataFrame, key: str = "uid", digest: str = "row_hash") -> DataFrame:
    """key, change: insert, update, delete or same, by key and hash."""
    o, n = old.select(key, F.col(digest).alias("_o")), new.select(key, F.col(digest).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_o") != F.col("_n"), "update").otherwise("same")
    return o.join(n, key, "full_outer").select(key, kind.alias("change"))


def apply_changes(old: DataFrame, new: DataFrame, key: str = "uid", digest: str = "row_hash") -> DataFrame:
    """The table after the changes: stored rows (with their derived columns) where the hash is the same, else the new ones."""
    same = changes(old, new, key, digest).filter("change = 'same'").select(key)
    fresh = new.join(same, key, "left_anti")
    return old.join(same, key, "left_semi").unionByName(fresh, allowMissingColumns=True)


def change_counts(found: DataFrame) -> DataFrame:
    return found.agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("insert", "update", "delete", "same")])


def changed_rows(old: DataFrame, new: DataFrame, key: str = "uid", digest: str = "row_hash") -> DataFrame:
    """New and updated rows, the only ones whose derived columns are computed again."""
    return new.join(changes(old, new, key, digest).filter("change IN ('insert', 'update')").select(key), key, "left_semi")


def field_preview(old: DataFrame, new: DataFrame, columns: list[str], limit: int, key: str = "uid", digest: str = "row_hash") -> DataFrame:
    """key, change, column, old_value, new_value, capped: differing columns of the first ``limit`` rows of each kind of change, by key.

    A preview by design: capped tells that more rows of the kind exist.
    """
    found = changes(old, new, key, digest).filter("change <> 'same'")
    numbered = found.withColumn("_n", F.row_number().over(Window.partitionBy("change").orderBy(key))).filter(F.col("_n") <= limit + 1)
    capped = F.max("_n").over(Window.partitionBy("change")) > limit
    first = numbered.withColumn("capped", capped).filter(F.col("_n") <= limit)
    pack = lambda df, name: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias(name))
    rows = first.join(pack(old, "o"), key, "left").join(pack(new, "n"), key, "left")
    diff = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o.{c}").alias("old_value"), F.col(f"n.{c}").alias("new_value")) for c in columns]), lambda d: ~d["old_value"].eqNullSafe(d["new_value"]))
    return rows.select(key, "change", "capped", F.explode(diff).alias("d")).select(key, "change", "d.column", "d.old_value", "d.new_value", "capped")


def dictionary_counts(catalog: DataFrame, dictionary: DataFrame, third: str = "category") -> DataFrame:
    """domain, tag_type, tag, catalog_count: how many catalog rows name each tag; lists count by part, the third tag as a whole."""
    part = lambda kind, c: catalog.select("domain", F.lit(kind).alias("tag_type"), F.explode(T.comma_list(F.col(c))).alias("tag"))
    named = part("gk", "generic_keywords").unionByName(part("bt", "basictype")).unionByName(part("brand", "brand")).unionByName(catalog.select("domain", F.lit(third).alias("tag_type"), F.trim(third).alias("tag")))
    n = named.groupBy("domain", "tag_type", F.lower("tag").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rows = dictionary.select("domain", "tag_type", "tag").distinct().withColumn("_k", F.lower(F.trim("tag")))
    return rows.join(n, ["domain", "tag_type", "_k"], "left").select("domain", "tag_type", "tag", F.coalesce("_n", F.lit(0).cast("long")).alias("catalog_count"))


def type_map_counts(bt_gk: DataFrame, catalog: DataFrame) -> DataFrame:
    """domain, basictype, generic_keywords, gk_count, catalog_count."""
    n = catalog.groupBy("domain", F.lower(F.trim("basictype")).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rows = bt_gk.withColumn("_k", F.lower(F.trim("basictype")))
    return rows.join(n, ["domain", "_k"], "left").select("domain", "basictype", "generic_keywords", F.size(T.comma_list(F.col("generic_keywords"))).alias("gk_count"), F.coalesce("_n", F.lit(0).cast("long")).alias("catalog_count"))


def staged_type_map(pairs: DataFrame) -> DataFrame:
    """basictype, generic_keywords: distinct keywords of each type joined by ', ', in order. pairs: basictype, gk."""
    clean = pairs.select(F.trim("basictype").alias("basictype"), F.trim("gk").alias("gk")).filter("basictype <> '' AND gk <> ''").distinct()
    return clean.groupBy("basictype").agg(F.array_join(F.array_sort(F.collect_set("gk")), ", ").alias("generic_keywords"))


def write_domain(df: DataFrame, path: str, mode: str) -> None:
    """rebuild: replaces the domains in ``df``; sync: adds to them."""
    w = df.write.partitionBy("domain")
    (w.mode("overwrite").option("partitionOverwriteMode", "dynamic") if mode == "rebuild" else w.mode("append")).parquet(path)


def needs_training(fingerprint: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: the current fingerprint, and whether it differs from the stored one (one row or none)."""
    s = stored.select(F.col("fingerprint").alias("_s")).limit(1)
    return fingerprint.join(s, how="left").select("rows", "fingerprint", (~F.col("fingerprint").eqNullSafe(F.col("_s"))).alias("changed"))
