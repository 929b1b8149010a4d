"""Matching products with catalog rows: exact keys, token-sorted keys with the closest weight, and pools of scored candidates.

Keys are many-to-many in real catalogs, so the catalog is first reduced to one row for each key (and type, or weight), by
aggregates that combine before their shuffle; a product then meets a handful of rows, however often a key repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuforge.functions import text as T

#: Confidence from which a predicted type restricts a search, by the prediction's source.
BT_THRESHOLD, BT_THRESHOLD_ZERO_SHOT = 0.50, 0.40
EXACT, TOKENS = "Exact Text Match", "Fuzzy Match (100%)"


def prepare(df: DataFrame) -> DataFrame:
    """``df`` with clean_text, clean_no_weights, weight_val, token_key, from its column name; each distinct name is cleaned once, and rows take its texts."""
    names = df.select(F.col("name").alias("_name")).distinct().withColumn("clean_text", T.clean_text(F.col("_name")))
    names = names.withColumns({"clean_no_weights": T.strip_weights(F.col("clean_text")), "weight_val": T.extract_weight(F.col("_name"))})
    names = names.withColumn("token_key", T.token_sorted(F.col("clean_no_weights")))
    return df.join(names, F.equal_null("name", "_name")).drop("_name")


def bt_is_confident(confidence: Column, source: Column) -> Column:
    return F.coalesce(confidence >= F.when(source == "zero-shot", BT_THRESHOLD_ZERO_SHOT).otherwise(BT_THRESHOLD), F.lit(False))


def _guard(inputs: DataFrame) -> Column:
    """The type that a match must have, lowered; null where none is confident."""
    if "predicted_bt" not in inputs.columns:
        return F.lit(None).cast("string")
    return F.when(bt_is_confident(F.col("bt_confidence"), F.col("bt_source")) & ~T.blank(F.col("predicted_bt")), F.lower(F.trim("predicted_bt")))


def exact_matches(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """uid, exact_pos (null where the type disagrees), key_known: the lowest catalog position with the same clean text.

    Both sides come from ``prepare``; inputs have uid, the catalog source_pos and basictype.
    """
    by_type = catalog.filter("clean_text <> ''").groupBy("clean_text", F.lower(F.trim("basictype")).alias("bt")).agg(F.min("source_pos").alias("pos"))
    per_key = by_type.groupBy("clean_text").agg(F.min("pos").alias("any_pos"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("bt", F.lit("")).alias("bt"), "pos"))).alias("by_bt"))
    rows = inputs.select("uid", "clean_text", _guard(inputs).alias("_bt"))
    pos = F.when(F.col("_bt").isNull(), F.col("any_pos")).otherwise(F.try_element_at("by_bt", F.col("_bt")))
    return rows.join(per_key, "clean_text").select("uid", pos.alias("exact_pos"), F.lit(True).alias("key_known"))


def weight_gap(a: Column, b: Column) -> Column:
    """Difference of two weights of one form in percent of the larger; null where they can't be compared."""
    top = F.greatest(a["value"], b["value"])
    return F.when(a["form"] == b["form"], F.when(top > 0, F.abs(a["value"] - b["value"]) / top * 100).otherwise(0.0))


def token_matches(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """uid, token_pos, weight_note: among rows with the same sorted words the one of the closest weight, else the first.

    The note tells whether the weight agrees (within one percent); it is empty where the input has none. Inputs of one key, type and weight
    share their match, which is found once.
    """
    least = lambda bt: catalog.filter("token_key <> ''").groupBy("token_key", bt.alias("_bt"), F.col("weight_val").alias("c_weight")).agg(F.min("source_pos").alias("pos"))
    typed = least(F.coalesce(F.lower(F.trim("basictype")), F.lit(""))).filter("_bt <> ''")
    rows = typed.unionByName(least(F.lit("")))  # of a type, or of any
    left = inputs.filter("token_key <> ''").select("uid", "token_key", "weight_val", F.coalesce(_guard(inputs), F.lit("")).alias("_bt"))
    unit = ["token_key", "_bt", "weight_val"]
    pairs = left.select(*unit).distinct().join(rows, ["token_key", "_bt"])
    gap = weight_gap(F.col("weight_val"), F.col("c_weight"))
    first = F.min_by("c_weight", "pos")
    best = pairs.groupBy(*unit).agg(F.min(F.struct(gap.isNull().alias("none"), F.coalesce(gap, F.lit(0.0)).alias("gap"), F.col("pos"), F.col("c_weight.value").alias("value"))).alias("b"), first.alias("first_weight")).withColumnRenamed("weight_val", "w")
    whole = lambda c: c.cast("long").cast("string")
    mismatch = lambda v: F.concat(F.lit("Weight Mismatch ("), whole(F.col("w.value")), F.lit(" vs "), whole(v), F.lit(")"))
    note = (
        F.when(F.col("w").isNull(), "")
        .when(F.col("b.none"), F.when(F.col("first_weight").isNotNull(), mismatch(F.col("first_weight.value"))).otherwise(""))
        .when(F.col("b.gap") < 1.0, F.concat(F.lit("Weight Match ("), whole(F.col("w.value")), F.lit(")")))
        .otherwise(mismatch(F.col("b.value")))
    )
    found = best.select(F.col("token_key").alias("_k"), F.col("_bt").alias("_b"), F.col("w").alias("_w"), F.col("b.pos").alias("token_pos"), note.alias("weight_note"))
    return left.join(found, (F.col("token_key") == F.col("_k")) & (F.col("_bt") == F.col("_b")) & F.equal_null("weight_val", "_w")).select("uid", "token_pos", "weight_note")


def cascade(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row an input: uid, matched_pos, score, match_source, logic_notes.

    Exact text first; a known text whose types all disagree goes straight to the vector stage, others try the sorted words.
    Rows without a match have match_source 'vector' and score 0.
    """
    e = exact_matches(inputs, catalog)
    t = token_matches(inputs, catalog)
    rows = inputs.select("uid").join(e, "uid", "left").join(t, "uid", "left")
    exact, token = F.col("exact_pos").isNotNull(), F.col("key_known").isNull() & F.col("token_pos").isNotNull()
    return rows.select(
        "uid",
        F.when(exact, F.col("exact_pos")).when(token, F.col("token_pos")).alias("matched_pos"),
        F.when(exact | token, 1.0).otherwise(0.0).alias("score"),
        F.when(exact, "exact").when(token, "token").otherwise("vector").alias("match_source"),
        F.when(exact, EXACT).when(token, F.concat_ws(" | ", F.lit(TOKENS), F.when(F.col("weight_note") != "", F.col("weight_note")))).otherwise("").alias("logic_notes"),
    )


def named(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Matches with the catalog row's name and type; inputs without a match stay."""
    rows = catalog.select(F.col("source_pos").alias("matched_pos"), F.col("name").alias("matched_catalog_name"), F.col("basictype").alias("matched_bt"))
    return matches.join(rows, "matched_pos", "left")


def pick_winner(candidates: DataFrame, query: str = "uid", top: int = 5, tolerance: float = 1e-4) -> DataFrame:
    """Of each query's ``top`` candidates by rerank score, in that order, the one whose gated score no later one beats.

    candidates: score (gated), rerank_score, cand. A later candidate wins by more than ``tolerance``, or at an equal score by a higher
    rerank score, so the result is a fold over at most ``top`` rows.
    """
    order = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "cand")
    kept = candidates.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top)
    rows = kept.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("_n", "score", "rerank_score", "cand", "status", "notes"))).alias("c"))
    better = lambda a, b: (b["score"] > a["score"] + tolerance) | ((F.abs(b["score"] - a["score"]) <= tolerance) & (b["rerank_score"] > a["rerank_score"]))
    win = F.aggregate(F.slice("c", F.lit(2), F.size("c")), F.get("c", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    return rows.select(query, win.alias("w")).select(query, "w.cand", "w.score", "w.rerank_score", "w.status", "w.notes")


def choose_pool(inputs: DataFrame, filtered: DataFrame, opened: DataFrame) -> DataFrame:
    """One row an input: the winner within the predicted type if it is of high confidence, else the better of both pools'.

    filtered, opened: results of ``pick_winner``. Inputs without candidates come out with the lowest status.
    """
    f = filtered.select("uid", F.struct("score", "cand", "status", "notes").alias("f"))
    o = opened.select("uid", F.struct("score", "cand", "status", "notes").alias("o"))
    rows = inputs.select("uid").join(f, "uid", "left").join(o, "uid", "left")
    use_f = F.col("f").isNotNull() & ((F.col("f.status") == "High Confidence") | F.col("o").isNull() | (F.col("f.score") >= F.col("o.score")))
    w = F.when(use_f, F.col("f")).otherwise(F.col("o"))
    kind = F.when(use_f & (F.col("f.status") == "High Confidence"), "BT-filtered").when(use_f, "BT-filtered fallback").when(F.col("o").isNotNull(), "Unfiltered")
    return rows.select("uid", w["cand"].alias("cand"), F.coalesce(w["score"], F.lit(0.0)).alias("score"), F.coalesce(w["status"], F.lit("Low / Rejected")).alias("status"), F.coalesce(F.concat(kind, F.lit(": "), w["notes"]), F.lit("No candidates")).alias("notes"))


def filter_food_keywords(keywords: Column, input_terms: Column, specific: Column) -> Column:
    """Keywords less those naming a specific flavor that the input lacks.

    input_terms: flavors and special kinds that the input supports; specific: all flavor terms, special ones included.
    """
    holds = lambda k, f: F.concat(F.lit(" "), F.lower(k), F.lit(" ")).contains(F.concat(F.lit(" "), F.lower(f), F.lit(" ")))
    return F.filter(keywords, lambda k: ~F.exists(specific, lambda f: holds(k, f) & ~F.array_contains(input_terms, F.lower(f))))


def filter_market_keywords(keywords: Column, flavors: Column) -> Column:
    """Keywords less those that contain a flavor of either side."""
    return F.filter(keywords, lambda k: ~F.exists(flavors, lambda f: F.contains(F.lower(k), F.lower(f))))


def swap_entities(text: Column, old: Column, new: Column) -> Column:
    """An entity exchanged within a text, wherever it stands as whole words, whatever its case."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)(?<![a-z0-9])\Q"), old, F.lit(r"\E(?![a-z0-9])")), new)
