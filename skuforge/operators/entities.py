"""Alias dictionaries, and brands and flavors found in texts.

A dictionary is a table alias, canonical, is_weak and flags. Texts are scanned by joining their word n-grams with the
aliases, so a dictionary of any size works and Spark decides on a broadcast by size; overlaps are then resolved leftmost,
longest first within each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.functions import text as T
from skuforge.operators.alike import alike
from skuforge.sources.shared import checkpointed

WORD = "[a-z0-9]+"


def alias_dictionary(names: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """names: source_pos, name, aliases, and columns in ``keep``. alias, canonical, words, keep...: for an alias given twice the later row holds."""
    keep = keep or []
    canonical = F.lower(F.trim("name"))
    exploded = names.filter(~T.blank(F.col("name"))).select("source_pos", canonical.alias("canonical"), *keep, F.explode(F.array_union(F.transform(T.comma_list(F.col("aliases")), F.lower), F.array(canonical))).alias("alias"))
    last = exploded.groupBy("alias").agg(F.max_by(F.struct("canonical", *keep), F.struct("source_pos", "canonical")).alias("r"))
    return last.select("alias", "r.canonical", *[f"r.{c}" for c in keep], F.size(F.regexp_extract_all("alias", F.lit(WORD), F.lit(0))).alias("words"))


def flavor_dictionary(flavors: DataFrame) -> DataFrame:
    """Aliases of flavors with their kinds. 'shrimp' means 'prawn' where both are known."""
    d = alias_dictionary(flavors, ["is_meat", "is_vegetable", "is_seafood"])
    prawn = d.filter("alias = 'prawn'").select(F.lit("shrimp").alias("_a"), F.struct("canonical", "is_meat", "is_vegetable", "is_seafood").alias("_p"))
    new = lambda c: F.coalesce(F.col(f"_p.{c}"), F.col(c)).alias(c)
    return d.join(F.broadcast(prawn), F.col("alias") == F.col("_a"), "left").select("alias", new("canonical"), new("is_meat"), new("is_vegetable"), new("is_seafood"), "words")  # one row


def scan(texts: DataFrame, dictionary: DataFrame, uid: str = "uid", text: str = "text", longest: int | None = None) -> DataFrame:
    """uid, at, alias, canonical of every alias in a text, leftmost first, the longest at a place, none overlapping.

    Aliases match whole words of letters and digits; ``longest`` is the most words an alias has, by default the dictionary's own.
    Each distinct text is scanned once, whatever the files' split, and its hits go to all its rows.
    """
    if longest is None:
        longest = dictionary.agg(F.max(F.size(F.regexp_extract_all("alias", F.lit(WORD), F.lit(0))))).first()[0] or 1
    rows = texts.select(uid, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    toks = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    grams = rows.select("_t").distinct().select("_t", F.posexplode(toks).alias("at", "_"), toks.alias("_w")).select("_t", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - F.col("at")))).alias("n"), "_w")
    grams = grams.select("_t", "at", "n", F.array_join(F.slice("_w", F.col("at") + 1, F.col("n")), " ").alias("gram"))
    known = dictionary.select(F.array_join(F.regexp_extract_all("alias", F.lit(WORD), F.lit(0)), " ").alias("gram"), "alias", "canonical").filter("gram <> ''")
    hits = grams.join(known, "gram").groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("n"), "alias", "canonical"))).alias("h"))
    empty = F.array().cast("array<struct<at:int,n:int,alias:string,canonical:string>>")
    taken = F.aggregate("h", F.struct(F.lit(0).alias("next"), empty.alias("out")), lambda a, h: F.when(h["at"] >= a["next"], F.struct((h["at"] - h["n"]).alias("next"), F.concat(a["out"], F.array(h)).alias("out"))).otherwise(a))["out"]
    return rows.join(hits.select("_t", taken.alias("taken")), "_t").select(uid, F.explode("taken").alias("h")).select(uid, "h.at", "h.alias", "h.canonical")


def entities(texts: DataFrame, brands: DataFrame, flavors: DataFrame, uid: str = "uid", text: str = "text") -> DataFrame:
    """uid, brand (the first hit, strong aliases before weak ones), flavor (all hits); arrays sorted, empty where none."""
    b = scan(texts, brands, uid, text).join(brands.select("alias", "is_weak"), "alias")
    b = b.groupBy(uid).agg(F.min_by("canonical", F.struct(F.coalesce("is_weak", F.lit(False)), "at")).alias("b"))
    f = scan(texts, flavors, uid, text).groupBy(uid).agg(F.array_sort(F.collect_set("canonical")).alias("f"))
    none = F.array().cast("array<string>")
    out = texts.select(uid).join(b, uid, "left").join(f, uid, "left")
    return out.select(uid, F.when(F.col("b").isNotNull(), F.array("b")).otherwise(none).alias("brand"), F.coalesce("f", none).alias("flavor"))


def fuzzy_entities(texts: DataFrame, dictionary: DataFrame, uid: str = "uid", text: str = "text", cutoff: float = 85.0) -> DataFrame:
    """uid, canonical: the first word of four letters or more, or pair of words, that resembles an alias. For texts without an exact hit.

    Words and pairs that differ meet the aliases once, through the prefix filter of alike.py.
    """
    toks = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    one = texts.select(uid, F.posexplode(toks).alias("at", "gram")).filter(F.length("gram") >= 4).select(uid, (F.col("at") * 2).alias("at"), "gram")
    two = texts.select(uid, F.posexplode(F.zip_with(F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).alias("at", "gram"))
    all_ = one.unionByName(two.select(uid, (F.col("at") * 2 + 1).alias("at"), "gram"))
    all_ = checkpointed(all_)  # read for the pairs and for their places
    best = best_in_dictionary(all_.select("gram").distinct(), dictionary.select("alias"), "gram", "alias", cutoff)
    hits = all_.join(best, "gram").join(dictionary.select("alias", "canonical"), "alias")
    return hits.groupBy(uid).agg(F.min_by("canonical", F.struct("at", "alias")).alias("canonical"))


def best_in_dictionary(texts: DataFrame, choices: DataFrame, text: str, choice: str, cutoff: float) -> DataFrame:
    """text, choice, ratio: the choice most like each text, at least ``cutoff``; ties go to the first in order."""
    scored = alike(texts, choices, text, choice, cutoff)
    best = scored.groupBy("_a").agg(F.min(F.struct((-F.col("ratio")).alias("r"), F.col("_b").alias("b"))).alias("x"))
    return best.select(F.col("_a").alias(text), F.col("x.b").alias(choice), (-F.col("x.r")).alias("ratio"))


def prefilled(column: Column, scanned: Column) -> Column:
    """The entity column's own parts where it is filled, else what the scan found."""
    return F.when(~T.blank(column), F.transform(T.comma_list(column), F.lower)).otherwise(scanned)


def resolve_words(values: DataFrame, dictionary: DataFrame, uid: str, column: str) -> DataFrame:
    """uid, resolved: each part of an entity array as its canonical name, or as it is."""
    parts = values.select(uid, F.posexplode_outer(column).alias("at", "raw"))
    joined = parts.join(dictionary.select("alias", "canonical"), F.lower("raw") == F.col("alias"), "left")
    return joined.groupBy(uid).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical", "raw").alias("v")))), lambda s: s["v"])).alias("resolved"))


def canonical_flavors(sets: DataFrame, dictionary: DataFrame, uid: str = "uid", column: str = "flavor") -> DataFrame:
    """uid, flavors: the canonical flavor of each entity of a set: of the alias equal to it, else of the first alias within it.

    Sorted and distinct; entities in which nothing is known are left out, a set without any is empty.
    """
    each = sets.select(uid, F.explode(column).alias("e")).select(uid, F.lower(F.trim("e")).alias("e"))
    exact = each.select("e").distinct().join(dictionary.select("alias", "canonical"), F.col("e") == F.col("alias"), "left").select("e", "canonical")
    rest = exact.filter("canonical IS NULL").select("e")
    inside = scan(rest, dictionary, "e", "e").groupBy("e").agg(F.min_by("canonical", "at").alias("canonical"))
    known = exact.filter("canonical IS NOT NULL").unionByName(inside)
    found = each.join(known, "e").groupBy(uid).agg(F.array_sort(F.collect_set("canonical")).alias("flavors"))
    return sets.select(uid).join(found, uid, "left").select(uid, F.coalesce("flavors", F.array().cast("array<string>")).alias("flavors"))


def triage(flavors: DataFrame, dictionary: DataFrame, uid: str = "uid", column: str = "flavor") -> DataFrame:
    """uid, land_meats, seafood, vegetables: canonical flavors by kind; seafood is no land meat."""
    kinds = dictionary.groupBy("canonical").agg(*[F.max(c).alias(c) for c in ("is_meat", "is_vegetable", "is_seafood")])
    rows = flavors.select(uid, F.explode_outer(column).alias("canonical")).join(kinds, "canonical", "left")
    pick = lambda cond: F.array_sort(F.collect_set(F.when(F.expr(cond), F.col("canonical"))))
    return rows.groupBy(uid).agg(pick("is_meat AND NOT is_seafood").alias("land_meats"), pick("is_seafood").alias("seafood"), pick("is_vegetable AND NOT is_meat AND NOT is_seafood").alias("vegetables"))


def enrich_name(name: Column, land_meats: Column, seafood: Column, vegetables: Column) -> Column:
    """' mixed' for meat with seafood, or two land meats but eggs; ' veg' for vegetables alone."""
    meats = F.filter(land_meats, lambda m: m != "egg")
    mixed = ((F.size(land_meats) > 0) & (F.size(seafood) > 0)) | (F.size(meats) >= 2)
    veg = (F.size(land_meats) == 0) & (F.size(seafood) == 0) & (F.size(vegetables) > 0)
    return F.when(mixed, F.concat(name, F.lit(" mixed"))).when(veg, F.concat(name, F.lit(" veg"))).otherwise(name)


def special_terms(dictionary: DataFrame) -> DataFrame:
    """term, kind: names, aliases and plurals of mixed, seafood and vegetable; every other canonical flavor is 'specific'."""
    special = dictionary.filter(F.col("canonical").isin("mixed", "seafood", "vegetable"))
    terms = special.select(F.col("canonical").alias("kind"), F.explode(F.array_distinct(F.array("alias", "canonical", F.concat("alias", F.lit("s")), F.concat("canonical", F.lit("s"))))).alias("term"))
    rest = dictionary.filter(~F.col("canonical").isin("mixed", "seafood", "vegetable")).select(F.lit("specific").alias("kind"), F.col("canonical").alias("term"))
    return terms.unionByName(rest).select("term", "kind").distinct()


def strip_brands(text: Column, brands: Column) -> Column:
    """Text without the brands of an array; other words that contain one stay."""
    padded = F.aggregate(F.array_sort(brands, lambda a, b: F.length(b) - F.length(a)), F.concat(F.lit(" "), F.regexp_replace(F.lower(text), " +", "  "), F.lit(" ")), lambda t, b: F.replace(t, F.concat(F.lit(" "), F.replace(F.lower(b), F.lit(" "), F.lit("  ")), F.lit(" ")), F.lit(" ")))
    return T.squeeze(padded)


def longest_brand(brands: Column) -> Column:
    """The longest brand, in Title Case; the first in order among equals; null for none."""
    return F.initcap(F.get(F.array_sort(brands, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0)))
