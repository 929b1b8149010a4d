"""Cleaning and scalar functions for product texts. All are column expressions and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Unit -> (factor to the base unit, base unit, physical form).
UNITS = {
    "g": (1.0, "g", "solid"), "gram": (1.0, "g", "solid"), "mg": (0.001, "g", "solid"), "milligram": (0.001, "g", "solid"),
    "kg": (1000.0, "g", "solid"), "kilogram": (1000.0, "g", "solid"), "tonne": (1000000.0, "g", "solid"),
    "ml": (1.0, "ml", "liquid"), "millilitre": (1.0, "ml", "liquid"), "milliliter": (1.0, "ml", "liquid"),
    "l": (1000.0, "ml", "liquid"), "liter": (1000.0, "ml", "liquid"), "litre": (1000.0, "ml", "liquid"), "cl": (10.0, "ml", "liquid"),
}
#: Package types by the first number of a weight; the first range that holds it counts.
PACKAGE_BUCKETS = [(0.0, 78.0, "Stick/Bar"), (78.0, 110.0, "Cup"), (111.0, 160.0, "Cone"), (450.0, 10000.0, "Tub")]
#: Words that stay in lower case within a title.
MINOR_WORDS = ["with", "of", "and", "in", "the", "for", "to", "at", "by", "on", "a", "an", "or", "as", "but", "nor", "yet", "so"]
#: Names that carry almost no meaning alone.
DEGENERATE_NAMES = [
    "small", "medium", "large", "extra large", "xl",
    "chicken", "fish", "beef", "mutton", "prawn", "prawns",
    "vegetable", "veg", "egg", "seafood", "mixed", "mix",
    "regular", "special", "normal", "half", "full", "quarter",
]
#: Primary dish types, in order of precedence.
PRIMARY_DISHES = [
    "fried rice", "chop suey rice", "chop suey noodles", "chop suey",
    "biriyani", "kottu", "rice and curry", "nasi goreng", "noodles",
    "fried noodles", "pasta", "burger", "pizza", "submarine", "wrap", "taco", "soup",
]
#: Parts of names of JSON keys whose values are hidden, and what stands for them.
SENSITIVE_KEYS = ["token", "auth", "bearer", "password", "secret", "key", "x-api-key"]
REDACTED = "***REDACTED***"
#: Units and packings that the aggressive cleaner drops with their number.
PACKING_WORDS = "mg|g|gm|grams?|kg|kilo|kilograms?|ml|l|ltr|liters?|litres?|cl|pcs|pieces?|units?|packet|pkt|bundle|can|tin|pet|pack|slice|steaks?|box"
NULL_WORDS = ["", "nan", "none"]
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
_UNIT_WORDS = "mg|milligrams?|kg|kilograms?|g|grams?|ml|millilit(?:re|er)s?|l|lit(?:er|re)s?|cl|tonnes?"


def blank(c: Column) -> Column:
    """Null, blank, 'nan' or 'none'."""
    return F.coalesce(F.lower(F.trim(c)).isin(NULL_WORDS), F.lit(True))


def drop_invalid_names(df: DataFrame, key: str) -> DataFrame:
    return df.filter(~blank(F.col(key)))


def catalog_price(c: Column) -> Column:
    """Without $ and commas; null where blank or no number."""
    return F.trim(F.regexp_replace(c, "[$,]", "")).try_cast("double")


def input_price(c: Column) -> Column:
    """Digits and dots alone; 0 where that is no number."""
    return F.coalesce(F.regexp_replace(c, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def replace_each(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Each match of ``pattern`` replaced by ``new(match)``, which may compute. Between the matches the text stays.

    Matches are fenced with a control character that product texts don't hold, so the text, often a long expression, is evaluated once.
    """
    pieces = F.split(F.regexp_replace(text, pattern, "\u0001$0\u0001"), "\u0001", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, new(p)).otherwise(p)), "")


def _unit(unit: Column) -> Column:
    """(factor, base, form) of a unit's name in any case, singular or plural; null if unknown."""
    rows = [x for u, (factor, base, form) in UNITS.items() for x in (F.lit(u), F.struct(F.lit(factor).alias("factor"), F.lit(base).alias("base"), F.lit(form).alias("form")))]
    return F.try_element_at(F.create_map(*rows), F.regexp_replace(F.lower(unit), "s+$", ""))


def normalize_unit(value: Column, unit: Column) -> Column:
    """Struct (value, unit, form) in the base unit; null for an unknown unit."""
    u = _unit(unit)
    return F.when(u.isNotNull() & value.isNotNull(), F.struct((value * u["factor"]).alias("value"), u["base"].alias("unit"), u["form"].alias("form")))


def extract_weight(text: Column) -> Column:
    """The first weight or volume of a text as (value, unit, form); null if there is none."""
    fast = rf"(?i)(?<![a-z0-9])({NUMBER})\s*({_UNIT_WORDS})\b"
    loose = rf"({NUMBER})\s*([a-z]+)\b"
    low = F.lower(text)
    return F.coalesce(
        normalize_unit(F.regexp_extract(text, fast, 1).try_cast("double"), F.regexp_extract(text, fast, 2)),
        normalize_unit(F.regexp_extract(low, loose, 1).try_cast("double"), F.regexp_extract(low, loose, 2)),
    )


def _whole(x: Column) -> Column:
    return x.cast("long").cast("string")


def standardize_units(text: Column) -> Column:
    """Base units throughout: multipacks multiplied out, ranges dropped, piece counts as 'Npc'; amounts are cut to whole numbers."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "([0-9]+)([a-z]+)", "$1 $2")
    t = F.regexp_replace(t, rf"{NUMBER}\s*[a-z]+\s*-\s*{NUMBER}\s*[a-z]+", "")
    one, two = rf"([0-9]+)\s*x\s*({NUMBER})\s*([a-z]+)", rf"({NUMBER})\s*([a-z]+)\s*x\s*([0-9]+)"

    def multipack(pattern: str, size: int, count: int, unit: int) -> Callable[[Column], Column]:
        def new(m: Column) -> Column:
            part = lambda k: F.regexp_extract(m, pattern, k)
            total = part(count).cast("double") * part(size).cast("double")
            u = _unit(part(unit))
            return F.concat(_whole(F.coalesce(total * u["factor"], total)), F.coalesce(u["base"], part(unit)), F.lit(" "))

        return new

    t = replace_each(t, one, multipack(one, 2, 1, 3))
    t = replace_each(t, two, multipack(two, 1, 3, 2))
    single = rf"\b({NUMBER})\s?([a-z]+)\b"

    def convert(m: Column) -> Column:
        value, unit = F.regexp_extract(m, single, 1).cast("double"), F.regexp_extract(m, single, 2)
        return F.coalesce(F.concat(_whole(value * _unit(unit)["factor"]), _unit(unit)["base"]), m)

    t = replace_each(t, single, convert)
    t = F.regexp_replace(t, r"\bpack of ([0-9]+)\b", "$1pc")
    return F.trim(F.regexp_replace(t, r"([0-9]+)\s*(?:pcs|pieces|units)\b", "$1pc"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_final(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?:-|\|)?\s*sku\s*[0-9]+", "")
    t = F.regexp_replace(t, r"\b[0-9]{4,6}\b", "")
    return squeeze(F.regexp_replace(t, r"[^a-z0-9\s.]", " "))


def clean_text(text: Column) -> Column:
    return normalize_final(standardize_units(text))


def strip_weights(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"\b{NUMBER}\s?[a-z]+\b", "")
    return squeeze(F.regexp_replace(t, r"\b[0-9]+\b", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text))


def token_sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(words(text)), " ")


def entity_input(name: Column, description: Column, category: Column) -> Column:
    """Name, description and category in one text; blank ones are left out."""
    keep = lambda c: F.when(~F.coalesce(F.lower(c).isin(["", "nan", "none", "<na>"]), F.lit(True)), c)
    return F.concat_ws(" ", F.coalesce(name, F.lit("")), keep(description), keep(category))


def entity_prompt(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\b{NUMBER}\s?[a-zA-Z]+\b", "")
    return F.concat(F.lit("Product: "), squeeze(F.regexp_replace(t, r"\b[0-9]+\b", "")))


def package_type(weight: Column) -> Column:
    value = F.regexp_extract(weight, f"({NUMBER})", 1).try_cast("double")
    out = F.lit(None).cast("string")
    for low, high, label in reversed(PACKAGE_BUCKETS):
        out = F.when(value.between(low, high), label).otherwise(out)
    return out


def aggressive_clean(text: Column) -> Column:
    """ASCII letters and digits within words: multipacks, weights, packings, lone numbers and marks go. Case stays."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]+", " ")
    for pattern in (r"\b[0-9]+\s*[xX]\s*[0-9]+\w*\b", r"(?i)\bpack\s*of\s*[0-9]+\b", rf"(?i)\b{NUMBER}\s*(?:{PACKING_WORDS})\b", r"\b[0-9]+\b", r"[^a-zA-Z0-9\s]"):
        t = F.regexp_replace(t, pattern, " ")
    return squeeze(t)


def sanitize_keyword(c: Column) -> Column:
    """Letters, digits and single spaces, in Title Case; a letter after a digit counts as a word's first."""
    t = F.initcap(F.lower(squeeze(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", ""))))
    return replace_each(t, "[0-9][a-z]", F.upper)


def title_case(text: Column) -> Column:
    """Title case with minor words kept low, but for the first; the parts of a hyphenated word get capitals too."""

    def cap(p: Column) -> Column:
        return F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))

    def word(w: Column, i: Column) -> Column:
        bare = F.lower(F.regexp_replace(w, r"^\W+|\W+$", ""))
        opening = F.concat(F.regexp_extract(w, r"^(\W*)", 1), cap(bare), F.regexp_extract(w, r"(\W*)$", 1))
        parts = F.array_join(F.transform(F.split(w, "-"), lambda p: cap(p)), "-")
        return F.when(bare.isin(MINOR_WORDS), F.when(i == 0, opening).otherwise(F.lower(w))).otherwise(parts)

    return F.array_join(F.transform(words(text), lambda w, i: word(w, i)), " ")


def comma_list(c: Column) -> Column:
    """Trimmed, non-blank, distinct parts of a comma list; an empty array for null."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def row_hash(columns: list[str], price: str | None = None, salt: str = "") -> Column:
    """MD5 of the row's columns in order of their names, the price with two decimals, and a salt."""
    value = lambda c: F.format_string("%.2f", F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if c == price else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat_ws("\u0001", *[value(c) for c in sorted(columns)], F.lit(salt)).cast("binary"))


def dataset_fingerprint(df: DataFrame, texts: list[str], price: str) -> DataFrame:
    """rows, fingerprint: the same for the same rows in any order, without a sort."""
    h = F.xxhash64(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in texts], F.round(F.coalesce(F.col(price).cast("double"), F.lit(0.0)), 2))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"))


def occurrence_ids(df: DataFrame, name: str = "name", position: str = "source_pos", span: int = 1 << 20) -> DataFrame:
    """``df`` with uid: 'lowered name#n', n counting equal names from 0 by position, a number; null for no name.

    Counted in two levels, so that a name held by many rows is split: rows are numbered within a stretch of ``span`` positions, and the name's rows in
    earlier stretches, which come from counts alone, are added where there are any. ``df`` is read twice and must give the same rows.
    """
    low, stretch = F.lower(F.trim(F.col(name))), F.floor(F.col(position) / span)
    keyed = df.withColumn("_low", low).withColumn("_stretch", stretch)
    earlier = F.sum("_n").over(Window.partitionBy("_low").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = keyed.groupBy("_low", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_low", "_stretch", earlier.alias("_before")).filter("_before > 0")
    numbered = keyed.withColumn("_own", F.row_number().over(Window.partitionBy("_low", "_stretch").orderBy(position)) - 1)
    n = F.col("_own") + F.coalesce("_before", F.lit(0))
    return numbered.join(before, ["_low", "_stretch"], "left").withColumn("uid", F.concat("_low", F.lit("#occ_"), n.cast("string"))).select(*[c for c in df.columns if c != "uid"], "uid")


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def keyword_decode(c: Column) -> Column:
    """A JSON array of strings, or a comma list, as an array."""
    return F.when(F.trim(c).startswith("["), F.coalesce(F.from_json(c, "array<string>"), comma_list(c))).otherwise(comma_list(c))


def redact_json(c: Column, keys: list[str] = SENSITIVE_KEYS) -> Column:
    """JSON text with the scalar values under sensitive keys, at any depth, hidden."""
    pattern = rf'(?i)("[^"]*(?:{"|".join(keys)})[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)'
    return F.regexp_replace(c, pattern, f'$1"{REDACTED}"')


def is_degenerate_name(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(DEGENERATE_NAMES), F.lit(False))


def enriched_query(name: Column, description: Column, category: Column) -> Column:
    return F.concat_ws(" | ", *[F.when(~blank(c), F.trim(c)) for c in (name, description, category)])


def conflicting_dish(tag: Column, basic_type: Column, dishes: list[str] = PRIMARY_DISHES) -> Column:
    """Whether a tag is, or ends in, another primary dish than the basic type's; false where the type has none or ends the tag."""
    t, bt = F.lower(F.trim(F.coalesce(tag, F.lit("")))), F.lower(F.trim(F.coalesce(basic_type, F.lit(""))))
    own = F.lit(None).cast("string")
    for d in reversed(dishes):
        own = F.when(bt.endswith(d), d).otherwise(own)
    other = F.exists(F.array(*[F.lit(d) for d in dishes]), lambda d: (d != own) & ~F.endswith(bt, d) & ((t == d) | F.endswith(t, F.concat(F.lit(" "), d))))
    return (bt != "") & (t != "") & ~F.endswith(t, bt) & own.isNotNull() & F.coalesce(other, F.lit(False))


def unit_score(c: Column) -> Column:
    """Scores that were stored as percentages become fractions."""
    return F.when(c > 1, c / 100).otherwise(c)


def display_confidence(c: Column) -> Column:
    return F.round(c.try_cast("double"), 4)
