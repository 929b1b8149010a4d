"""Validation gates for a pair of an input and a catalog candidate.

Columns of a pair: clean_text, clean_no_weights, weight_val, entities (brand, flavor arrays), price, predicted_bt of the input; the same
with prefix c_ and c_basictype, c_generic_keywords, c_categories of the candidate; raw_score. The fuzzy ratios, the only
Python here, are computed first, once for each distinct pair of texts; the gates then are one chain of column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skuforge.functions import similarity as S
from skuforge.functions import text as T

REJECTED = -10.0
HIGH, BYPASS, WEIGHT_TEXT, PRICE_GAP = 4.0, 90.0, 80.0, 75.0
ICE_CREAM = "ice cream"
#: Entities whose conflict costs PENALTY, where entities or c_entities hold them; extraction finds brands and flavors only.
OPTIONAL, PENALTY = ["variant", "scent", "active ingredient"], 3.0


@F.pandas_udf(StringType())
def entity_check(a, b, text_a, text_b):
    """Match, Neutral or Conflict of two entity arrays."""
    import pandas as pd

    def one(x, y, tx, ty) -> str:
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        if not x and not y:
            return "Neutral"
        if not x or not y:  # one side alone: look for it in the other's text
            seek, text = (x, ty) if x else (y, tx)
            text = (text or "").lower()
            found = any(v in text or len(v) >= 5 and S.partial(v, text) >= 80 for v in seek)
            return "Match" if found else "Conflict"
        near = lambda v, w: v in w or w in v or min(len(v), len(w)) >= 5 and S.indel(v, w) >= 80
        return "Match" if any(near(v, w) for v in x for w in y) else "Conflict"

    return pd.Series([one(*r) for r in zip(a, b, text_a, text_b, strict=True)])


def status(score: Column) -> Column:
    return F.when(score >= HIGH, "High Confidence").when(score > 0, "Medium Confidence").otherwise("Low / Rejected")


def probability(score: Column, bypass: Column) -> Column:
    return F.when(score == REJECTED, 0.0).when(bypass | (score >= 90), F.least(F.lit(1.0), score / 100)).otherwise(F.bround(S.sigmoid(score, 0.55), 4))


def _note(cond: Column, text: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), text)


def _whole(c: Column) -> Column:
    return c.cast("long").cast("string")


def _optional(pairs: DataFrame) -> dict[str, tuple[Column, Column]]:
    """The optional entities that either side holds, as arrays of both."""
    held = [set(pairs.schema[side].dataType.names) for side in ("entities", "c_entities")]
    none = F.array().cast("array<string>")
    array = lambda k, x: F.coalesce(F.col(("entities", "c_entities")[k])[x], none) if x in held[k] else none
    return {x: (array(0, x), array(1, x)) for x in OPTIONAL if any(x in h for h in held)}


def with_ratios(pairs: DataFrame) -> DataFrame:
    """``pairs`` with token_ratio, typo_ratio, brand_check and flavor_check, and a check of each optional entity that either side holds.

    Pairs of the same texts and entities share them: they are computed once, and pairs take them by a join.
    """
    unit = {x: f"_{x}" for x in ("clean_no_weights", "c_clean_no_weights", "clean_text", "c_clean_text", "entities", "c_entities")}
    told = pairs.select(*unit).distinct()
    told = told.withColumns(
        {
            "token_ratio": S.token_sort_ratio("clean_no_weights", "c_clean_no_weights"),
            "typo_ratio": S.typo_ratio("clean_no_weights", "c_clean_no_weights"),
            "brand_check": entity_check("entities.brand", "c_entities.brand", "clean_text", "c_clean_text"),
            "flavor_check": entity_check("entities.flavor", "c_entities.flavor", "clean_text", "c_clean_text"),
        }
        | {f"{x}_check": entity_check(a, b, "clean_text", "c_clean_text") for x, (a, b) in _optional(pairs).items()}
    )
    same = [F.equal_null(x, y) for x, y in unit.items()]
    return pairs.join(told.withColumnsRenamed(unit), same).drop(*unit.values())


def market_gates(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with ratios) and gate_raw, score (probability; -10 where rejected), status, notes."""
    c = F.col
    own = pairs.columns
    # what is used more than once is a column of its own: as one expression it is repeated until its code is too large to compile
    rows = pairs.withColumns(
        {
            "_bypass": (c("token_ratio") >= BYPASS) | (c("typo_ratio") >= BYPASS),
            "_both": c("weight_val").isNotNull() & c("c_weight_val").isNotNull(),
            "_frozen": F.lower(F.concat_ws(" ", "clean_text", "c_clean_text", F.array_join(F.coalesce("c_generic_keywords", F.array().cast("array<string>")), " "), F.coalesce(c("c_categories"), F.lit("")))).contains(ICE_CREAM),
            "_p_in": T.package_type(c("weight_val.value").cast("string")),
            "_p_cat": T.package_type(c("c_weight_val.value").cast("string")),
            "_top": F.greatest(c("weight_val.value"), c("c_weight_val.value")),
        }
    )
    bypass, both, p_in, p_cat, top = c("_bypass"), c("_both"), c("_p_in"), c("_p_cat"), c("_top")
    rows = rows.withColumns(
        {
            "_form": both & (c("weight_val.form") != c("c_weight_val.form")),
            "_package": c("_frozen") & both & (p_in != p_cat),
            "_brand": ~bypass & (c("brand_check") == "Conflict"),
            "_flavor": ~bypass & (c("flavor_check") == "Conflict"),
            "_gap": F.when(top == 0, 0.0).otherwise(F.abs(c("weight_val.value") - c("c_weight_val.value")) / top * 100),
        }
    )
    form, package, brand, flavor, gap = c("_form"), c("_package"), c("_brand"), c("_flavor"), c("_gap")
    penalties = {x: ~bypass & (c(f"{x}_check") == "Conflict") for x in _optional(pairs)}
    weighed = F.coalesce(both & ((top == 0) | (gap < 1.0) & (bypass | (c("token_ratio") >= WEIGHT_TEXT))), F.lit(False))  # two zero weights agree whatever the texts
    rows = rows.withColumns({"_rejected": F.coalesce(form, F.lit(False)) | F.coalesce(package, F.lit(False)) | brand | flavor, "_weighed": weighed})
    rejected, weighed = c("_rejected"), c("_weighed")
    s1 = F.when(bypass, F.greatest(c("raw_score"), F.lit(100.0))).otherwise(c("raw_score")) + F.when(weighed, 2.0).otherwise(0.0)
    for costs in penalties.values():
        s1 = s1 - F.when(costs, PENALTY).otherwise(0.0)
    in_category = ~T.blank(c("category")) & ~T.blank(c("c_categories")) & F.contains(F.lower("c_categories"), F.lower(F.trim("category")))
    aligned = ~bypass & ~T.blank(c("predicted_bt")) & (F.lower(F.trim("predicted_bt")) == F.lower(F.trim("c_basictype"))) & (c("brand_check") != "Conflict") & (c("flavor_check") != "Conflict")
    rows = rows.withColumns({"_s1": s1, "_in_category": in_category, "_aligned": aligned, "_close": F.abs(c("price") - c("c_price")) <= PRICE_GAP})
    s1, in_category, aligned, close = c("_s1"), c("_in_category"), c("_aligned"), c("_close")
    rows = rows.withColumn("_priced", (s1 < 6.0) & weighed & (c("price") > 0) & (c("c_price") > 0))
    priced = c("_priced")
    s2 = s1 + F.when(priced & close, 3.0).when(priced, -2.0).otherwise(0.0)
    s3 = s2 + F.when(F.coalesce(in_category, F.lit(False)), 1.0).otherwise(0.0)
    rows = rows.withColumn("_s4", s3 + F.when(F.coalesce(aligned, F.lit(False)), 3.5).otherwise(0.0))
    s4 = c("_s4")
    raw = F.when(rejected, REJECTED).otherwise(s4)
    shown = F.when(c("token_ratio") >= BYPASS, c("token_ratio")).otherwise(c("typo_ratio"))
    lists = lambda a, b: F.concat(F.array_join(a, ","), F.lit(" vs "), F.array_join(b, ","))
    why = (
        F.when(F.coalesce(form, F.lit(False)), F.concat(F.lit("Physical Form Conflict: "), c("weight_val.form"), F.lit(" vs "), c("c_weight_val.form")))
        .when(F.coalesce(package, F.lit(False)), F.concat(F.lit("Ice Cream Packaging Mismatch ("), p_in, F.lit(" vs "), p_cat, F.lit(")")))
        .when(brand, F.concat(F.lit("Brand Conflict: "), lists(c("entities.brand"), c("c_entities.brand"))))
        .when(flavor, F.concat(F.lit("Flavor Conflict: "), lists(c("entities.flavor"), c("c_entities.flavor"))))
    )
    notes = F.concat_ws(
        "; ",
        _note(bypass, F.concat(F.lit("Whole-SKU Fuzzy Match ("), _whole(F.bround(shown, 0)), F.lit("%)"))),
        *[_note(costs, F.concat(F.lit(f"{x.capitalize()} Penalty: "), lists(*_optional(pairs)[x]))) for x, costs in penalties.items()],
        _note(both & (gap < 1.0), F.concat(F.lit("Weight Match ("), _whole(c("weight_val.value")), F.when(weighed, ")").otherwise(") [Low Text Sim]"))),
        _note(both & (gap > 10.0), F.concat(F.lit("Weight Mismatch ("), _whole(c("weight_val.value")), F.lit(" vs "), _whole(c("c_weight_val.value")), F.lit(")"))),
        _note(priced & close, F.lit("Price Match")),
        _note(priced & ~close, F.lit("Price Mismatch")),
        _note(in_category, F.lit("Category Match Bonus")),
        _note(aligned, F.concat(F.lit("Predicted BT Alignment Boost (+3.5: "), c("predicted_bt"), F.lit(")"))),
    )
    gated = {"gate_raw": raw, "score": F.when(rejected, REJECTED).otherwise(probability(s4, bypass)), "status": F.when(rejected, "Rejected").otherwise(status(s4)), "notes": F.when(rejected, why).otherwise(notes)}
    new = [x for x in gated if x not in own]
    return rows.withColumns(gated).select(*own, *new)


def food_gates(pairs: DataFrame) -> DataFrame:
    """As ``market_gates``; entities.flavor and c_entities.flavor hold canonical flavors."""
    c = F.col
    near = c("token_ratio") >= BYPASS
    fi, fc = F.coalesce("entities.flavor", F.array().cast("array<string>")), F.coalesce("c_entities.flavor", F.array().cast("array<string>"))
    hi, hc = F.size(fi) > 0, F.size(fc) > 0
    rejected = hi & hc & ~F.arrays_overlap(fi, fc)
    same = F.lower(F.trim("predicted_bt")) == F.lower(F.trim("c_basictype"))
    typed = ~T.blank(c("predicted_bt")) & ~T.blank(c("c_basictype"))
    s1 = F.when(near, F.greatest(c("raw_score"), F.lit(100.0))).otherwise(c("raw_score"))
    s2 = F.when(hc & ~hi, F.least(s1, F.lit(3.5))).when(hi & ~hc, s1 - 2.0).otherwise(s1)
    s3 = s2 + F.when(typed & same, 2.0).when(typed, -3.0).otherwise(0.0)
    bypass = near & ~(hc & ~hi) & ~(typed & ~same)
    notes = F.concat_ws(
        "; ",
        _note(near, F.concat(F.lit("Whole-SKU Fuzzy Match ("), _whole(F.bround("token_ratio", 0)), F.lit("%)"))),
        _note(hc & ~hi, F.concat(F.lit("Flavor Mismatch: catalog has "), F.array_join(fc, ","), F.lit(", input unspecified"))),
        _note(hi & ~hc, F.concat(F.lit("Flavor Mismatch: input has "), F.array_join(fi, ","), F.lit(", catalog unspecified"))),
        _note(typed & same, F.concat(F.lit("BasicType Match ("), c("predicted_bt"), F.lit(")"))),
        _note(typed & ~same, F.concat(F.lit("BasicType Mismatch: catalog has '"), F.lower(F.trim("c_basictype")), F.lit("' vs predicted '"), c("predicted_bt"), F.lit("'"))),
    )
    why = F.concat(F.lit("Flavor Conflict: "), F.array_join(F.array_sort(fi), ","), F.lit(" vs "), F.array_join(F.array_sort(fc), ","))
    return pairs.withColumns({"gate_raw": F.when(rejected, REJECTED).otherwise(s3), "score": F.when(rejected, REJECTED).otherwise(probability(s3, bypass)), "status": F.when(rejected, "Rejected").otherwise(status(s3)), "notes": F.when(rejected, why).otherwise(notes)})
