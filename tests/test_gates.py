"""Market gates: zero weights and the optional entities."""

import pytest
from pyspark.sql import functions as F

from skuforge.operators import gates as GT
from skuforge.sources import shared

SIDE = "struct<brand:array<string>,flavor:array<string>,variant:array<string>,`active ingredient`:array<string>>"
WEIGHT = "struct<value:double,unit:string,form:string>"


def _pairs(spark, rows, c_side=SIDE):
    """uid, text, candidate, weight, candidate's weight, variants, ingredients, the candidate's entities."""
    weigh = lambda v: None if v is None else (float(v), "g", "solid")
    full = [(u, t, t, weigh(w), 5.0, "", "", ([], [], v, i), c, c, weigh(cw), 5.0, "", [], "", e, 1.0) for u, t, c, w, cw, v, i, e in rows]
    side = "clean_text string, clean_no_weights string, weight_val " + WEIGHT
    return spark.createDataFrame(full, f"uid long, {side}, price double, category string, predicted_bt string, entities {SIDE}, "
        f"c_clean_text string, c_clean_no_weights string, c_weight_val {WEIGHT}, c_price double, c_basictype string, c_generic_keywords array<string>, c_categories string, c_entities {c_side}, raw_score double")  # fmt: skip


def test_zero_weights_agree_whatever_the_texts(spark):
    rows = [(1, "red bolts steel", "a blue iron nut", 0, 0, [], [], ([], [], [], [])), (2, "red bolts steel", "a blue iron nut", 7, 7, [], [], ([], [], [], []))]
    got = {r.uid: r for r in GT.market_gates(GT.with_ratios(_pairs(spark, rows))).collect()}
    assert got[1].gate_raw == 1.0 + 2.0 + 3.0 and got[1].notes == "Weight Match (0); Price Match"
    assert got[2].gate_raw == 1.0 and got[2].notes == "Weight Match (7) [Low Text Sim]"


def test_optional_entities_cost_three_each(spark):
    text, other = "rose soap with zinc", "lily candle and iron"
    rows = [
        (1, text, other, None, None, ["rose"], ["zinc"], ([], [], ["lily"], ["iron"])),
        (2, text, other, None, None, ["rose"], [], ([], [], ["rose"], [])),
        (3, text, other, None, None, ["rose"], None, ([], [], [], None)),  # alone, and not in the other's text
        (4, text, text, None, None, ["rose"], ["zinc"], ([], [], ["lily"], ["iron"])),  # texts alike: no checks
    ]
    got = {r.uid: r for r in GT.market_gates(GT.with_ratios(_pairs(spark, rows))).collect()}
    assert [got[k].gate_raw for k in (1, 2, 3, 4)] == [-5.0, 1.0, -2.0, 100.0]
    assert got[1].notes == "Variant Penalty: rose vs lily; Active ingredient Penalty: zinc vs iron" and got[1].status == "Low / Rejected"


def test_an_optional_entity_of_one_side_only(spark):
    rows = [(1, "rose soap", "lily candle", None, None, ["rose"], [], ([], [])), (2, "rose soap", "candle of roses", None, None, ["rose"], [], ([], []))]
    got = {r.uid: r.gate_raw for r in GT.market_gates(GT.with_ratios(_pairs(spark, rows, "struct<brand:array<string>,flavor:array<string>>"))).collect()}
    assert got == {1: -2.0, 2: 1.0} == pytest.approx(got)


def test_market_gates_compile(spark):
    """Written as one expression, their code outgrew what the JVM compiles, and ran interpreted after a failed attempt."""
    weight = F.when(F.col("uid") >= 0, F.struct(F.col("uid").cast("double").alias("value"), F.lit("g").alias("unit"), F.lit("solid").alias("form")))
    rows = shared.checkpointed(
        spark.range(3).select(
            F.col("id").alias("uid"), F.concat(F.lit("red bolt "), "id").alias("clean_text"), F.lit("red bolt 1").alias("c_clean_text"), F.lit(50.0).alias("token_ratio"), F.lit(60.0).alias("typo_ratio"),
            F.lit("Match").alias("brand_check"), F.lit("Neutral").alias("flavor_check"), F.lit(3.0).alias("price"), F.lit(4.0).alias("c_price"), F.lit("").alias("category"), F.lit("tools").alias("c_categories"),
            F.lit("Bolt").alias("predicted_bt"), F.lit("bolt").alias("c_basictype"), F.array(F.lit("bolt")).alias("c_generic_keywords"), F.col("id").cast("double").alias("raw_score"),
            F.struct(F.array(F.lit("a")).alias("brand"), F.array(F.lit("b")).alias("flavor")).alias("entities"), F.struct(F.array(F.lit("a")).alias("brand"), F.array(F.lit("b")).alias("flavor")).alias("c_entities"),
        ).withColumns({"weight_val": weight, "c_weight_val": weight})
    )
    only = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    for k, v in only.items():
        spark.conf.set(k, v)
    try:
        got = GT.market_gates(rows).orderBy("uid").collect()
    finally:
        for k in only:
            spark.conf.unset(k)
    assert [r.gate_raw for r in got] == [8.5, 4.5, 5.5] and got[1].notes == "Weight Match (1) [Low Text Sim]; Predicted BT Alignment Boost (+3.5: Bolt)"
