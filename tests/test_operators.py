"""Matching, gates, classification, rules and templates on inline tables."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuforge.functions import similarity as S
from skuforge.operators import classify as G
from skuforge.operators import entities as D
from skuforge.operators import gates as GT
from skuforge.operators import matching as M
from skuforge.operators import reports
from skuforge.operators import rules as R
from skuforge.operators import taxonomy as X
from skuforge.operators import templates as H
from skuforge.operators import vectors as V

CATALOG = [(0, "Smak Hot & Spicy Mixture 200g", "Snack", "mixture, hot"), (1, "Smak Hot & Spicy Mixture 150g", "Snack", "mixture, hot"), (2, "Plain Rice", "Rice", "rice")]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "source_pos long, name string, basictype string, generic_keywords string")


def test_closest_weight_wins(spark):
    inputs = spark.createDataFrame([(1, "Smak Spicy & Hot Mixture 150G"), (2, "Smak Spicy Hot Mixture 100G"), (3, "smak hot mixture spicy"), (4, "unheard of"), (5, None)], "uid long, name string")
    rows = {r.uid: r for r in M.cascade(M.prepare(inputs), M.prepare(catalog(spark))).collect()}
    assert len(rows) == 5  # one row an input, matched or not
    assert rows[1].matched_pos == 1 and "Weight Match (150)" in rows[1].logic_notes
    assert rows[2].matched_pos == 1 and "Weight Mismatch (100 vs 150)" in rows[2].logic_notes
    assert rows[3].matched_pos == 0 and rows[3].logic_notes == "Fuzzy Match (100%)"
    assert rows[4].match_source == rows[5].match_source == "vector"


def test_type_guard_sends_known_text_to_the_vector_stage(spark):
    inputs = spark.createDataFrame([(1, "plain rice", "Snack", 0.9, "trained"), (2, "plain rice", "Snack", 0.45, "trained"), (3, "plain rice", "Snack", 0.45, "zero-shot"), (4, "plain rice", "RICE ", 0.9, "trained")], "uid long, name string, predicted_bt string, bt_confidence double, bt_source string")
    got = {r.uid: r.match_source for r in M.cascade(M.prepare(inputs), M.prepare(catalog(spark))).collect()}
    assert got == {1: "vector", 2: "exact", 3: "vector", 4: "exact"}


def gate_rows(spark, rows):
    weight = "struct<value:double,unit:string,form:string>"
    ent = "struct<brand:array<string>,flavor:array<string>>"
    schema = f"uid long, clean_text string, clean_no_weights string, weight_val {weight}, price double, category string, predicted_bt string, entities {ent}, c_clean_text string, c_clean_no_weights string, c_weight_val {weight}, c_price double, c_basictype string, c_generic_keywords array<string>, c_categories string, c_entities {ent}, raw_score double"
    return spark.createDataFrame(rows, schema)


def pair(uid, text, cand, w, cw, raw, ent=([], []), cent=([], []), price=0.0, c_price=0.0, bt="", c_bt=""):
    weigh = lambda v: None if v is None else (float(v), "g", "solid")
    return (uid, text, text, weigh(w), price, "", bt, ent, cand, cand, weigh(cw), c_price, c_bt, [], "", cent, raw)


def test_market_gates(spark):
    text = "smak hot spicy mixture"
    rows = [
        pair(1, text, "smak spicy bite", 150, 150, 2.0), pair(2, text, "smak spicy hot mixture", 150, 150, 2.0), pair(3, text, text, 150, 200, 3.0),
        pair(4, text, "lux soap bar", 150, 150, 3.0, (["smak"], []), (["lux"], [])), pair(5, "vanilla ice cream", "vanilla ice cream bar", 100, 500, 3.0),
        pair(6, "red bolts steel one", "blue bolts iron two", None, None, 1.0, bt="Bolt", c_bt="bolt"),
    ]
    got = {r.uid: r for r in GT.market_gates(GT.with_ratios(gate_rows(spark, rows))).collect()}
    assert "Low Text Sim" in got[1].notes and got[1].status != "High Confidence"
    assert "Weight Match (150)" in got[2].notes
    assert got[3].score == 1.0 and got[3].status == "High Confidence" and "Whole-SKU Fuzzy Match (100%)" in got[3].notes and "Weight Mismatch (150 vs 200)" in got[3].notes
    assert got[4].score == -10 and got[4].status == "Rejected" and got[4].notes.startswith("Brand Conflict")
    assert got[5].score == -10 and "Packaging" in got[5].notes
    assert got[6].gate_raw == 4.5 and got[6].score == pytest.approx(1 / (1 + np.exp(-0.55 * 4.5)), abs=1e-4)


def test_food_gates(spark):
    rows = [
        pair(1, "chicken rice", "beef rice", None, None, 3.0, ([], ["chicken"]), ([], ["beef"])), pair(2, "rice", "beef rice bowl", None, None, 9.0, ([], []), ([], ["beef"])),
        pair(3, "chicken rice", "rice bowl deal", None, None, 3.0, ([], ["chicken"]), ([], [])), pair(4, "egg rice", "rice egg", None, None, 1.0, bt="Rice", c_bt="Noodles"),
    ]
    got = {r.uid: r for r in GT.food_gates(GT.with_ratios(gate_rows(spark, rows))).collect()}
    assert got[1].score == -10 and got[2].gate_raw == 3.5 and got[3].gate_raw == 1.0
    assert got[4].gate_raw == 97.0 and "BasicType Mismatch" in got[4].notes


def test_neighbour_vote(spark):
    hits = [(1, "Oat Milk Barista", ["oat milk", "plant milk", "barista"], s) for s in (0.90, 0.85, 0.80)] + [(1, "Almond Milk", ["almond milk", "plant milk"], s) for s in (0.60, 0.50)]
    df = spark.createDataFrame([(q, k, bt, kw, s) for k, (q, bt, kw, s) in enumerate(hits)], "query_id long, uid long, basictype string, keywords array<string>, score double")
    best = G.neighbour_vote(df).first()
    assert best.label == "Oat Milk Barista" and best.confidence == pytest.approx(2.55 / 3.65)
    assert set(G.keyword_propagation(df).first().keywords) == {"oat milk", "plant milk", "barista"}


def test_centroids_and_tiers(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "class string, vector array<double>")
    q = spark.createDataFrame([(1, [0.95, 0.05])], "uid long, vector array<double>")
    got = G.centroid_predict(q, X.centroids(v), 0.05).first()
    assert got.label == "a" and got.confidence > 0.99
    seen = spark.createDataFrame([("few",)] * 5 + [("warm",)] * 25, "class string")
    known = spark.createDataFrame([("zero",), ("few",)], "class string")
    assert {r["class"]: r.tier for r in X.class_tiers(seen, known).collect()} == {"zero": "zero-shot", "few": "few-shot", "warm": "warm"}


def test_rule_conditions(spark):
    record = spark.createDataFrame([("Premium Vanilla Ice Cream 1L", "Ice Cream Tub", ["Dairy", "Ice Cream", "Vanilla"], "Colombo", "Frozen Desserts", 1500.0, None)], "sku_name string, bt string, gk array<string>, region string, category string, price double, visibility string")
    c = lambda t, v, g=1, n=0: {"condition_type": t, "value": v, "condition_group": g, "negate": n}
    fires = lambda *cs, logic="OR": record.select(R.fires(R.Rule("r", condition_logic=logic, conditions=list(cs)))).first()[0]
    assert fires(c("sku_contains", "vanilla")) and not fires(c("sku_contains", "chocolate")) and fires(c("sku_contains", "chocolate", n=1))
    assert fires(c("price_below", "2000")) and fires(c("price_above", "1000")) and not fires(c("price_below", "cheap", n=1))
    assert fires(c("sku_contains", "chocolate"), c("sku_contains", "vanilla")) and not fires(c("sku_contains", "vanilla"), c("price_below", "1000"))
    two = (c("sku_contains", "vanilla", 1), c("sku_contains", "chocolate", 2))
    assert fires(*two) and not fires(*two, logic="AND") and fires()
    assert fires(c("gk_contains", "ice cream")) and not fires(c("gk_contains", "ice"))


def test_rule_actions_in_order(spark):
    record = spark.createDataFrame([("Vanilla Icecream 1L", "Ice Cream Tub", None, None, None, None, None)], "sku_name string, bt string, gk array<string>, region string, category string, price double, visibility string")
    a = lambda t, v: {"action_type": t, "value": v}
    rules = [
        R.Rule("a", actions=[a("set_bt", "Ice Cream Tub"), a("normalize_sku", "nopipe")]),
        R.Rule("b", actions=[a("normalize_sku", "Icecream|Ice Cream")]),
        R.Rule("c", conditions=[{"condition_type": "sku_contains", "value": "ice cream"}], actions=[a("set_bt", "Tub"), a("add_gk", "Dessert"), a("set_visibility", "visible")]),
        R.Rule("d", actions=[a("add_gk", "Dessert"), a("remove_gk", "none")]),
    ]
    r = R.apply_rules(record, rules).first()
    assert (r.sku_name, r.bt, r.gk, r.visibility) == ("Vanilla Ice Cream 1L", "Tub", ["Dessert"], "visible")
    assert [(x.rule_id, x.change) for x in r.rules_applied] == [("b", "Normalized SKU 'Icecream' to 'Ice Cream'"), ("c", "BT changed to 'Tub'; Added GK 'Dessert'; Visibility set to 'visible'")]


def test_flavor_scan_longest_first(spark):
    d = spark.createDataFrame([(1, "chicken", "chicken breast", True, False, False), (2, "black pepper", None, False, True, False), (3, "pepper", None, False, True, False), (4, "prawn", None, False, False, True), (5, "shrimp", None, False, False, True)], "source_pos long, name string, aliases string, is_meat boolean, is_vegetable boolean, is_seafood boolean")
    texts = spark.createDataFrame([(1, "Grilled Chicken Breast with Black Pepper"), (2, "Fresh Shrimp Cocktail"), (3, "Plain White Plate"), (4, None), (5, "peppery chickens")], "uid long, text string")
    got = D.scan(texts, D.flavor_dictionary(d)).groupBy("uid").agg(F.array_sort(F.collect_set("canonical")).alias("f")).collect()
    assert {r.uid: r.f for r in got} == {1: ["black pepper", "chicken"], 2: ["prawn"]}


def test_fuzzy_dictionary_equals_a_full_comparison(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    a, b = words[:30], words[30:]
    for cutoff in (90.0, 80.0, 70.0):
        got = D.best_in_dictionary(spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x,) for x in b], "c string"), "t", "c", cutoff).collect()
        expected = {}
        for x in set(a):
            best = min((-S.indel(x, y), y) for y in b)
            if -best[0] >= cutoff:
                expected[x] = best[1]
        assert {r.t: r.c for r in got} == expected


def test_semantic_dedup_equals_the_scan(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    v[60:] = v[:60] + rng.normal(size=(60, 8)) * 0.3
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kept = []
    for k in range(120):
        if all(v[k] @ v[j] < 0.85 for j in kept):
            kept.append(k)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "uid long, vector array<double>")
    assert sorted(r.uid for r in V.semantic_dedup(spark, df).collect()) == kept


def test_semantic_dedup_of_copies_chains_and_missing_vectors(spark):
    copies = [(k, [1.0, 0.0]) for k in range(50)]  # one class of equal vectors
    angle = np.linspace(0.5, 1.5, 9)
    chain = [(100 + k, [float(np.cos(3 * a)), float(np.sin(3 * a))]) for k, a in enumerate(angle)]
    rest = [(200, None), (201, [0.0, 0.0]), (202, [0.0, 0.0]), (203, [0.1, 0.0]), (204, [0.1, 0.0])]  # near to nothing, themselves included
    rows = copies + chain + rest
    kept = []
    for k, x in rows:
        if x is None or all(y is None or np.dot(x, y) < 0.85 for _, y in kept):
            kept.append((k, x))
    df = spark.createDataFrame(rows, "uid long, vector array<double>")
    assert sorted(r.uid for r in V.semantic_dedup(spark, df).collect()) == sorted(k for k, _ in kept)
    assert V.semantic_dedup(spark, df.limit(0)).count() == 0


def test_near_pairs_in_blocks_and_strips(spark):
    v = np.random.default_rng(2).normal(size=(90, 4))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "uid long, vector array<double>")
    got = {(r.a, r.b) for r in V.near_pairs(df, 1.0, block=20, strip=7).collect()}
    assert got == {(a, b) for a in range(90) for b in range(a + 1, 90) if v[a] @ v[b] >= 1.0}


def test_nearest_label_ties_and_missing_vectors(spark):
    kind = "vector array<double>"
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [0.0, 0.0]), (4, None)], f"uid long, {kind}")
    labels = spark.createDataFrame([("b", [1.0, 0.0], [1.0, 0.0]), ("a", [5.0, 0.0], [0.0, -1.0]), ("c", [-1.0, 0.0], [0.0, 4.0]), ("d", None, None)], f"class string, {kind}, description_vector array<double>")
    assert sorted((r.uid, r.label, r.confidence) for r in G.zero_shot(rows, labels).collect()) == [(1, "a", 1.0), (2, "c", 1.0), (3, "a", 0.0)]
    assert G.zero_shot(rows.limit(0), labels).count() == 0 and G.zero_shot(rows, labels.limit(0)).count() == 0


def test_tags_snap_to_the_dictionary(spark):
    known = spark.createDataFrame([("gk", "Green Thing"), ("gk", "Goods"), ("bt", "Green Thingy")], "tag_type string, tag string")
    tags = [("gk", "goods", "green"), ("gk", "green things", "green"), ("bt", "goods", "green"), ("gk", "nothing like it", "green")]
    got = H.snap_tags(spark.createDataFrame(tags, "tag_type string, raw string, entity string"), known).collect()
    assert {(r.tag_type, r.raw): (r.tag, r.registered) for r in got} == {
        ("gk", "goods"): ("Goods", True), ("gk", "green things"): ("Green Thing", True), ("bt", "goods"): ("Goods", False), ("gk", "nothing like it"): ("Nothing Like It", False),
    }


def test_free_select_runs_no_commands(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "x int").createOrReplaceTempView("free")
    assert [r.x for r in reports.run_select(spark, "WITH y AS (SELECT x FROM free) SELECT x FROM y ORDER BY x DESC; ").collect()] == [2, 1]
    folder = f"{tmp_path}/out"
    insert = f"INSERT OVERWRITE DIRECTORY '{folder}' USING parquet SELECT * FROM y"
    for sql in (insert, f"WITH y AS (SELECT x FROM free) {insert}", "SELECT 1) AS q LIMIT 0; DROP VIEW free; SELECT (2", "drop view free"):
        with pytest.raises(ValueError):
            reports.run_select(spark, sql)
    assert not os.path.exists(folder) and spark.table("free").count() == 2


def test_rules_are_ranked_by_priority_then_shared_then_id(spark):
    rows = [("c", "shared", 2, True), ("b", "market", 1, True), ("a", "market", 1, True), ("d", "shared", 1, True), ("e", "food", 1, True), ("f", "market", 1, False)]
    df = spark.createDataFrame(rows, "rule_id string, domain string, priority int, is_active boolean")
    assert [(r["rank"], r.rule_id) for r in R.selected(df, "market").orderBy("rank").collect()] == [(1, "d"), (2, "a"), (3, "b"), (4, "c")]
    assert R.selected(df.limit(0), "market").count() == 0


def test_template_suggestions(spark):
    c = spark.createDataFrame([(0, "Alerics Chocolate Ice Cream 1l", "alerics chocolate ice cream 1000ml", "Ice Cream Tub", ["Chocolate Ice Cream", "Dessert"], [], ["chocolate"])], "source_pos long, name string, clean_text string, basictype string, keywords array<string>, brand array<string>, flavor array<string>")
    i = spark.createDataFrame([(1, "Alerics Vanilla Ice Cream 1l", "alerics vanilla ice cream 1000ml", [], ["vanilla"]), (2, "Alerics Chocolate Ice Cream 1l", "alerics chocolate ice cream 1000ml", [], ["chocolate"])], "uid long, name string, clean_text string, brand array<string>, flavor array<string>")
    d = spark.createDataFrame([("bt", "Ice Cream Tub"), ("gk", "Dessert"), ("gk", "Vanilla Ice-Cream")], "tag_type string, tag string")
    rows = H.suggest(i, c, d).collect()
    assert [(r.uid, r.suggested_bt, r.suggested_gk) for r in rows] == [(1, "Ice Cream Tub", ["Vanilla Ice-Cream", "Dessert"])]
    assert H.suggest(i, c, d.filter("tag = 'Dessert'"), True).first().suggested_gk == ["Vanilla Ice Cream", "Dessert"]


def test_missing_scorer(spark):
    df = spark.createDataFrame([("a", "b")], "l string, r string")
    assert V.rerank(df, "l", "r", None).first().rerank_score == -10.0 and V.rerank(df.limit(0), "l", "r", V.token_logit).count() == 0
