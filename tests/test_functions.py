"""Fixture tables of cleaning functions, and similarities against plain dynamic programming."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skuforge.functions import similarity as S
from skuforge.functions import text as T

WEIGHTS = [
    ("Anchor Butter 250g", 250.0, "g", "solid"), ("Fresh Milk 1L", 1000.0, "ml", "liquid"), ("Olive Oil 500ml", 500.0, "ml", "liquid"), ("Basmati Rice 5kg", 5000.0, "g", "solid"),
    ("Sugar 1.5kg", 1500.0, "g", "solid"), ("Yogurt 100 g", 100.0, "g", "solid"), ("Vanilla Essence 50 ml", 50.0, "ml", "liquid"), ("Cream 25cl", 250.0, "ml", "liquid"), ("Salt 750mg", 0.75, "g", "solid"),
]


def test_weights(spark):
    df = spark.createDataFrame([(w[0],) for w in WEIGHTS], "name string")
    got = df.select("name", T.extract_weight(F.col("name")).alias("w")).collect()
    assert {(r.name, round(r.w.value, 6), r.w.unit, r.w.form) for r in got} == set(WEIGHTS)
    assert df.limit(1).select(T.extract_weight(F.lit("no weight")).alias("w")).first().w is None


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("4 x 100g", "400g"), ("100g x 4", "400g"), ("Tea 100g - 200g", "tea"), ("Milk 1.5 Liters", "milk 1500ml"), ("pack of 6 eggs", "6pc eggs"), ("6 pcs", "6pc"), ("Salt 750mg", "salt 0g"), (None, ""), ("", "")],
)
def test_standard_units(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "x string")
    assert " ".join(df.select(T.standardize_units(F.col("x"))).first()[0].split()) == clean


@pytest.mark.parametrize(
    ("raw", "title"),
    [("ice cream tub with chocolate", "Ice Cream Tub with Chocolate"), ("non-dairy ice-cream and milk", "Non-Dairy Ice-Cream and Milk"), ("with milk and sugar", "With Milk and Sugar")],
)
def test_title_case(spark, raw, title):
    assert spark.createDataFrame([(raw,)], "x string").select(T.title_case(F.col("x"))).first()[0] == title


def test_dish_conflicts(spark):
    rows = [("Chop Suey Rice", True), ("Vegetable Chop Suey Rice", True), ("Chicken Biriyani", True), ("Devilled Fish Fried Rice", False), ("Fish Fried Rice", False), ("Seafood Fried Rice", False), ("Set Menu", False), ("Seafood", False)]
    df = spark.createDataFrame(rows, "tag string, expected boolean")
    got = df.select("tag", "expected", T.conflicting_dish(F.col("tag"), F.lit("Fried Rice")).alias("c")).collect()
    assert all(r.c == r.expected for r in got)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_ratio_against_plain_lcs():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        n = len(a) + len(b)
        assert S.indel(a, b) == pytest.approx(200 * plain_lcs(a, b) / n if n else 100)
    assert S.indel("", "") == 100 and S.indel("a", "") == 0 and S.partial("bolt", "a red bolt") == 100
    assert S.token_sort("hot and spicy", "spicy and hot") == 100
    assert S.typo_aligned("choclate bar", "chocolate bar") == 100


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([("A", 1.0), ("b", None), ("b", None)], "n string, p double")
    one, two = (T.dataset_fingerprint(x, ["n"], "p").first() for x in (df, df.orderBy("p")))
    assert one == two and one != T.dataset_fingerprint(df.limit(2), ["n"], "p").first()
