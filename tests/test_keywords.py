"""Keywords of classified rows in both domains against lists made by hand; the similarity join and dense top-k against brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuforge.functions import similarity as S
from skuforge.operators import alike as A
from skuforge.operators import entities as D
from skuforge.operators import vectors as V
from skuforge.plans import classifier, matcher
from skuforge.plans import keywords as K
from skuforge.plans import tagging as P
from skuforge.sources.shared import settled


def flavors(spark, rows):
    return D.flavor_dictionary(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "source_pos long, name string, aliases string, is_meat boolean, is_vegetable boolean, is_seafood boolean"))


def brands(spark, names):
    return D.alias_dictionary(spark.createDataFrame([(k, n, "", False) for k, n in enumerate(names)], "source_pos long, name string, aliases string, is_weak boolean"), ["is_weak"])


@pytest.fixture(scope="module")
def food(spark):
    known = flavors(spark, [("chicken", "chiken", True, False, False), ("prawn", "", False, False, True), ("beef", "", True, False, False), ("egg", "", True, False, False), ("carrot", "", False, True, False)])
    return matcher.Tools(V.hashed_words(256), V.token_logit, "food", brands(spark, ["Nimal"]), known)


def rows_of(spark, rows):
    filled = [(u, name, desc, cat, bt, b, f, [0.0] * 256) for u, name, desc, cat, bt, b, f in rows]
    schema = "uid long, name string, description string, category string, bt string, brand array<string>, flavor array<string>, vector array<float>"
    return spark.createDataFrame(filled, schema)


def keywords(spark, rows, propagated, umbrella, maps, tools, trained=None):
    p = spark.createDataFrame(propagated, "uid long, propagated array<string>")
    u, m = (spark.createDataFrame(x, f"basictype string, {c} array<string>") for x, c in ((umbrella, "tags"), (maps, "keywords")))
    t = spark.createDataFrame(trained, "uid long, keywords array<string>, confidence double") if trained is not None else None
    k = K.keywords(spark, rows_of(spark, rows), p, u, m, tools, t)
    out = {r.uid: r for r in k.rows.collect()}
    told = {(r.uid, r.tag): r for r in K.decisions(k.considered, k.rows).collect()}
    return out, told


FOOD_MAP = [("Fried Rice", ["rice", "chicken fried rice", "prawn fried rice", "fried"]), ("Kottu", ["kottu", "street food"])]


def test_food_keywords_name_no_flavor_that_the_input_lacks(spark, food):
    rows = [(1, "Chicken Fried Rice", "", "", "Fried Rice", [], ["chicken"]), (2, "Fried Rice", "", "", "Fried Rice", [], []), (3, "Kottu rice", "", "", "Unmapped", [], ["beef"]), (4, "plain", "", "", None, [], [])]
    out, told = keywords(
        spark, rows, propagated=[(1, ["prawn mix", "spicy"]), (3, ["prawn mix"])], umbrella=[("Fried Rice", ["rice", "prawn rice"])], maps=FOOD_MAP, tools=food,
        trained=[(1, ["fried", "prawn fried rice", "street food"], 0.9), (2, ["fried"], 0.5), (3, ["kottu"], 0.95)],
    )
    # umbrella, propagated, literal (longest first), trained, then searched; no prawns; nothing of another type from the model
    assert out[1].gk == ["rice", "spicy", "chicken fried rice", "fried"] and out[1].gk_confidence == 0.9
    assert out[2].gk == ["rice", "fried"]
    # a type without a list: certain keywords alone, literal ones from all types, leaks unchecked, nothing searched; the model's confidence
    assert out[3].gk == ["prawn mix", "kottu", "rice"] and out[3].gk_confidence == 0.95
    assert out[4].gk == [] and out[4].gk_confidence == 0.0
    assert told[1, "prawn mix"].pruned == told[1, "prawn fried rice"].pruned == told[1, "prawn rice"].pruned == "names a flavor the input lacks"
    assert told[1, "street food"].pruned == "not of the type" and told[1, "rice"].selected
    assert told[1, "Chicken"].source == "synthetic" and told[1, "Chicken"].pruned == "not of the type"


def within():
    """A stand-in scorer, made here so that it goes to the workers by value: all words of the tag stand in the text, or not."""
    return lambda pairs: [4.0 if set(tag.lower().split()) <= set(text.lower().split()) else -1.0 for text, tag in pairs]


def test_market_keywords(spark, food):
    tools = matcher.Tools(V.hashed_words(256), within(), "market", food.brands, food.flavors)
    maps = [("Ice Cream", ["dessert", "Nimal Ice Cream", "tub"]), ("Juice", ["juice", "Ice Cream"])]
    rows = [(1, "Nimal ice cream tub", "sweet dessert", "Frozen", "Ice Cream", ["nimal"], []), (2, "juice of dessert", "", "", "Unmapped", [], [])]
    out, told = keywords(spark, rows, propagated=[(1, ["sweet"])], umbrella=[], maps=maps, tools=tools)
    # propagated, the type (a keyword of another type), literal, then reranked ones; 'dessert' is in the description alone
    assert out[1].gk[:4] == ["sweet", "Ice Cream", "Nimal Ice Cream", "tub"] and "dessert" in out[1].gk
    assert told[1, "dessert"].source == "search"
    assert told[1, "Nimal Frozen"].source == "synthetic" and told[1, "Nimal Frozen"].pruned == "not of the type"
    # a type without a list: all keywords may be named and searched
    assert out[2].gk[:2] == ["juice", "dessert"]
    plain = matcher.Tools(V.hashed_words(256), None, "market", food.brands, food.flavors)
    out, _ = keywords(spark, rows, propagated=[], umbrella=[], maps=maps, tools=plain)
    assert out[1].gk_confidence == 1.0 and "Nimal Frozen" in out[1].gk  # without a scorer made-up tags stay


def test_allowed_lists_enter_before_the_search(spark, food):
    # 60 keywords of another type are nearer than the type's own one, which must still be found
    maps = [("A", [f"red bolt {k}" for k in range(60)]), ("B", ["red ring"])]
    tools = matcher.Tools(V.hashed_words(256), lambda pairs: [1.0] * len(pairs), "market")
    out, _ = keywords(spark, [(1, "red bolt", "", "", "B", [], [])], [], [], maps, tools)
    assert out[1].gk == ["red ring"]


def test_food_names_are_enriched_and_misspelt_flavors_found(spark, food):
    rows = spark.createDataFrame([(1, "Chikken and prawn rice", "", ""), (2, "egg prawn", "", ""), (3, "beef chicken", "", ""), (4, "carrot rice", "", ""), (5, "rice", "with carrot", ""), (6, "beef egg", "", ""), (7, None, None, None)], "uid long, name string, description string, category string")
    assert {r.uid: r.name for r in matcher.enriched(rows, food).collect()} == {1: "Chikken and prawn rice", 2: "egg prawn", 3: "beef chicken mixed", 4: "carrot rice veg", 5: "rice veg", 6: "beef egg", 7: None}
    near = spark.createDataFrame([(1, "grilled chickin")], "uid long, text string")
    assert matcher._found(near, food, "uid").first().flavor == ["chicken"]


def test_food_plan_runs_whole(spark, food):
    catalog = [(0, "Nimal Chicken Fried Rice", "Fried Rice", "rice, chicken fried rice", "Lankan"), (1, "Nimal Prawn Fried Rice", "Fried Rice", "rice, prawn fried rice, seafood", "Lankan"), (2, "Beef Kottu", "Kottu", "kottu, street food", "Street")]
    catalog = spark.createDataFrame(catalog, "source_pos long, name string, basictype string, generic_keywords string, category string")
    inputs = spark.createDataFrame([(1, "Chiken Fried Rice", "", "")], "uid long, name string, description string, category string")
    row = P.classify(spark, inputs, catalog, food, []).first()
    assert row.bt == "Fried Rice" and "chicken fried rice" in row.gk
    assert not {"prawn fried rice", "seafood"} & set(row.gk) - {"seafood"} and "prawn fried rice" not in row.gk
    assert row.region == row.third_tag == "Lankan"
    assert classifier.classify(spark, inputs, catalog, food).rows.count() == 1


# the similarity join


def names(rng, n):
    words = ["red", "blue", "widget", "bolt", "gear", "spicy", "hot", "ring", "jar", "quix", "zeta", "a", "bb", "chicken rice", "é"]
    out = set()
    while len(out) < n:
        w = list(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))))
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice("aeiouxyz ")
        out.add("".join(w).strip())
    return sorted(out)


@pytest.mark.parametrize(("cutoff", "limit"), [(70.0, 10**6), (70.0, 60), (80.0, 30), (85.0, 20), (90.0, 10), (90.0, 10**6), (100.0, 5)])
def test_alike_equals_all_pairs(spark, monkeypatch, cutoff, limit):
    monkeypatch.setattr(A, "FEW", 0 if limit < 10**6 else 4000)
    monkeypatch.setattr(A.keys_of, "__defaults__", (limit, 0.0))
    monkeypatch.setattr(A.candidates, "__defaults__", (None, limit, 0.0))
    rng = random.Random(int(cutoff))
    a, b = names(rng, 150), [*names(rng, 120), "", "a", "aa", "aaa"]
    got = A.alike(spark.createDataFrame([(x,) for x in [*a, None, a[0]]], "t string"), spark.createDataFrame([(x,) for x in b], "c string"), "t", "c", cutoff)
    assert {(r._a, r._b): r.ratio for r in got.collect()} == {(x, y): S.indel(x, y) for x in a for y in set(b) if S.indel(x, y) >= cutoff}


def test_alike_with_a_second_requirement_loses_no_pair_that_meets_it(spark):
    rng = random.Random(11)
    a, b = names(rng, 120), names(rng, 120)
    got = A.alike(spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x,) for x in b], "c string"), "t", "c", 70.0, (85.0, 3.0))
    got = {(r._a, r._b) for r in got.collect()}
    for x in a:
        for y in b:
            if S.indel(x, y) >= 70 and S.lcs(x, y) >= 0.425 * (len(x) + len(y)) - 3:
                assert (x, y) in got


def test_no_common_character_is_a_key(spark, monkeypatch):
    monkeypatch.setattr(A, "FEW", 0)
    rng = random.Random(4)
    texts = spark.createDataFrame([("".join(rng.choice("aeiorst") for _ in range(8)) + f" {rng.randrange(10**6)} widget",) for _ in range(1500)], "text string")
    keys = A.keys_of(texts, 90.0, A.required(90.0), 40, 0.0)
    n = keys.filter("depth < least").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert keys.filter("depth < 5").count() and n <= 1500 * 0.1
    assert keys.filter("depth < least AND depth < 5").groupBy("key").count().filter("count > 40").count() == 0


# dense top-k


def test_dense_top_k_in_a_grid(spark):
    rng = np.random.default_rng(2)
    q, c = rng.integers(-3, 4, (23, 4)).astype(float), rng.integers(-3, 4, (71, 4)).astype(float)
    queries = spark.createDataFrame([(k, v.tolist(), "xyz"[k % 3]) for k, v in enumerate(q)], "query_id long, vector array<double>, kind string")
    corpus = spark.createDataFrame([(k, v.tolist(), "xyw"[k % 3]) for k, v in enumerate(c)], "uid long, vector array<double>, kind string")
    for same in (None, "kind"):
        for least in (None, 2.0):
            got = V.dense_top_k(spark, queries, corpus, 5, least, same, block=4, part_rows=9).collect()
            for k in range(23):
                score = {u: float(q[k] @ c[u]) for u in range(71) if not same or "xyz"[k % 3] == "xyw"[u % 3]}
                want = sorted(((u, s) for u, s in score.items() if least is None or s >= least), key=lambda x: (-x[1], x[0]))[:5]
                assert [(r.uid, r.score) for r in sorted((r for r in got if r.query_id == k), key=lambda r: r["rank"])] == want
    assert V.dense_top_k(spark, queries.limit(0), corpus, 5).count() == 0


def test_a_task_of_dense_top_k_does_not_grow_with_the_queries(spark):
    rows = lambda n, name: spark.range(n).selectExpr(f"id AS {name}", "array(cast(id as double), 1.0d) AS vector")
    most = {}
    for n in (200, 2000):
        q, c = V._grid(rows(n, "query_id"), rows(300, "uid"), None, 64, 64)
        most[n] = max(r["count"] for r in q.groupBy("_on", "part", "b").count().collect()), max(r["count"] for r in c.groupBy("_on", "part", "b").count().collect())
    assert most[2000][0] < 1.6 * 64 and most[2000][1] == most[200][1]


def _shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_equal_vectors_meet_once(spark):
    """Each row was copied for each block of the other side: two tables of 3,000 rows and seven vectors sent 198,004 records through shuffles."""
    rows = lambda name: spark.range(3000).selectExpr(f"id AS {name}", "array(cast(id % 7 as double), 1.0d) AS vector")
    before = _shuffled(spark)
    got = V.dense_top_k(spark, rows("query_id"), rows("uid"), 3, block=100, part_rows=100).collect()
    assert _shuffled(spark) - before < 40_000
    hits = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        hits.setdefault(r.query_id, []).append((r.uid, r.score))
    for k in range(3000):  # a vector's smallest rows come first
        score = [(u, float((k % 7) * (u % 7) + 1)) for u in range(3000)]
        assert hits[k] == sorted(score, key=lambda x: (-x[1], x[0]))[:3] if k < 50 else len(hits[k]) == 3


@pytest.mark.parametrize("same", [None, "kind"])
def test_dense_top_k_in_rounds_equals_brute_force(spark, monkeypatch, same):
    rng = np.random.default_rng(4)
    q, c = rng.integers(-2, 3, (60, 3)).astype(float), rng.integers(-2, 3, (90, 3)).astype(float)
    queries = spark.createDataFrame([(f"q{k}", v.tolist(), "xyz"[k % 3]) for k, v in enumerate(q)] + [("none", None, "x")], "query_id string, vector array<double>, kind string")
    corpus = spark.createDataFrame([(f"c{k:02d}", v.tolist(), "xyw"[k % 3]) for k, v in enumerate(c)] + [("none", None, "x")], "uid string, vector array<double>, kind string")
    whole = sorted(map(tuple, V.dense_top_k(spark, queries, corpus, 4, None, same).collect()))
    most, settled = [], V.settled
    monkeypatch.setattr(V, "settled", lambda df: most.append(df.columns) or settled(df))
    monkeypatch.setattr(V, "ROUND", 600)
    assert sorted(map(tuple, V.dense_top_k(spark, queries, corpus, 4, None, same, block=9, part_rows=11).collect())) == whole
    assert sum(x[0] == "_unit" for x in most) > 2  # rounds, each written
    for k in range(60):
        score = [(f"c{u:02d}", float(q[k] @ c[u])) for u in range(90) if not same or "xyz"[k % 3] == "xyw"[u % 3]]
        assert [(u, s) for i, u, s, _ in sorted(whole, key=lambda r: r[3]) if i == f"q{k}"] == sorted(score, key=lambda x: (-x[1], x[0]))[:4]


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    """They stayed until the driver collected garbage, so that a plan of many steps held all its shuffles on disk."""
    files = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split())
    settled(spark.range(1))
    before = files()
    settled(spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.collect_list("id").alias("ids")))
    for _ in range(50):
        left = {f for f in files() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.2)
    assert not left
