"""The whole plans: retrieval, gates, pools, classification, escalation, templates, rules and traces on a small catalog."""

from __future__ import annotations

import time

import pytest

from skuforge.operators import entities as D
from skuforge.operators import templates as H
from skuforge.operators import vectors as V
from skuforge.plans import classifier, matcher
from skuforge.plans import tagging as P

CATALOG = [
    (0, "Alerics Chocolate Ice Cream 1l", "Ice Cream Tub", "chocolate ice cream, dessert", 900.0, "Frozen"),
    (1, "Alerics Strawberry Ice Cream 1l", "Ice Cream Tub", "strawberry ice cream, dessert", 900.0, "Frozen"),
    (2, "Golden Basmati Rice 5kg", "Rice", "rice, basmati", 2500.0, "Grains"),
    (3, "Golden Basmati Rice 1kg", "Rice", "rice, basmati", 600.0, "Grains"),
    (4, "Smak Hot Spicy Mixture 150g", "Snack", "mixture, hot snack", 250.0, "Snacks"),
    (5, "Smak Mango Nectar 1l", "Juice", "nectar, mango juice", 400.0, "Drinks"),
]
INPUTS = [
    (1, "golden basmati rice 5kg", "Rice"), (2, "Rice Basmati Golden 1kg", "Rice"), (3, "Goldn Basmati Rice 5kg", "Rice"), (4, "Smak Hot Spicey Mixture 150g", ""),
    (5, "Alerics Vanilla Ice Cream 1l", ""), (6, "completely unknown gadget", ""), (7, "Smak Hot Spicy Mixture 400ml jar", ""), (8, "", ""),
]


@pytest.fixture(scope="module")
def tables(spark):
    catalog = spark.createDataFrame(CATALOG, "source_pos long, name string, basictype string, generic_keywords string, price double, category string")
    inputs = spark.createDataFrame([(u, n, 0.0, "", "", b, 0.9 if b else 0.0, "trained") for u, n, b in INPUTS], "uid long, name string, price double, description string, category string, predicted_bt string, bt_confidence double, bt_source string")
    names = lambda rows: spark.createDataFrame([(k, n, a, False) for k, (n, a) in enumerate(rows)], "source_pos long, name string, aliases string, is_weak boolean")
    brands = D.alias_dictionary(names([("Alerics", ""), ("Smak", ""), ("Golden", "Goldn")]), ["is_weak"])
    flavors = spark.createDataFrame([(0, "chocolate", "", False, False, False), (1, "strawberry", "", False, True, False), (2, "vanilla", "", False, False, False), (3, "mango", "", False, True, False)], "source_pos long, name string, aliases string, is_meat boolean, is_vegetable boolean, is_seafood boolean")
    tools = matcher.Tools(V.hashed_words(256), V.token_logit, "market", brands, D.flavor_dictionary(flavors))
    return inputs, catalog, tools


@pytest.fixture(scope="module")
def run(spark, tables):
    inputs, catalog, tools = tables
    final, trace = P.run(spark, inputs, catalog, tools, [])
    return {r.uid: r for r in final.collect()}, {r.uid: r for r in trace.collect()}


def test_match_goes_beyond_keys(spark, tables):
    rows = {r.uid: r for r in matcher.match(spark, *tables).collect()}
    assert len(rows) == len(INPUTS)
    assert (rows[1].matched_pos, rows[1].match_source) == (2, "exact") and (rows[2].matched_pos, rows[2].match_source) == (3, "token")
    # misspelt: no key, found by retrieval within the type, accepted by the gates
    assert (rows[3].matched_pos, rows[3].match_source, rows[3].status) == (2, "vector", "High Confidence")
    assert rows[3].logic_notes.startswith("BT-filtered: Whole-SKU Fuzzy Match") and "Weight Match (5000)" in rows[3].logic_notes
    assert (rows[4].matched_pos, rows[4].status) == (4, "High Confidence") and rows[4].logic_notes.startswith("Unfiltered: ")
    # a flavor that no ice cream has: rejected by the gate, tagged from a template
    assert rows[5].status == "High Confidence" and rows[5].bt == "Ice Cream Tub" and rows[5].score < 0.5
    assert rows[6].status in P.WEAK and rows[8].status in P.WEAK
    assert rows[7].status == "Rejected" and "Physical Form Conflict" in rows[7].logic_notes


def test_run_escalates_weak_rows(run):
    final, _ = run
    assert len(final) == len(INPUTS)
    assert not final[3].escalated and final[6].escalated and final[7].escalated
    assert all(r.pipeline_source == "Matcher" for u, r in final.items() if u <= 5)
    assert final[7].pipeline_source == "Classifier" and final[7].bt == "Snack" and "mixture" in final[7].gk
    assert final[7].logic_notes.startswith("Escalated from matcher [") and final[7].category == "Snacks"


def test_trace_agrees_with_the_plan(run):
    final, trace = run
    for u, t in trace.items():
        assert t.final.bt == final[u].bt and t.escalation.pipeline_source == final[u].pipeline_source
        if t["keys"].match_source == "vector":
            assert t.match.match_source == "vector" and (t.candidates is None) == (t.gates is None)
            best = {p: sorted((c.rerank_score for c in t.candidates or [] if c.pool == p), reverse=True)[:5] for p in ("filtered", "open")}
            for g in t.gates or []:
                assert g.raw_score in best[g.pool]
            if t.gates:
                assert t.match.matched_pos in {g.cand for g in t.gates}
        else:
            assert t.candidates is None and t.gates is None
    assert any(c.pool == "filtered" for c in trace[3].candidates) and all(c.pool == "open" for c in trace[4].candidates)
    tags = {k.tag: k for k in trace[7]["keywords"]}
    assert tags["mixture"].selected and tags["mixture"].pruned is None
    assert all((k.pruned is None) == k.selected for t in trace.values() for k in t["keywords"] or [])
    assert "rice" not in tags  # of another type: the type's list enters before the search
    made = [k for t in trace.values() for k in t["keywords"] or [] if k.source == "synthetic"]
    assert made and all(k.pruned == "not of the type" and not k.allowed for k in made)


def test_size_estimates_do_not_multiply_from_step_to_step(spark, tables):
    """Checkpoints keep their estimate, for a join a product: after the steps of a whole plan the planner multiplied numbers of thousands of digits."""
    inputs, catalog, tools = tables
    for out in P.run(spark, inputs, catalog, tools, []):  # the result, and its trace
        assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000


def test_classify_cascade(spark, tables):
    inputs, catalog, tools = tables
    trained = spark.createDataFrame([(1, "Juice", 0.9), (2, "Juice", 0.3)], "uid long, label string, confidence double")
    c = classifier.classify(spark, inputs, catalog, tools, trained=trained)
    rows = {r.uid: r for r in c.rows.collect()}
    assert len(rows) == len(INPUTS)
    assert (rows[1].bt, rows[1].bt_source, rows[1].third_tag, rows[1].third_source) == ("Juice", "trained", "Drinks", "override")
    assert rows[2].bt == "Rice" and rows[2].bt_source == "router"
    assert "rice" in rows[2].gk and rows[2].gk_confidence is not None and rows[2].reasoning.startswith("BT 'Rice' by router")


def test_templates_need_a_like_type_and_no_common_word(spark):
    text = lambda u, t, e: (u, t, t, [], [e])
    inputs = spark.createDataFrame([(*text(1, "beef biriyani", "beef"), "Biriyani"), (*text(2, "beef biriyani", "beef"), "Soft Drink"), (*text(3, "beef biriyani", "beef"), None)], "uid long, name string, clean_text string, brand array<string>, flavor array<string>, bt string")
    catalog = spark.createDataFrame([(*text(7, "chicken biryani", "chicken"), "Biryani", ["chicken biryani"])], "source_pos long, name string, clean_text string, brand array<string>, flavor array<string>, basictype string, keywords array<string>")
    assert {r.uid for r in H.best_templates(inputs, catalog).collect()} == {1, 3}  # anchors share no word; a type unlike the template's bars it
    assert {r.uid for r in H.best_templates(inputs.drop("bt"), catalog).collect()} == {1, 2, 3}


def test_long_aliases_and_canonical_sets(spark):
    names = spark.createDataFrame([(0, "One Two Three Four Five Six", ""), (1, "pepper", "black pepper")], "source_pos long, name string, aliases string")
    d = D.alias_dictionary(names)
    texts = spark.createDataFrame([(1, "the one two three four five six pack")], "uid long, text string")
    assert [r.canonical for r in D.scan(texts, d).collect()] == ["one two three four five six"]
    sets = spark.createDataFrame([(1, ["Black Pepper", "hot pepper sauce", "nothing"]), (2, []), (3, None)], "uid long, flavor array<string>")
    assert {r.uid: r.flavors for r in D.canonical_flavors(sets, d).collect()} == {1: ["pepper"], 2: [], 3: []}


def test_sparse_top_k_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    side = lambda n: [(k, f"t{t}", float(rng.randrange(-2, 5))) for k in range(n) for t in rng.sample(range(12), rng.randrange(1, 5))]
    q, c = side(30), side(80)
    got = V.sparse_top_k(spark.createDataFrame(q, "query_id long, token string, weight double"), spark.createDataFrame(c, "uid long, token string, weight double"), 5, block=7, part_rows=16).collect()
    for k in range(30):
        score = {}
        for _, t, w in (x for x in q if x[0] == k):
            for u, s, v in c:
                if s == t:
                    score[u] = score.get(u, 0.0) + w * v
        assert [(r.uid, r.score) for r in sorted((r for r in got if r.query_id == k), key=lambda r: r["rank"])] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_plans_leave_no_shuffle_files(spark, tables):
    """Steps' shuffles stayed on disk until the driver collected garbage, those of a whole plan and its trace beside each other."""
    inputs, catalog, tools = tables
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if f.startswith("shuffle_")}
    tools, before = matcher.written(tools), files()
    classifier.known(catalog, tools)
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
