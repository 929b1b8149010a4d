"""Work that follows distinct texts and measured sizes, not rows and files."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuforge.functions import similarity as S
from skuforge.operators import entities as D
from skuforge.operators import matching as M
from skuforge.operators import vectors as V
from skuforge.plans import classifier, matcher, registry
from skuforge.sources import shared, sinks


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normalized_computes_its_vector_once(spark):
    made = S.normalized(F.transform(F.col("base"), lambda x: x * 2))
    assert str(made).count("base") == 1
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "k long, base array<double>")
    assert {r.k: r.v for r in rows.select("k", made.alias("v")).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: []}


def test_scan_meets_each_text_once(spark):
    d = D.alias_dictionary(spark.createDataFrame([(0, "red ring", "crimson"), (1, "bolt", "")], "source_pos long, name string, aliases string"))
    texts = spark.createDataFrame([(u, ["Red ring bolt", "crimson", "none", None][u % 4]) for u in range(40)], "uid long, text string")
    found = D.scan(texts, d)
    lines = _plan(found).splitlines()
    first = min(k for k, x in enumerate(lines) if "Generate posexplode" in x)
    assert any("Aggregate [_t" in x for x in lines[first:])  # below the words
    got = {}
    for r in found.collect():
        got.setdefault(r.uid, []).append((r.at, r.alias, r.canonical))
    want = [[(0, "red ring", "red ring"), (2, "bolt", "bolt")], [(0, "crimson", "red ring")], None, None]
    assert {u: sorted(x) for u, x in got.items()} == {u: want[u % 4] for u in range(40) if want[u % 4]}


def test_token_matches_meet_each_key_once(spark):
    names = ["ring red 5g", "red ring", "bolt 7g", "5g ring red", "nothing"]
    inputs = M.prepare(spark.createDataFrame([(u, names[u % 5]) for u in range(50)], "uid long, name string"))
    catalog = M.prepare(spark.createDataFrame([(0, "red ring 9g", "A"), (1, "red ring 5g", "A"), (2, "bolt", "B"), (3, "red ring 5g", "B")], "source_pos long, name string, basictype string"))
    out = M.token_matches(inputs, catalog)
    lines = _plan(out).splitlines()
    assert any("Aggregate [token_key" in x and "weight_val" in x and "uid" not in x and "min(" not in x for x in lines)
    by = {0: (1, "Weight Match (5)"), 1: (0, ""), 2: (2, ""), 3: (1, "Weight Match (5)")}
    assert {r.uid: (r.token_pos, r.weight_note) for r in out.collect()} == {u: by[u % 5] for u in range(50) if u % 5 in by}


def test_small_files_of_many_rows_are_not_broadcast(spark, tmp_path):
    spark.range(400_000).select(F.col("id").alias("k"), F.lit("x" * 200).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "part.parquet").iterdir())
    assert size < 8 << 20
    df = registry._query(lambda s: s.base("part").select("k").join(s.base("part"), "k"))(spark, str(tmp_path))
    assert "SortMergeJoin" in df._jdf.queryExecution().sparkPlan().toString()


def test_history_export_cuts_ties_by_the_other_columns(spark):
    rows = spark.createDataFrame([(1, "z"), (2, "d"), (2, "b"), (2, "c"), (2, "a"), (3, "y")], "id long, sku_name string").repartition(3)
    assert sorted(map(tuple, sinks.export_history(rows, newest=3).collect())) == [(2, "a"), (2, "b"), (3, "y")]


def test_scores_of_pairs_are_added_up_where_their_words_are(spark):
    from skuforge.plans import cases_match
    from skuforge.plans.samples import Samples

    class Few(Samples):
        def base(self, name):
            df = spark.createDataFrame([(k, f"some words and more words {k}") for k in range(20)], f"{'item_id' if name == 'benchmark' else 'doc_id'} long, text string")
            return df.hint("broadcast") if name == "benchmark" else df

    scores = cases_match._pair_scores(Few(spark, ""))
    assert "hashpartitioning(query_id" not in scores._jdf.queryExecution().executedPlan().toString().replace("query_id#", "query_id")
    assert {(r.query_id, r.uid): r.score for r in scores.collect()} == {(a, b): 7.0 for a in range(20) for b in range(20)}


def test_names_are_cleaned_once_each(spark):
    rows = spark.createDataFrame([(u, ["Red ring 5g", "BOLT 2 x 7g", "", None][u % 4]) for u in range(40)], "uid long, name string")
    out = M.prepare(rows)
    assert any("Aggregate [" in x and "name#" in x and "uid#" not in x for x in _plan(out).splitlines())
    got = {r.uid: (r.name, r.clean_text, r.clean_no_weights, r.weight_val and r.weight_val.value, r.token_key) for r in out.collect()}
    assert len(got) == 40 and out.columns == ["uid", "name", "clean_text", "clean_no_weights", "weight_val", "token_key"]
    assert {u: x for u, x in got.items()} == {u: got[u % 4] for u in range(40)}
    assert got[0] == ("Red ring 5g", "red ring 5g", "red ring", 5.0, "red ring") and got[3][0] is None


def test_ratios_of_pairs_are_computed_once_each(spark):
    from skuforge.operators import gates as GT

    side = "{0}clean_text string, {0}clean_no_weights string, {0}entities struct<brand:array<string>,flavor:array<string>>"
    kinds = [("red ring 5g", "red ring", (["acme"], []), "ring red", "ring red", (["acme"], ["red"])), ("bolt", "bolt", ([], None), None, None, None), (None, None, None, "nut", "nut", ([], ["blue"]))]
    pairs = spark.createDataFrame([(u, *kinds[u % 3]) for u in range(30)], f"uid long, {side.format('')}, {side.format('c_')}")
    out = GT.with_ratios(pairs)
    lines = _plan(out).splitlines()
    first = max(k for k, x in enumerate(lines) if "ArrowEvalPython" in x)
    assert any("Aggregate [" in x and "uid" not in x for x in lines[first:])  # below the ratios
    got = {r.uid: tuple(r)[-4:] for r in out.collect()}
    assert got == {u: got[u % 3] for u in range(30)} and len(got) == 30
    assert got[0] == (100.0, 100.0, "Match", "Match") and got[1] == (None, None, "Neutral", "Neutral") and got[2] == (None, None, "Neutral", "Conflict")


def test_inputs_that_ask_alike_share_their_candidates(spark):
    from skuforge.operators import vectors as V
    from skuforge.plans import matcher

    kinds = [("red acme ring", "Ring", 0.9, ["acme"]), ("red acme ring", "Ring", 0.1, ["acme"]), ("red acme ring", None, None, []), ("blue bolt", "ring", 0.9, []), ("", None, None, [])]
    rest = spark.createDataFrame([(u, *kinds[u % 5][:3], "trained", kinds[u % 5][3]) for u in range(20)], "uid long, clean_text string, predicted_bt string, bt_confidence double, bt_source string, brand array<string>")
    catalog = spark.createDataFrame([(0, "red ring", "Ring"), (1, "blue ring", "Ring"), (2, "blue bolt big", "Bolt"), (3, "acme bolt", "Bolt")], "source_pos long, clean_text string, basictype string")
    tools = matcher.Tools(V.hashed_words(), V.token_logit)
    units = matcher.with_units(rest)
    assert {r.uid: r.unit for r in units.collect()} == {u: u % 5 for u in range(20)}
    every = matcher.candidates(spark, rest, catalog, tools)
    shared = matcher.candidates(spark, units.filter("uid = unit"), catalog, tools)
    assert {r.uid for r in shared.select("uid").collect()} == {0, 1, 2, 3}
    assert sorted(matcher.of_inputs(shared, units).collect()) == sorted(every.collect()) and every.count() > 20


def test_tasks_of_words_and_postings_grow_in_number(spark, monkeypatch):
    from skuforge.operators import vectors as V
    from skuforge.plans import cases_match

    monkeypatch.setattr(cases_match, "TASK_TEXT", 100)
    monkeypatch.setattr(V, "TASK_POSTINGS", 10)
    docs = spark.createDataFrame([(k, "some words and more words") for k in range(40)] + [(40, None), (7, "words")], "doc_id long, text string")
    counts = cases_match._counts(docs, "doc_id", "uid")
    assert counts.rdd.getNumPartitions() == -(-(40 * 25 + 5) // 100)
    assert {r.uid: r.weight for r in counts.filter("token = 'words'").collect()} == {k: 3.0 if k == 7 else 2.0 for k in range(40)}
    parts = V.posting_parts(counts)
    assert "hashpartitioning(uid" not in parts._jdf.queryExecution().executedPlan().toString()  # written before
    assert parts.count() == 160 and parts.select("uid", "band", "part").distinct().count() == 40
    sizes = []
    kept = V.checkpointed
    monkeypatch.setattr(V, "checkpointed", lambda df: sizes.append((out := kept(df)).rdd.getNumPartitions()) or out)
    V.posting_parts(counts)
    assert sizes == [11, 16]


def test_best_columns_are_those_of_a_stable_sort():
    draw = np.random.default_rng(7)
    ties = draw.integers(-3, 4, (40, 30)).astype(float)
    holes = np.where(draw.random((40, 30)) < 0.5, np.nan, ties)
    holes[0] = np.nan
    for score in (draw.random((40, 30)), ties, holes, np.zeros((3, 9)), np.zeros((0, 9)), ties[:, :1]):
        for k in (1, 5, 29, 30, 2**31 - 1):
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            rows, columns = V.best_columns(score, k)
            assert columns.tolist() == best.ravel().tolist() and rows.tolist() == np.repeat(np.arange(len(score)), best.shape[1]).tolist()


def test_steps_run_at_the_same_time_and_fail_as_they_would_alone(spark):
    meet = threading.Barrier(2, timeout=60)
    assert shared.together(lambda: (meet.wait() >= 0, 1)[1], lambda: (meet.wait() >= 0, spark.range(3).count())[1]) == [1, 3]
    with pytest.raises(ZeroDivisionError):
        shared.together(lambda: 1, lambda: 1 / 0)


def test_classification_encodes_each_distinct_text_once(spark):
    seen = spark.sparkContext.accumulator(0)
    plain = V.hashed_words()

    def encoder(texts):
        seen.add(sum(t.startswith("odd thing") for t in texts))
        return plain(texts)

    names = spark.createDataFrame([(0, "ring", "", False)], "source_pos long, name string, aliases string, is_weak boolean")
    flavors = spark.createDataFrame([(0, "red", "", False, False, False)], "source_pos long, name string, aliases string, is_meat boolean, is_vegetable boolean, is_seafood boolean")
    tools = matcher.Tools(encoder, None, "market", D.alias_dictionary(names, ["is_weak"]), D.flavor_dictionary(flavors))
    inputs = spark.createDataFrame([(u, f"odd thing {u % 4}") for u in range(12)], "uid long, name string")
    catalog = spark.createDataFrame([(k, f"red ring {k}", "Ring", "ring, red") for k in range(6)], "source_pos long, name string, basictype string, generic_keywords string")
    assert classifier.classify(spark, inputs, catalog, tools).rows.count() == 12
    assert seen.value == 4


def test_begun_steps_run_beside_what_follows(spark):
    go = threading.Event()
    rows = shared.begun(lambda: go.wait(60) and spark.range(3).count())
    lost = shared.begun(lambda: 1 / 0)
    go.set()  # reached before the first step ends
    assert rows() == 3 and rows() == 3
    with pytest.raises(ZeroDivisionError):
        lost()


def test_settled_tables_forget_what_they_were_joined_of(spark):
    rows = spark.range(4).select("id", F.array(F.lit(None).cast("string")).alias("a"), F.struct(F.lit("x").alias("b")).alias("s"))
    for _ in range(6):
        rows = shared.settled(rows.join(rows.select("id", F.col("a").alias("_a")), "id").drop("_a"))
    assert sorted((r.id, r.a, r.s.b) for r in rows.collect()) == [(k, [None], "x") for k in range(4)]
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40
