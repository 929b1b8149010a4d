"""Sparse search with bounds, models in blocks, semantic dedup over long chains, occurrence numbers of hot names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuforge.operators import classify as G
from skuforge.operators import vectors as V

SIDE = "{} long, token string, weight double, kind string"


def _brute(q, c, k, same):
    out = {}
    for i, t, w, g in q:
        for u, s, v, h in c:
            if None not in (i, t, w, u, s, v) and s == t and (not same or (g is not None and g == h)):
                out.setdefault(i, {}).setdefault(u, 0.0)
                out[i][u] += w * v
    return {i: sorted(x.items(), key=lambda y: (-y[1], y[0]))[:k] for i, x in out.items()}


def _lengths(n, seed, low=0):
    """Rows whose weights differ by orders of magnitude, with repeated tokens, nulls and hot tokens."""
    rng = random.Random(seed)
    rows = [(k, f"t{int(rng.paretovariate(1.2))}", float(rng.randrange(low, 5)) * 4 ** (k % 5), rng.choice("ab")) for k in range(n) for _ in range(rng.randrange(1, 6))]
    kinds = {}
    rows = [(k, t, w, kinds.setdefault(k, g)) for k, t, w, g in rows]
    return rows + [(None, "t1", 1.0, "a"), (1, None, 1.0, "a"), (2, "t1", None, "a"), (3, "t1", 1.0, None)]


@pytest.mark.parametrize("same,low", [(None, 1), ("kind", 1), (None, -3)])
def test_sparse_top_k_with_bounds_equals_brute_force(spark, same, low):
    q, c = _lengths(40, 1, low), _lengths(150, 2, low)
    got = V.sparse_top_k(spark.createDataFrame(q, SIDE.format("query_id")), spark.createDataFrame(c, SIDE.format("uid")), 4, same, block=6, part_rows=40).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.uid, r.score))
    assert found == _brute(q, c, 4, same)


def test_sparse_top_k_of_empty_sides(spark):
    q, c = spark.createDataFrame(_lengths(3, 1), SIDE.format("query_id")), spark.createDataFrame(_lengths(3, 2), SIDE.format("uid"))
    assert V.sparse_top_k(q.limit(0), c, 3).count() == 0
    assert V.sparse_top_k(q, c.limit(0), 3).count() == 0


def test_bounds_skip_parts_of_short_rows(spark):
    """No row scores above its part's bound, and most pairs of query and part are below the k-th score."""
    c = spark.createDataFrame([(k, f"t{t}", float(4 ** (k % 6)), "a") for k in range(240) for t in range(k % 3, 12, 2)], SIDE.format("uid"))
    q = spark.createDataFrame([(k, f"t{t}", 1.0, "a") for k in range(20) for t in range(k % 2, 12, 3)], SIDE.format("query_id"))
    parts = V.posting_parts(c, None, 100)
    bounds = V.part_bounds(V._long_form(q, "query_id", None), parts)
    scores = V.sparse_scores(q, c).join(parts.select("uid", "band", "part").distinct(), "uid")
    assert scores.join(bounds, ["query_id", "band", "part"]).filter("score > bound").count() == 0
    least = V.top_k(V.sparse_scores(q, c), "query_id", "score", "uid", 5).filter("rank = 5").select("query_id", F.col("score").alias("least"))
    asked = bounds.join(least, "query_id")
    assert asked.filter("bound >= least").count() < asked.count() / 3


def test_allowed_scores_meet_only_allowed_pairs(spark):
    q, c = spark.createDataFrame(_lengths(20, 3), SIDE.format("query_id")), spark.createDataFrame(_lengths(60, 4), SIDE.format("uid"))
    every = V.sparse_scores(q, c)
    allowed = spark.range(20).select(F.col("id").alias("query_id")).join(spark.range(60).select(F.col("id").alias("uid")), (F.col("query_id") + F.col("uid")) % 3 == 0)
    rows = lambda df: sorted((r.query_id, r.uid, r.score) for r in df.filter("score IS NOT NULL").collect())
    assert rows(V.allowed_scores(q, c, allowed.unionByName(allowed))) == rows(every.join(allowed, ["query_id", "uid"], "left_semi"))


def test_softmax_best_in_blocks(spark):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(30, 4)) * 3, rng.normal(size=(25, 4))
    c[7] = c[3]  # a tie
    queries = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)] + [(99, None)], "query_id long, vector array<double>")
    classes = spark.createDataFrame([(f"c{k:02d}", x.tolist()) for k, x in enumerate(c)] + [("none", None)], "uid string, vector array<double>")
    got = {r.query_id: (r.uid, r.share) for r in V.softmax_best(queries, classes, block=7, part_rows=6).collect()}
    e = np.exp(q @ c.T)
    assert {k: v[0] for k, v in got.items()} == {k: f"c{x:02d}" for k, x in enumerate((q @ c.T).argmax(axis=1))}
    assert np.allclose([got[k][1] for k in range(30)], e.max(axis=1) / e.sum(axis=1))


def test_keyword_models_find_their_rows_and_predict_by_block(spark):
    """Each keyword is a half-space; a keyword's model must agree with it on nearly all rows, the constant one aside."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 5))
    tags = [[f"up{j}" for j in range(5) if x[j] > 0.3] + (["rare"] if x[0] > 1.5 else []) for x in v]
    rows = spark.createDataFrame([(k, x.tolist(), t) for k, (x, t) in enumerate(zip(v, tags, strict=True))], "uid long, vector array<double>, keywords array<string>")
    models = G.train_keyword_models(spark, rows)
    weights = {r.tag: np.array(r.weights) for r in models.collect()}
    assert set(weights) == {"up0", "up1", "up2", "up3", "up4", "rare"}
    found = {r.uid: (r.keywords, r.confidence) for r in G.predict_keywords(rows, models).collect()}
    p = {t: 1 / (1 + np.exp(-(v @ w[:-1] + w[-1]))) for t, w in weights.items()}
    for k in range(400):
        own = sorted((t for t in p if p[t][k] >= 0.5), key=lambda t: (-p[t][k], t))
        assert found.get(k, ([], None))[0] == own
        assert not own or abs(found[k][1] - np.mean([p[t][k] for t in own])) < 1e-9
    agree = [np.mean([(p[t][k] >= 0.5) == (t in tags[k]) for k in range(400)]) for t in p]
    assert min(agree) > 0.9


def test_levels_give_a_keyword_the_share_of_others_it_asks(spark):
    """Nothing is lost by meeting other rows by level: a model's rows equal those of the plain condition."""
    rows = spark.range(3000).select(F.col("id").alias("uid"), F.array(F.rand(1), F.rand(2)).alias("vector"), F.expr("CASE WHEN id % 3 = 0 THEN array('often') WHEN id % 100 = 1 THEN array('seldom') ELSE array() END").cast("array<string>").alias("keywords"))
    got = {(r.tag, r.y): r.n for r in G.keyword_samples(rows).groupBy("tag", "y").agg(F.count("*").alias("n")).collect()}
    h = rows.withColumn("h", F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) / float(1 << 20))
    counts = {t: rows.filter(F.array_contains("keywords", t)).count() for t in ("often", "seldom")}
    for t, n in counts.items():
        assert got[t, 1] == n
        assert got[t, 0] == h.filter((F.col("h") < min(1.0, 2.0 * n / 3000)) & ~F.array_contains("keywords", t)).count()


def _scan(n, edges):
    earlier = {}
    for a, b in edges:
        earlier.setdefault(b, set()).add(a)
    kept = set()
    for k in range(n):
        if not earlier.get(k, set()) & kept:
            kept.add(k)
    return sorted(kept)


def _chain_and_forks():
    rng = random.Random(7)
    forks = [(rng.randrange(k), k) for k in range(1, 60) for _ in range(rng.randrange(3))]
    tail = [(k, k + 1) for k in range(59, 90)]  # a chain that hangs on a row with several neighbours
    return 91, forks + tail


@pytest.mark.parametrize("seed", [1, 2])
def test_first_come_equals_the_scan(spark, seed):
    rng = random.Random(seed)
    n, edges = (200, [tuple(sorted(rng.sample(range(200), 2))) for _ in range(260)]) if seed == 1 else _chain_and_forks()
    got = V.first_come(spark.range(n).select(F.col("id").alias("uid")), spark.createDataFrame(edges, "a long, b long"))
    assert sorted(r.uid for r in got.collect()) == _scan(n, edges)


def test_a_chain_of_ten_thousand_links_takes_few_rounds(spark, monkeypatch):
    written, plain = [], V.checkpointed
    monkeypatch.setattr(V, "checkpointed", lambda df: written.append(1) or plain(df))
    got = V.first_come(spark.range(10001).select(F.col("id").alias("uid")), spark.range(10000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.agg(F.count("*"), F.max(F.col("uid") % 2), F.max("uid")).first()[:] == (5001, 0, 10000)
    assert (len(written) - 2) / 4 <= 30  # four tables a round


def test_templates_score_each_text_once(spark):
    """Inputs of one text share a template, and templates that become one text a score: work follows the distinct texts, and each input keeps its own best."""
    from skuforge.functions import similarity as S
    from skuforge.operators import templates as H

    kind = "name string, clean_text string, brand array<string>, flavor array<string>"
    rows = [(u, f"green bolt {u % 3}g", f"green bolt {u % 3}g", [], ["green"]) for u in range(600)]
    seen = spark.sparkContext.accumulator(0)
    plain = S.ratio

    def counted(a, b):
        from pyspark.sql import functions as F
        from pyspark.sql.types import DoubleType

        @F.pandas_udf(DoubleType())
        def run(x, y):
            import pandas as pd

            seen.add(len(x))
            return pd.Series([S.indel(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

        return run(a, b)

    inputs = spark.createDataFrame(rows, f"uid long, {kind}")
    catalog = spark.createDataFrame([(k, f"{w} bolt {k % 4}g", f"{w} bolt {k % 4}g", [], [w]) for k, w in enumerate(["red", "blue", "old", "hot"] * 50)], f"source_pos long, {kind}")
    try:
        H.S.ratio = counted
        got = {r.uid: (r.old_entity, r.source_pos, r.ratio) for r in H.best_templates(inputs, catalog).collect()}
    finally:
        H.S.ratio = plain
    texts = [(k, w) for k, w in enumerate(["red", "blue", "old", "hot"] * 50)]
    for u in range(600):
        ratio, k, w = min((-S.indel(f"green bolt {k % 4}g", f"green bolt {u % 3}g"), k, w) for k, w in texts)
        assert got[u] == (w, k, -ratio)
    assert 0 < seen.value < 100  # three texts with four, and their anchors, not 600 inputs with four
