"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers as public

    import corpus_pipeline
    from skuforge.llm import byte_bpe, exact_dedup, simhash, toxicity
    from skuforge.llm.common import stage

    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns = table.columns
    model = toxicity.train(spark, table, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {r.doc_id: r.text or "" for r in table.collect()}
    docs = {i: t for i, t in docs.items() if toxicity.score(*model, t) < 0.5}
    last = {}
    for i in sorted(docs):
        last[exact_dedup_key(docs[i])] = i
    docs = {i: docs[i] for i in last.values()}
    prints = {i: simhash.fingerprint(t) for i, t in docs.items()}
    group = {}
    for i in sorted(docs):
        todo, group_of = [i], group.get(i, i)
        while todo:
            a = todo.pop()
            if a not in group:
                group[a] = group_of
                todo += [b for b in docs if b not in group and (prints[a] ^ prints[b]).bit_count() <= 3]
    kept = {i for i in docs if group[i] == i}
    v = byte_bpe.vocabulary(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)

    now = table
    for name, function in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, function(spark, now, SF), name.replace(" ", "-"))
        assert now.columns == columns
    assert {r.doc_id for r in now.collect()} == kept
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == kept
    for i in kept:
        ids = v.enc.encode_ordinary(docs[i])
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(docs[i].encode()).hexdigest()
    assert exact_dedup is not None


def test_mixture_survives_the_reread(spark):
    import corpus_pipeline
    from skuforge.llm import pfair_mixing
    from skuforge.llm.common import stage

    sizes = {"a": 2500, "b": 1200, "c": 300}
    rows = [(k, f"{s} {k} " + "x" * (k % 7) * 40, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    mixed = stage(spark, corpus_pipeline.mix_sources(spark, docs, SF), "mixing")
    got = {r.position: r.doc_id for r in corpus_pipeline.encode(spark, mixed, SF).collect()}
    assert sorted(got) == list(range(len(rows)))
    order = [got[k] for k in range(len(rows))]
    assert order == [r.doc_id for r in sorted(pfair_mixing.mix(spark, docs).collect(), key=lambda r: (r.slot, r.place))]
    counts = spark.createDataFrame(list(sizes.items()), "src string, n long")
    weights = {r.src: r.w for r in pfair_mixing.source_weights(counts, pfair_mixing.PARTS).collect()}
    seen = dict.fromkeys(sizes, 0)
    for k, i in enumerate(order, 1):
        seen[rows[i][2]] += 1
        if any(seen[s] == sizes[s] for s in sizes):
            break
        for s, w in weights.items():
            assert abs(seen[s] - k * w / sum(weights.values())) < 2 * pfair_mixing.BLOCK_ROWS
    assert k > 1000


def test_rows_go_and_stay_one_by_one(spark):
    import corpus_pipeline
    from skuforge.llm.common import stage

    words = [f"word{k}" for k in range(60)]
    text = lambda k: " ".join(words[(k * 7 + j * j * (k + 3)) % 60] for j in range(40))
    rows = [(None, "same"), (None, "Same"), (None, "kept"), (7, "KEPT"), (None, "kept"), (1, text(1)), (1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(4))]
    docs = stage(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), "docs")
    for read in (docs, spark.createDataFrame(rows, "doc_id long, text string")):  # read from files or not
        got = sorted(((r.doc_id or 0), r.text.lower()) for r in corpus_pipeline.drop_copies(spark, read, SF).collect())
        assert got == sorted([(0, "same"), (7, "kept"), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(4))])
    # the prints ignore case and white space: near copies with and without ids, and ids on two unlike texts
    near = [(None, text(1)), (None, text(1).upper()), (None, text(2)), (5, text(2).replace(" ", "  ")), (3, text(3)), (3, text(4)), (4, text(4).upper()), (6, text(5)), (6, text(5) + " ")]
    got = sorted(((r.doc_id or 0), " ".join(r.text.lower().split())) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(near, "doc_id long, text string"), SF).collect())
    assert got == sorted([(0, text(1)), (5, text(2)), (3, text(3)), (3, text(4)), (6, text(5))])


def test_stages_take_any_rows(spark):
    import corpus_pipeline
    from skuforge.llm.common import stage

    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, position long, slot string, digest string, component_id string, toxicity_score string"
    own = (1, 2, "s", "d", "c", "t")
    long = "word one two three\n" * 20000
    rows = [(i, t, None, s, None, *own) for i, t, s in [(1, "one text", "a"), (1, "one text", "a"), (None, None, None), (None, "", "a"), (2**60 + 1, long, "b"), (2**60 + 3, long + " ", "b"), (None, "lonely words here", None)]]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, function in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, function(spark, docs, SF), name.replace(" ", "-"))
            assert docs.columns == spark.createDataFrame([], schema).columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        if not given:
            assert last == []
            continue
        left = docs.collect()
        assert sorted((r.doc_id or 0) for r in left) == sorted((r.doc_id or 0) for r in last)
        # one of the two alike, one of the empty ones, one of the two long ones, and the last
        assert {(r.doc_id, (r.text or "")[:6]) for r in left} in ({(1, "one te"), (None, ""), (k, "word o"), (None, "lonely")} for k in (2**60 + 1, 2**60 + 3)) and len(left) == 4
        assert sorted(r.position for r in last) == [0, 1, 2, 3]


def exact_dedup_key(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
