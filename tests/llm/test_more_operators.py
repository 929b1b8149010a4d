"""Operators 11 to 13, row ids and numbers on small tables with nulls, ties, repeats, long texts, clashing columns and no rows, against brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuforge.llm import conversation_trie, periodic_runs, sharding
from skuforge.llm.common import new_path, numbered, row_ids

SCHEMA = "doc_id long, text string, shard string, slot string, row string, place string, _hash string, _id string, start string, key string"


def doc(doc_id, text):
    return (doc_id, text, "s", "l", "r", "p", "h", "i", "t", "k")


# row ids and numbers


def test_row_ids_and_numbers_follow_the_written_order(spark):
    path = new_path(spark, "rows")
    spark.range(5000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    rows = spark.read.parquet(path)
    got = {r.id: (r.rid, r.n) for r in row_ids(spark, rows, "rid").join(numbered(spark, rows, "n"), "id").collect()}
    assert [got[k][1] for k in range(5000)] == list(range(5000))
    assert [got[k][0] for k in range(5000)] == sorted(x for x, _ in got.values()) and len({x for x, _ in got.values()}) == 5000
    assert sorted(r.n for r in numbered(spark, spark.range(10), "n").collect()) == list(range(10))  # not from files
    assert numbered(spark, spark.range(0), "n").count() == 0


def test_row_ids_of_files_whose_numbers_repeat(spark):
    path = new_path(spark, "rows")
    for k in range(2):  # two writers, so part numbers stand twice
        spark.range(k * 100, k * 100 + 100).repartition(2).write.mode("append").parquet(path)
    assert row_ids(spark, spark.read.parquet(path), "rid").select("rid").distinct().count() == 200


def test_numbers_bring_no_forced_broadcast(spark):
    path = new_path(spark, "rows")
    spark.range(100).repartition(3).write.parquet(path)
    plan = numbered(spark, spark.read.parquet(path), "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


# 11


def jumped(key: int, shards: int) -> int:
    """The published algorithm, a key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def seed_of(doc_id) -> int:
    return int.from_bytes(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).digest()[:8], "big")


def test_jumps_equal_one_key_at_a_time_and_move_only_to_the_new_shard():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(3000)] + [0, (1 << 64) - 1]
    for shards in (1, 2, 7, 24, 1000):
        got, more = sharding.jump(np.array(keys, dtype=np.uint64), shards), sharding.jump(np.array(keys, dtype=np.uint64), shards + 1)
        assert got.tolist() == [jumped(k, shards) for k in keys]
        moved = got != more
        assert (more[moved] == shards).all() and abs(moved.mean() - 1 / (shards + 1)) < 0.05
    with pytest.raises(ValueError):
        sharding.jump(np.array([1], dtype=np.uint64), 0)


DOCS = [doc(1, "abc"), doc(2, None), doc(3, ""), doc(None, "x"), doc(None, "x"), doc(None, None), doc(-(2**63), "é" * 5000), doc(2**63 - 1, "é"), doc(1, "abc"), doc(1, "other")]


def test_shards_and_slots(spark):
    rng = random.Random(2)
    docs = DOCS + [doc(rng.choice([5, 5, 5, k]), "t" * (k % 9)) for k in range(600)]  # one id holds most rows
    got = sharding.place(spark, spark.createDataFrame(docs, SCHEMA).repartition(5), 6).collect()
    by_shard = defaultdict(list)
    for i, t, *_ in docs:
        data = (t or "").encode()
        by_shard[jumped(seed_of(i), 6)].append((hashlib.md5(("" if i is None else str(i)).encode()).digest(), i is not None, i or 0, len(data) + 8, zlib.crc32(data), i, jumped(seed_of(i), 7)))
    expected = [(i, size, crc, shard, slot, grown) for shard, rows in by_shard.items() for slot, (_, _, _, size, crc, i, grown) in enumerate(sorted(rows, key=lambda r: r[:5]))]
    order = lambda r: [(x is not None, x or 0) for x in r]
    assert sorted([(r.doc_id, r["size"], r.text_crc32, r.shard, r["slot"], r.grown_shard) for r in got], key=order) == sorted(expected, key=order)
    assert {r.law for r in got} == {"key"}
    assert sharding.place(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_as_files_and_what_moves(spark):
    docs = spark.createDataFrame(DOCS + [doc(k, "t") for k in range(20, 220)], SCHEMA)
    path = sharding.write(spark, docs, shards=5, file_rows=10)
    read = spark.read.parquet(path)
    assert read.count() == len(DOCS) + 200 and set(read.columns) == set(docs.columns)
    assert all(r.shard == jumped(seed_of(r.doc_id), 5) for r in read.collect())
    assert read.groupBy("_metadata.file_path").count().agg(F.max("count")).first()[0] <= 10
    moved = sharding.grow(docs, 5, 6).collect()
    assert {r.target_shard for r in moved} == {5} and {r.doc_id for r in moved} == {r[0] for r in DOCS + [doc(k, "t") for k in range(20, 220)] if jumped(seed_of(r[0]), 5) != jumped(seed_of(r[0]), 6)}
    with pytest.raises(ValueError):
        sharding.grow(docs, 5, 4)


# 12

TURN = "conv_id long, turn long, role string, text string, value string, place string, depth string, n string"


def turn(conv_id, number, role, text):
    return (conv_id, number, role, text, "v", "p", "d", "n")


def rebuilt(rows):
    """Conversations as the query's contract has them, written out."""
    own = defaultdict(list)
    for c, n, role, text, *_ in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(rows):
    whole = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for k in range(len(node) + 1):
            leaves[node[:k]] += not children[node]
            saved[node[:k]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    found = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        found.append((min(own), len(node), parent, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def built(spark, rows, monoids=None):
    c = F.col("conv_id")
    return conversation_trie.prefix_trie(spark, spark.createDataFrame(rows, TURN), c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5, monoids)


def talk(rng, ids):
    return [turn(c, n, rng.choice(["user", "user", None, ""]), rng.choice(["a", "b", "", None, "ab", "é😀", "a" * 300])) for c in ids for n in range(rng.randint(1, 7))]


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    ids = [0, *range(3, 40), 100, *range(120, 140), *range(205, 230), -5, -100, -101, 2**62]  # 200 is missing
    rows = talk(rng, ids)
    rows += [turn(c, n, "user", f"copy {n}") for c in range(300, 340) for n in range(5)]  # many equal conversations
    rows += [turn(7, 1, "user", "tie"), turn(7, 1, "user", "tie"), turn(7, 1, "bot", "tie"), turn(8, None, "user", "early"), turn(8, None, None, None), turn(None, 1, "user", "lost"), turn(5, 2, "user", "x" * 100000)]
    assert told(built(spark, rows)) == trie(rows)


def test_trie_of_long_conversations_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK_BITS", 3)
    monkeypatch.setattr(conversation_trie, "IDS", 3)
    rng = random.Random(9)
    rows = [turn(0, n, "user", "ab"[n % 2]) for n in range(100)] + [turn(c, n, "user", "ab"[n % 2]) for c in range(1, 12) for n in range(rng.randint(1, 60))]
    assert told(built(spark, rows)) == trie(rows)


def test_trie_draws_again_when_products_collide(spark):
    rows = talk(random.Random(6), range(40))
    drawn = []

    def monoids():
        for seed, prime in ((0, 5), (1, 7), (2, conversation_trie.PRIME)):
            drawn.append(prime)
            yield conversation_trie.Monoid(seed, prime)

    assert told(built(spark, rows, monoids())) == trie(rows)
    assert drawn[-1] == conversation_trie.PRIME  # small fields were seen through


def test_trie_of_nothing(spark):
    assert built(spark, []).count() == 0
    assert told(built(spark, [turn(17, 0, "user", "gone")])) == trie([turn(17, 0, "user", "gone")])  # no base, all turns give way


def test_products_join_in_any_grouping():
    m, rng = conversation_trie.Monoid(3), random.Random(0)
    elements = [rng.randbytes(16) for _ in range(9)]
    product = lambda part: functools.reduce(lambda v, e: (v * m.base + int.from_bytes(e, "big")) % m.prime, part, 0)
    for k in range(10):
        assert m.then(product(elements[:k]), product(elements[k:]), 9 - k) == product(elements)
    assert m.before(product(elements), elements[-1]) == product(elements[:-1])


# 13


def runs_by_hand(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(rng, n):
    for _ in range(n):
        kinds = rng.choice([1, 2, 2, 3, 5, 50])
        words = [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            if words:
                a, p = rng.randrange(len(words)), rng.randint(1, 6)
                words = words[:a] + words[a : a + p] * rng.randint(2, 8) + words[a + p * rng.randint(0, 1) :]
        yield words


def test_runs_equal_brute_force():
    n = 0
    for words in sequences(random.Random(5), 2500):
        expected = runs_by_hand(words)
        assert periodic_runs.runs(words) == expected
        number = {w: k for k, w in enumerate(set(words))}
        assert sorted(periodic_runs.runs_of_piece([number[w] for w in words]), key=lambda r: (r[0], r[2])) == expected
        n += len(expected)
    assert n > 1000


def test_runs_where_pieces_are_searched_uncut(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CUTS", 0)
    for words in sequences(random.Random(8), 300):
        assert periodic_runs.runs(words) == runs_by_hand(words)


def by_contract(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_documents(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a a a a a a", "a b a b a b a b c", "ab\x1cab\xa0ab ab ab ab ab ab", "x " * 20000, "one\ntwo " * 4 + "end", "é é é é é é Z"]
    texts += [" ".join(w.decode() for w in words) for words in sequences(rng, 120)]
    rows = [doc(k, t) for k, t in enumerate(texts)] + [doc(None, "a a a a a a"), doc(3, "a a a a a a"), doc(-7, "b " * 50), doc(2**63 - 1, "c d " * 9)]
    path = new_path(spark, "docs")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    got = periodic_runs.op13_periodic_runs(spark, path)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((by_contract(r[0], r[1]) for r in rows), key=repr)
    plain = {r.doc_id: r for r in periodic_runs.periodic_runs(spark, spark.createDataFrame([doc(1, "q a b a b a b a b z")], SCHEMA)).collect()}
    assert plain[1].text == "q a b z" and [tuple(r) for r in plain[1].runs] == [(1, 8, 2)] and plain[1].n_words == 10
    assert periodic_runs.periodic_runs(spark, spark.createDataFrame([], SCHEMA)).count() == 0


# 10


def test_windows_are_the_fewest_lines_from_and_up_to_each_line():
    from skuforge.llm import line_chunks

    rng = random.Random(1)
    for _ in range(2000):
        words = [rng.randint(1, 14) for _ in range(rng.randint(0, 12))]
        n, expected = len(words), set()
        for at in range(n):
            expected |= set([(at, hi) for hi in range(at + 1, n) if sum(words[at : hi + 1]) >= line_chunks.PAIR_WORDS][:1])
            expected |= set([(lo, at) for lo in range(at - 1, -1, -1) if sum(words[lo : at + 1]) >= line_chunks.PAIR_WORDS][:1])
        assert line_chunks._windows(words) == sorted(expected)


def test_every_line_of_a_repeated_passage_goes(spark):
    from skuforge.llm import line_chunks

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(rng.choice([1, 1, 2, 3, 8, 30])) for _ in range(k)] for k in (2, 3, 4, 5, 6, 7, 9, 12, 20, 40) for _ in range(3)]
    passages = [p for p in passages if sum(len(x.split()) for x in p) >= line_chunks.PAIR_WORDS]
    rows, copies = [], {}
    for k, p in enumerate(passages):
        own = lambda: [line(rng.randint(1, 6)) for _ in range(rng.randint(1, 4))]
        rows.append(doc(k, "\n".join([*own(), *p, *own()])))
        before, after = own(), own()
        copies[1000 + k] = "\n".join(before + after)
        rows.append(doc(1000 + k, "\n".join(before + p + after)))
    got = {r.doc_id: r for r in line_chunks.line_dedup(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, rest in copies.items():
        assert [x for x in got[i].text.split("\n") if x] == rest.split("\n")  # the passage goes, its surroundings stay
        assert got[i - 1000].lines_removed == 0


# edges of operators 3, 5 and 7


def test_token_counts_of_marks_and_young_characters_equal_the_library():
    public = pytest.importorskip("public_tokenizers")
    from skuforge.llm import token_counts

    path = public.path("word_bpe_49k.json")
    library, counter = token_counts.tokenizer(path), token_counts.Counter(path, token_counts.whole_tokens(path))
    rng = random.Random(7)
    pool = [*"aeiouAEIOUstn '1.,!é ", "İ", "̧", "̱", "́", "̣", "̇", "ﬁ", "ß", "Σ", "ς", "σ", "ẞ", "Å", "ͅ", "ᄀ", "ᅡ", "ᆨ", " ", "　", "中", "😀", "क़", "ᾈ", "\u0085", "\x1c", "‍", "'Re", "\U000125d1", "\U0001e537", "࢟"]
    texts = ["İ̧e", "İ̱stanbul", "ȩ่͐࢟", "İ\U000125d1"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x370, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    for text in texts:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)


def test_dedup_reserves_no_id(spark):
    from skuforge.llm import exact_dedup

    low, high = -(2**63), 2**63 - 1
    rows = [doc(low, "alone"), doc(low, "two"), doc(None, "two"), doc(None, "none"), doc(None, "none"), doc(0, "zero"), doc(None, "zero"), doc(low, "zero"), doc(high, "far"), doc(low, "far"), doc(-5, "below"), doc(None, "below")]
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = {"alone": (low, 1), "two": (low, 2), "none": (None, 2), "zero": (0, 3), "far": (high, 2), "below": (-5, 2)}
    expected = {hashlib.sha256(t.encode()).hexdigest(): x for t, x in expected.items()}
    for history in (None, F.lit(True), F.lit(False), F.col("doc_id").isNull(), F.col("doc_id").isNotNull()):
        got = exact_dedup.exact_dedup(spark, docs, history, digests_per_shard=2).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.keep_id, r.group_size) == expected[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)


def test_toxicity_fits_one_row_a_labelled_id(spark, monkeypatch):
    from skuforge.llm import toxicity

    fitted = []
    plain = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, words, **more: fitted.append((len(texts), texts)) or plain(texts, labels, words, **more))
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    rows = [doc(k, f"{'vile' if k % 2 else 'kind'} words of {k}") for k in ids] + [doc(ids[0], f"kind {k % 7}") for k in range(3000)] + [doc(ids[1], "vile again")] * 3000
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    toxicity.train(spark, docs, labels, sample=8)
    toxicity.train(spark, docs.repartition(7), labels, sample=8)
    assert [n for n, _ in fitted] == [8, 8] and fitted[0][1] == fitted[1][1]  # the same rows, however they are dealt
    toxicity.train(spark, docs, labels)
    assert fitted[-1][0] == len(ids)
