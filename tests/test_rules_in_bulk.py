"""Rules in strata against the same rules one by one; occurrence numbers of names in many stretches."""

import random
from collections import Counter

from pyspark.sql import functions as F

from skuforge.functions import text as T
from skuforge.operators import rules as R

RECORD = "uid long, " + ", ".join(f"{k} {v}" for k, v in R.RECORD.items())
VALUES = {"sku_contains": ["a", "ab", "Ice", ""], "bt_is": ["tub", "cone", "bar"], "gk_contains": ["x", "y", "z"], "category_contains": ["dairy", "d"], "region_is": ["all", "north"], "price_below": ["5", "x"], "price_above": ["5", "2.5"]}
ACTIONS = {"set_bt": ["Tub", "Cone", "Bar"], "set_region": ["all", "north"], "set_category": ["dairy", "dry"], "set_visibility": ["hidden", "visible"], "add_gk": ["x", "y", "z"], "remove_gk": ["x", "y"], "normalize_sku": ["a|b", "b|a", "Ice|ice", "|x", "none"], "unknown": ["?"]}


def _rules(n, seed):
    rng = random.Random(seed)
    pick = lambda table: (lambda k: (k, rng.choice(table[k])))(rng.choice(list(table)))
    out = []
    for k in range(n):
        conditions = [dict(zip(("condition_type", "value"), pick(VALUES), strict=True), negate=rng.random() < 0.2, condition_group=rng.randrange(1, 3)) for _ in range(rng.randrange(3))]
        actions = [dict(zip(("action_type", "value"), pick(ACTIONS), strict=True)) for _ in range(rng.randrange(4))]
        out.append(R.Rule(f"r{k}", description=f"d{k}", reasoning=f"why {k}", condition_logic=rng.choice(["AND", "OR"]), conditions=conditions, actions=actions))
    return out


def _records(spark, n=60):
    rng = random.Random(3)
    some = lambda *x: rng.choice([None, *x])
    rows = [(k, some("a ab", "Ice b", "zz", ""), some("Tub", "Cone", "bar "), some([], ["x"], ["y", "x", "y"]), some("all", "South"), some("Dairy", "dry"), some(1.0, 5.0, 9.5), some("hidden")) for k in range(n)]
    return spark.createDataFrame(rows, RECORD)


def test_rules_in_strata_equal_rules_one_by_one(spark):
    rules, records = _rules(14, 11), _records(spark)
    single = R.apply_rules(records, [])
    for k, rule in enumerate(rules):
        single = R.apply_rule(single, rule)
        if k % 3 == 2:  # one by one, the plan grows with every rule
            single = spark.createDataFrame(single.collect(), single.schema)
    columns = ["uid", *R.RECORD, "rules_applied"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    got = rows(R.apply_rules(records, rules))
    assert got == rows(single)
    assert rows(R.apply_rules(R.apply_rules(records, rules[:6]), rules[6:])) == got
    assert any(r[-1] for r in got)


def test_five_hundred_independent_rules_are_one_stratum(spark):
    word = lambda k: f"w{k:03d}w"
    rules = [R.Rule(f"r{k}", conditions=[{"condition_type": "sku_contains", "value": word(k)}], actions=[{"action_type": "add_gk", "value": f"tag {k}"}]) for k in range(500)]
    assert len(R.strata(rules)) == 1
    asks = [R.Rule("last", conditions=[{"condition_type": "gk_contains", "value": "tag 7"}], actions=[{"action_type": "set_bt", "value": "Seven"}])]
    assert [len(x) for x in R.strata(rules + asks)] == [500, 1]
    records = spark.createDataFrame([(k, f"{word(k)} {word(499 - k)}", None, None, None, None, None, None) for k in range(500)], RECORD)
    got = {r.uid: r for r in R.apply_rules(records, rules + asks).collect()}
    for k, r in got.items():
        own = sorted({k, 499 - k})
        assert r.gk == [f"tag {x}" for x in own] and r.bt == ("Seven" if 7 in own else None)
        assert [x.rule_id for x in r.rules_applied] == [f"r{x}" for x in own] + (["last"] if 7 in own else [])


def test_strata_keep_the_history_of_every_field():
    """A rule never stands before an earlier one that writes its fields, nor before one that asks for what it writes."""
    rules = _rules(80, 5)
    level = {at: k for k, group in enumerate(R.strata(rules)) for at, _ in group}
    reads = [{R.READS[c["condition_type"]] for c in r.conditions} for r in rules]
    writes = [R._writes(r) for r in rules]
    for j in range(len(rules)):
        for i in range(j):
            assert not writes[i] & reads[j] or level[i] < level[j]
            assert not (writes[i] | reads[i]) & writes[j] or level[i] <= level[j]


def test_occurrence_numbers_over_many_stretches(spark):
    rng = random.Random(4)
    names = [None if rng.random() < 0.05 else rng.choice([" Hot ", "hot", "HOT", "cold", f"n{k}"]) for k in range(300)]
    rows = [(p, x, k) for k, (p, x) in enumerate(zip(rng.sample(range(-500, 5000), 300), names, strict=True))] + [(None, "hot", 300)]
    df = spark.createDataFrame(rows, "source_pos long, name string, _n long")
    seen, want = Counter(), {}
    for p, x, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        low = x and x.strip().lower()
        want[k] = None if x is None else f"{low}#occ_{seen[low]}"
        seen[low] += 1
    df = df.withColumnRenamed("_n", "k")
    for span in (7, 1 << 20):
        got = T.occurrence_ids(df, span=span)
        assert got.columns == ["source_pos", "name", "k", "uid"]
        assert {r.k: r.uid for r in got.collect()} == want
    assert T.occurrence_ids(df.filter(F.lit(False))).count() == 0
