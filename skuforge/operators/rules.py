"""Business rules: conditions and ordered actions, compiled to column expressions.

Rules sit in small tables; they are read once on the driver and applied in strata, so that a rule sees the record as the earlier ones
left it. Validation rejects rules that can't be evaluated; a condition that still can't be (a price
that is no number) counts as false, negated or not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuforge.functions import text as T

DOMAINS = ["market", "food", "shared"]
CONDITIONS = ["sku_contains", "bt_is", "gk_contains", "category_contains", "region_is", "price_below", "price_above", "flavor_contains", "flavor_is"]
ACTIONS = ["set_bt", "set_region", "set_category", "set_visibility", "add_gk", "remove_gk", "normalize_sku"]
SETTERS = {"set_bt": ("bt", "BT changed to '%s'"), "set_region": ("region", "Region changed to '%s'"), "set_category": ("category", "Category changed to '%s'"), "set_visibility": ("visibility", "Visibility set to '%s'")}
RECORD = {"sku_name": "string", "bt": "string", "gk": "array<string>", "region": "string", "category": "string", "price": "double", "visibility": "string"}
PROVENANCE = "array<struct<rule_id:string,description:string,change:string,reasoning:string>>"
#: The field that a condition asks for, and the fields that actions write.
READS = {"sku_contains": "sku_name", "bt_is": "bt", "gk_contains": "gk", "category_contains": "category", "region_is": "region", "price_below": "price", "price_above": "price", "flavor_contains": "flavors", "flavor_is": "flavor_kinds"}
WRITTEN = ["sku_name", "gk", "bt", "region", "category", "visibility"]
_ACTIONS = "array<struct<kind:string,value:string,new:string,text:string>>"
FIRED = f"struct<at:int,rule_id:string,description:string,reasoning:string,actions:{_ACTIONS}>"
_ENTRY = "struct<at:int,rule_id:string,description:string,change:string,reasoning:string>"
_STATE = "struct<" + ",".join(f"{c}:{RECORD[c]}" for c in WRITTEN) + ",changes:array<string>>"
_FOLDED = f"struct<record:{_STATE},applied:array<{_ENTRY}>>"


@dataclass
class Rule:
    rule_id: str
    domain: str = "shared"
    priority: int = 100
    description: str = ""
    reasoning: str = ""
    condition_logic: str = "OR"
    is_active: bool = True
    conditions: list[dict] = field(default_factory=list)
    actions: list[dict] = field(default_factory=list)


def assemble(rules: DataFrame, conditions: DataFrame, actions: DataFrame) -> DataFrame:
    """Rules with their conditions and actions as arrays, in the order of their ids."""
    c = conditions.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("id", "condition_group", "condition_type", "value", "negate"))).alias("conditions"))
    a = actions.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("id", "action_type", "value"))).alias("actions"))
    return rules.join(c, "rule_id", "left").join(a, "rule_id", "left")


def selected(assembled: DataFrame, domain: str) -> DataFrame:
    """``assembled`` with rank (from 1) for the active rules of the domain and the shared ones: by priority, shared first on ties, then by id.

    Ranks add up over the groups of equal priority, of which there are at most 20,000, so no window holds the whole table.
    """
    rows = assembled.filter(F.col("is_active") & F.col("domain").isin(domain, "shared")).withColumn("_own", F.col("domain") != "shared")
    before = Window.orderBy("priority", "_own").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("priority", "_own").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = rows.join(sizes.drop("_n"), ["priority", "_own"])
    at = F.row_number().over(Window.partitionBy("priority", "_own").orderBy("rule_id"))
    return placed.withColumn("rank", F.col("_before") + at).drop("_own", "_before")


def load(assembled: DataFrame, domain: str) -> list[Rule]:
    """The rules of ``selected`` in their order. They become part of the plan, so the table must be a bounded one, as hand-written rules are."""
    rows = selected(assembled, domain).orderBy("rank").collect()
    return [Rule(r.rule_id, r.domain, r.priority, r.description or "", r.reasoning or "", r.condition_logic or "OR", True, [x.asDict() for x in r.conditions or []], [x.asDict() for x in r.actions or []]) for r in rows]


def violations(assembled: DataFrame) -> DataFrame:
    """rule_id, problem for each rule that breaks a limit."""
    checks = [
        (~F.col("domain").isin(DOMAINS), "domain"),
        (~F.col("priority").between(1, 10000), "priority"),
        (~F.upper("condition_logic").isin("AND", "OR"), "condition_logic"),
        (F.length("description") > 500, "description"),
        (F.exists("conditions", lambda c: ~c["condition_type"].isin(CONDITIONS)), "condition_type"),
        (F.exists("conditions", lambda c: c["condition_type"].isin("price_below", "price_above") & c["value"].try_cast("double").isNull()), "condition_value"),
        (F.exists("actions", lambda a: ~a["action_type"].isin(ACTIONS)), "action_type"),
        (F.exists("actions", lambda a: T.blank(a["value"])), "action_value"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for cond, name in checks]), lambda x: x.isNotNull())
    return assembled.select("rule_id", F.explode(found).alias("problem"))


def flavor_hits(df: DataFrame, dictionary: DataFrame, uid: str, name: str = "sku_name") -> DataFrame:
    """``df`` with flavors (canonical) and flavor_kinds found in its names, for the flavor conditions."""
    from skuforge.operators import entities

    kinds = dictionary.select("alias", F.filter(F.array(F.when(F.col("is_meat"), "meat"), F.when(F.col("is_vegetable"), "vegetable"), F.when(F.col("is_seafood"), "seafood")), lambda x: x.isNotNull()).alias("k"))
    hits = entities.scan(df, dictionary, uid, name).join(kinds, "alias").groupBy(uid).agg(F.array_sort(F.collect_set("canonical")).alias("flavors"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("flavor_kinds"))
    none = F.array().cast("array<string>")
    return df.join(hits, uid, "left").withColumns({"flavors": F.coalesce("flavors", none), "flavor_kinds": F.coalesce("flavor_kinds", none)})


def condition(c: dict) -> Column:
    """One condition on a record's columns, never null."""
    kind, value = c["condition_type"], str(c.get("value") or "")
    low = value.strip().lower()
    text = lambda n: F.lower(F.coalesce(F.col(n), F.lit("")))
    if kind == "sku_contains":
        out = text("sku_name").contains(low)
    elif kind == "bt_is":
        out = F.trim(text("bt")) == low
    elif kind == "gk_contains":
        out = F.array_contains(F.transform(F.coalesce("gk", F.array().cast("array<string>")), lambda g: F.lower(F.trim(g))), low)
    elif kind == "category_contains":
        out = text("category").contains(low)
    elif kind == "region_is":
        out = F.trim(text("region")) == low
    elif kind in ("price_below", "price_above"):
        try:
            limit = float(value)
        except ValueError:
            return F.lit(False)
        out = (F.col("price") < limit) if kind == "price_below" else (F.col("price") > limit)
    elif kind == "flavor_contains":
        out = F.array_contains("flavors", low)
    elif kind == "flavor_is":
        out = F.array_contains("flavor_kinds", {"veg": "vegetable"}.get(low, low))
    else:
        return F.lit(False)
    out = F.coalesce(out, F.lit(False))
    return ~out if c.get("negate") else out


def fires(rule: Rule) -> Column:
    """One type's conditions within a group are alternatives, its types must all hold; groups by the rule's logic; none: it fires."""
    if not rule.conditions:
        return F.lit(True)
    groups: dict[int, dict[str, list[Column]]] = {}
    for c in rule.conditions:
        groups.setdefault(c.get("condition_group") or 1, {}).setdefault(c["condition_type"], []).append(condition(c))

    def fold(columns: list[Column], both: bool) -> Column:
        out = columns[0]
        for x in columns[1:]:
            out = out & x if both else out | x
        return out

    each = [fold([fold(alternatives, False) for alternatives in types.values()], True) for types in groups.values()]
    return fold(each, rule.condition_logic.upper() == "AND")


def _apply(record: dict[str, Column], action: dict) -> tuple[dict[str, Column], Column]:
    """The record after an action, and the text of the change; null if nothing changes."""
    kind, value = action["action_type"], action.get("value") or ""
    if kind in SETTERS:
        name, text = SETTERS[kind]
        changed = ~F.coalesce(record[name] == value, F.lit(False))
        return record | {name: F.when(changed, value).otherwise(record[name])}, F.when(changed, text % value)
    if kind in ("add_gk", "remove_gk"):
        gk = F.coalesce(record["gk"], F.array().cast("array<string>"))
        held = F.array_contains(gk, value)
        if kind == "add_gk":
            return record | {"gk": F.when(held, gk).otherwise(F.array_append(gk, F.lit(value)))}, F.when(~held, f"Added GK '{value}'")
        at = F.array_position(gk, value).cast("int")
        return record | {"gk": F.when(held, F.filter(gk, lambda x, i: i != at - 1)).otherwise(record["gk"])}, F.when(held, f"Removed GK '{value}'")
    if kind == "normalize_sku" and "|" in value:
        old, new = value.split("|", 1)
        if old:
            after = F.replace(record["sku_name"], F.lit(old), F.lit(new))
            return record | {"sku_name": after}, F.when(after != record["sku_name"], f"Normalized SKU '{old}' to '{new}'")
    return record, F.lit(None).cast("string")


def apply_rule(df: DataFrame, rule: Rule, trace: bool = False) -> DataFrame:
    """``df`` after one rule; where something changed the rule is added to rules_applied. trace: also columns fired, change."""
    record = {c: F.col(c) for c in RECORD}
    changes = []
    for a in rule.actions:
        record, change = _apply(record, a)
        changes.append(change)
    change = F.concat_ws("; ", *changes) if changes else F.lit("")
    df = df.withColumn("_fires", fires(rule))
    entry = F.array(F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.description).alias("description"), change.alias("change"), F.lit(rule.reasoning).alias("reasoning")))
    new = {c: F.when(F.col("_fires"), x).otherwise(F.col(c)) for c, x in record.items()}
    new["rules_applied"] = F.when(F.col("_fires") & (change != ""), F.concat(F.coalesce("rules_applied", F.array().cast(PROVENANCE)), entry)).otherwise(F.coalesce("rules_applied", F.array().cast(PROVENANCE)))
    if trace:
        new |= {"fired": F.col("_fires"), "change": F.when(F.col("_fires"), change).otherwise("")}
    return df.withColumns(new).drop("_fires")


def _writes(rule: Rule) -> set[str]:
    kinds = {a["action_type"] for a in rule.actions}
    return {SETTERS[k][0] for k in kinds if k in SETTERS} | ({"gk"} if kinds & {"add_gk", "remove_gk"} else set()) | ({"sku_name"} if "normalize_sku" in kinds else set())


def strata(rules: list[Rule]) -> list[list[tuple[int, Rule]]]:
    """The rules with their places, in strata whose conditions can all be evaluated before any of the stratum's actions.

    A rule stands behind every earlier rule that writes a field it asks for, and not before one that writes or asks for a field it writes; so each
    field has the same history as one by one, and rules that don't touch each other share a stratum wherever they stand.
    """
    wrote: dict[str, int] = {}
    asked: dict[str, int] = {}
    out: dict[int, list[tuple[int, Rule]]] = {}
    for at, rule in enumerate(rules):
        reads, writes = {READS.get(c["condition_type"], "") for c in rule.conditions}, _writes(rule)
        level = max([0] + [wrote[f] + 1 for f in reads if f in wrote] + [m[f] for f in writes for m in (wrote, asked) if f in m])
        for fields, seen in ((reads, asked), (writes, wrote)):
            seen.update({f: max(level, seen.get(f, 0)) for f in fields})
        out.setdefault(level, []).append((at, rule))
    return [out[level] for level in sorted(out)]


def _as_data(at: int, rule: Rule) -> Column:
    """A rule as a constant of type FIRED; actions without effect are left out."""
    rows = []
    for a in rule.actions:
        kind, value = a["action_type"], a.get("value") or ""
        old, _, new = value.partition("|")
        if kind in SETTERS:
            rows.append((SETTERS[kind][0], value, "", SETTERS[kind][1] % value))
        elif kind in ("add_gk", "remove_gk"):
            rows.append((kind, value, "", f"{'Added' if kind == 'add_gk' else 'Removed'} GK '{value}'"))
        elif kind == "normalize_sku" and "|" in value and old:
            rows.append((kind, old, new, f"Normalized SKU '{old}' to '{new}'"))
    actions = F.array(*[F.struct(*[F.lit(x) for x in row]) for row in rows]) if rows else F.array()
    return F.struct(F.lit(at), F.lit(rule.rule_id), F.lit(rule.description), F.lit(rule.reasoning), actions.cast(_ACTIONS)).cast(FIRED)


def _act(acc: Column, a: Column) -> Column:
    """A record with its changes after one action."""
    kind, value = a["kind"], a["value"]
    out, texts = {}, []
    for name in WRITTEN[2:]:  # those with setters
        changed = (kind == name) & ~F.coalesce(acc[name] == value, F.lit(False))
        out[name] = F.when(changed, value).otherwise(acc[name])
        texts.append(changed)
    gk = F.coalesce(acc["gk"], F.array().cast("array<string>"))
    held = F.array_contains(gk, value)
    at = F.array_position(gk, value).cast("int")
    removed = F.when(held, F.filter(gk, lambda x, i: i != at - 1)).otherwise(acc["gk"])
    out["gk"] = F.when(kind == "add_gk", F.when(held, gk).otherwise(F.array_append(gk, value))).when(kind == "remove_gk", removed).otherwise(acc["gk"])
    after = F.replace(acc["sku_name"], value, a["new"])
    out["sku_name"] = F.when(kind == "normalize_sku", after).otherwise(acc["sku_name"])
    texts += [(kind == "add_gk") & ~held, (kind == "remove_gk") & held, (kind == "normalize_sku") & (after != acc["sku_name"])]
    told = F.coalesce(texts[0], F.lit(False))
    for x in texts[1:]:
        told = told | F.coalesce(x, F.lit(False))
    changes = F.when(told, F.array_append(acc["changes"], a["text"])).otherwise(acc["changes"])
    return F.struct(*[out[c].alias(c) for c in WRITTEN], changes.alias("changes")).cast(_STATE)


def _fold(acc: Column, rule: Column) -> Column:
    """A record with its provenance after one rule that fires."""
    start = F.struct(*[acc["record"][c].alias(c) for c in WRITTEN], F.array().cast("array<string>").alias("changes")).cast(_STATE)
    after = F.aggregate(rule["actions"], start, _act)
    entry = lambda s: F.struct(rule["at"], rule["rule_id"], rule["description"], F.array_join(s["changes"], "; ").alias("change"), rule["reasoning"])
    result = lambda s: F.struct(s.alias("record"), F.when(F.size(s["changes"]) > 0, F.array_append(acc["applied"], entry(s).cast(_ENTRY))).otherwise(acc["applied"]).alias("applied")).cast(_FOLDED)
    return F.element_at(F.transform(F.array(after), result), 1)  # names ``after``, which is used more than once


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` after all rules in order. Records need the columns of RECORD; rules_applied is added if it is missing.

    Rules are applied by ``strata``: one projection evaluates a stratum's conditions, and one fold of fixed size runs the actions of the rules that fire,
    which are data, so the plan grows with the strata and not with the rules. The result is that of ``apply_rule`` one by one.
    """
    if "rules_applied" not in df.columns:
        df = df.withColumn("rules_applied", F.array().cast(PROVENANCE))
    for c in ("flavors", "flavor_kinds"):
        if c not in df.columns:
            df = df.withColumn(c, F.array().cast("array<string>"))
    if not rules:
        return df
    df = df.withColumn("_applied", F.array().cast(f"array<{_ENTRY}>"))
    for group in strata(rules):
        fired = F.filter(F.array(*[F.when(fires(rule), _as_data(at, rule)) for at, rule in group]), lambda x: x.isNotNull())
        record = F.struct(*[F.col(c) for c in WRITTEN], F.array().cast("array<string>").alias("changes")).cast(_STATE)
        df = df.withColumn("_fired", fired).withColumn("_after", F.aggregate("_fired", F.struct(record.alias("record"), F.col("_applied").alias("applied")).cast(_FOLDED), _fold))
        df = df.withColumns({c: F.col(f"_after.record.{c}") for c in WRITTEN} | {"_applied": F.col("_after.applied")}).drop("_fired", "_after")
    told = F.transform(F.array_sort("_applied"), lambda x: F.struct(x["rule_id"], x["description"], x["change"], x["reasoning"]))
    return df.withColumn("rules_applied", F.concat(F.coalesce("rules_applied", F.array().cast(PROVENANCE)), told.cast(PROVENANCE))).drop("_applied")


def dry_run(df: DataFrame, rule: Rule) -> DataFrame:
    """Every record with fired, change and the record after, for one rule."""
    return apply_rule(apply_rules(df, []), rule, trace=True)
