"""Tag suggestion from catalog templates: a row that differs from the input in one modifier (a flavor or brand) alone.

inputs: uid, name, clean_text, entity kinds brand and flavor (arrays); catalog: source_pos, name, clean_text, basictype, keywords, brand,
flavor. The modifier is taken out of both texts; what is left, the anchor, must be alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.functions import similarity as S
from skuforge.functions import text as T
from skuforge.operators import alike, classify
from skuforge.sources.shared import checkpointed, together

ANCHOR, SUBSTITUTED, SNAP = 70.0, 85.0, 90.0
BOUND_LEFT, BOUND_RIGHT = r"(?i)(?<![a-z0-9])\Q", r"\E(?![a-z0-9])"


def _without(text: Column, entity: Column) -> Column:
    return T.squeeze(F.regexp_replace(F.lower(text), F.concat(F.lit(BOUND_LEFT), entity, F.lit(BOUND_RIGHT)), " "))


def swap_entity(text: Column, old: Column, new: Column) -> Column:
    return F.regexp_replace(text, F.concat(F.lit(BOUND_LEFT), old, F.lit(BOUND_RIGHT)), new)


def modifiers(rows: DataFrame, key: str, text: str = "clean_text") -> DataFrame:
    """key, kind, entity: entities that can be a modifier: two words at most, fewer than the text has, shorter than 65 % of it, in it."""
    each = rows.select(key, F.col(text).alias("_t"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("e")) for k in ("brand", "flavor")])).alias("x"))
    e = each.select(key, "_t", "x.kind", F.explode("x.e").alias("entity"))
    n = T.token_count(F.col("entity"))
    inside = F.concat(F.lit(" "), F.lower("_t"), F.lit(" ")).contains(F.concat(F.lit(" "), F.lower("entity"), F.lit(" ")))
    return e.filter((n <= 2) & (n < T.token_count(F.col("_t"))) & (F.length("entity") < 0.65 * F.length("_t")) & inside).select(key, "kind", F.lower("entity").alias("entity")).distinct()


def _kind(of_type: bool, name: str, out: str) -> list[Column]:
    return [F.lower(F.trim(F.coalesce(name, F.lit("")))).alias(out)] if of_type else []


def offers(catalog: DataFrame, of_type: bool) -> DataFrame:
    """kind, old_entity, c_anchor, c_text, source_pos (and c_type, where types must agree): what templates take from the catalog, whatever the inputs."""
    c = modifiers(catalog, "source_pos").join(catalog.select("source_pos", F.col("clean_text").alias("c_text"), *_kind(of_type, "basictype", "c_type")), "source_pos").withColumn("c_anchor", _without(F.col("c_text"), F.col("entity")))
    return checkpointed(c.withColumnRenamed("entity", "old_entity").groupBy("kind", "old_entity", "c_anchor", "c_text", *(["c_type"] if of_type else [])).agg(F.min("source_pos").alias("source_pos")))


def best_templates(inputs: DataFrame, catalog: DataFrame, offered: Callable[[], DataFrame] | None = None) -> DataFrame:
    """uid, kind, new_entity, old_entity, source_pos, ratio: the template whose name, with the entity exchanged, is most like the input's.

    Distinct anchors are scored once, however many rows have them, behind a blocking that loses none. So are distinct texts: inputs of one text,
    entity and type share their template, and templates that become one text share a score. Where inputs have a column bt, a
    template's type must be equal or alike to it; a blank one fits all. offered: gives offers() of the catalog, where that was begun before.
    """
    of_type = "bt" in inputs.columns
    i = modifiers(inputs, "uid").join(inputs.select("uid", F.col("clean_text").alias("i_text"), *_kind(of_type, "bt", "i_type")), "uid").withColumn("i_anchor", _without(F.col("i_text"), F.col("entity")))
    i, c = together(lambda: checkpointed(i), offered or (lambda: offers(catalog, of_type)))
    unit = ["kind", "entity", "i_text", *(["i_type"] if of_type else [])]
    asked = checkpointed(i.select(*unit, "i_anchor").distinct())
    ia, ca = asked.select("i_anchor").filter("i_anchor <> ''").distinct(), c.select("c_anchor").filter("c_anchor <> ''").distinct()
    pairs = alike.alike(ia, ca, "i_anchor", "c_anchor", ANCHOR, _whole_texts(asked, c)).select(F.col("_a").alias("i_anchor"), F.col("_b").alias("c_anchor"))
    cand = asked.join(pairs, "i_anchor").join(c, ["kind", "c_anchor"]).filter((F.col("entity") != F.col("old_entity")) & (F.col("i_text") != F.col("c_text")))
    cand = cand.withColumn("swapped", swap_entity(F.col("c_text"), F.col("old_entity"), F.col("entity"))).filter(S.length_bound(F.col("swapped"), F.col("i_text"), SUBSTITUTED))
    texts = cand.groupBy(*unit, *(["c_type"] if of_type else []), "swapped").agg(F.min(F.struct("source_pos", "old_entity")).alias("c"))
    scored = texts.withColumn("ratio", S.ratio("swapped", "i_text")).filter(F.col("ratio") >= SUBSTITUTED)
    if of_type:
        scored = scored.filter((F.col("i_type") == "") | (F.col("i_type") == F.col("c_type")) | (S.ratio("i_type", "c_type") >= ANCHOR))
    best = scored.groupBy(*unit).agg(F.min(F.struct((-F.col("ratio")).alias("m"), "c.source_pos", "kind", "entity", "c.old_entity")).alias("b"))
    best = i.join(best, unit).groupBy("uid").agg(F.min("b").alias("b"))
    return best.select("uid", "b.kind", F.col("b.entity").alias("new_entity"), "b.old_entity", "b.source_pos", (-F.col("b.m")).alias("ratio"))


def _whole_texts(i: DataFrame, c: DataFrame) -> tuple[float, float]:
    """What the whole texts' cutoff asks of anchors, which lack up to ``most`` copies of an entity and a space: (cutoff, characters to spare).

    Texts with k and k' copies of n characters share at most max(k, k') n characters more than their anchors do, and have (k + k') n more in all.
    """
    copies = lambda df, text, entity: df.select(F.size(F.regexp_extract_all(F.lower(text), F.concat(F.lit(BOUND_LEFT), F.col(entity), F.lit(BOUND_RIGHT)), F.lit(0))).alias("k"), F.length(entity).alias("n"))
    most, longest = copies(i, "i_text", "entity").union(copies(c, "c_text", "old_entity")).agg(F.max("k"), F.max("n")).first()
    k, n = most or 1, (longest or 0) + 1
    share = SUBSTITUTED / 200
    return SUBSTITUTED, n * (k - share * (k + 1)) + k  # k more: a neighbour that is no space may keep the space


def dictionary_or_catalog(dictionary: DataFrame, catalog: DataFrame) -> DataFrame:
    """tag_type, tag: the dictionary, or where it is empty the catalog's own types and keywords."""
    own = catalog.select(F.lit("bt").alias("tag_type"), F.col("basictype").alias("tag")).unionByName(catalog.select(F.lit("gk").alias("tag_type"), F.explode("keywords").alias("tag"))).filter(~T.blank(F.col("tag"))).distinct()
    return own if dictionary.isEmpty() else dictionary.select("tag_type", "tag").distinct()


def snap_tags(tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tag_type, raw, entity, tag, registered: a dictionary tag equal but for case, else one at least 90 alike (those naming the entity first), else
    the raw tag in Title Case, unregistered. tags: tag_type, raw, entity."""
    key = lambda c: F.lower(F.trim(c))
    known = dictionary.groupBy(F.col("tag_type").alias("kt"), key("tag").alias("k")).agg(F.min("tag").alias("known"))
    raw = tags.select("tag_type", "raw", "entity").distinct()
    exact = raw.join(known, (F.col("tag_type") == F.col("kt")) & (key("raw") == F.col("k")), "left").select("tag_type", "raw", "entity", "known")
    open_ = exact.filter("known IS NULL").drop("known")
    left = open_.select(F.col("tag_type").alias("rt"), key("raw").alias("r")).distinct()
    near = alike.alike(left, known, "r", "k", SNAP).withColumnsRenamed({"_a": "r", "_b": "k"})  # the same texts whatever their type, then by type
    likely = left.join(near, "r").join(known.withColumnRenamed("kt", "rt"), ["rt", "k"])
    fuzzy = open_.join(likely, (F.col("tag_type") == F.col("rt")) & (key("raw") == F.col("r"))).groupBy(F.col("tag_type").alias("_t"), F.col("raw").alias("_raw"), F.col("entity").alias("_e"))
    fuzzy = fuzzy.agg(F.min(F.struct((~F.contains(F.col("k"), F.lower("entity"))).alias("o"), (-F.col("ratio")).alias("m"), "known")).alias("b")).select("_t", "_raw", "_e", F.col("b.known").alias("near"))
    out = exact.join(fuzzy, (F.col("tag_type") == F.col("_t")) & (F.col("raw") == F.col("_raw")) & (F.col("entity") == F.col("_e")), "left")
    found = F.coalesce("known", "near")
    return out.select("tag_type", "raw", "entity", F.coalesce(found, T.title_case(F.col("raw"))).alias("tag"), found.isNotNull().alias("registered"))


def suggest(inputs: DataFrame, catalog: DataFrame, dictionary: DataFrame, keep_unregistered: bool = False, offered: Callable[[], DataFrame] | None = None) -> DataFrame:
    """uid, source_pos, suggested_bt, suggested_gk, ratio for inputs with a template."""
    best = checkpointed(best_templates(inputs, catalog, offered).join(catalog.select("source_pos", "basictype", "keywords"), "source_pos"))  # read for its tags, several times
    swap = lambda c: swap_entity(c, F.col("old_entity"), F.col("new_entity"))
    raw = best.select("uid", F.col("new_entity").alias("entity"), F.explode(F.concat(F.array(F.struct(F.lit("bt").alias("tag_type"), swap(F.col("basictype")).alias("raw"), F.lit(0).alias("at"))), F.transform("keywords", lambda k, i: F.struct(F.lit("gk").alias("tag_type"), swap(k).alias("raw"), (i + 1).alias("at"))))).alias("t"))
    raw = checkpointed(raw.select("uid", "entity", "t.tag_type", "t.raw", "t.at"))
    snapped = raw.join(snap_tags(raw, dictionary), ["tag_type", "raw", "entity"])
    if not keep_unregistered:
        snapped = snapped.filter("registered")
    tags = snapped.groupBy("uid").agg(F.min(F.when(F.col("tag_type") == "bt", F.col("tag"))).alias("suggested_bt"), F.transform(F.array_sort(F.collect_list(F.when(F.col("tag_type") == "gk", F.struct("at", "tag")))), lambda s: s["tag"]).alias("g"))
    return best.select("uid", "source_pos", "ratio").join(tags, "uid", "left").select("uid", "source_pos", "suggested_bt", classify.merge_keywords(F.col("g")).alias("suggested_gk"), "ratio")


def enrich(results: DataFrame, suggestions: DataFrame, mode: str) -> DataFrame:
    """``results`` (uid, bt, gk, bt_confidence, status) with suggestions, where they aren't already sure: type set, keywords joined,
    confidence at least .95, status AUTO (classifier) or High Confidence (matcher)."""
    s = suggestions.select("uid", F.col("suggested_bt").alias("_bt"), F.col("suggested_gk").alias("_gk"))
    rows = results.join(s, "uid", "left")
    take = ~F.coalesce(F.col("status").isin("High Confidence", "AUTO"), F.lit(False)) & F.col("_bt").isNotNull()
    new = {
        "bt": F.when(take, F.col("_bt")).otherwise(F.col("bt")),
        "gk": F.when(take, classify.merge_keywords(F.col("gk"), F.col("_gk"))).otherwise(F.col("gk")),
        "bt_confidence": F.when(take, F.greatest(F.coalesce("bt_confidence", F.lit(0.0)), F.lit(0.95))).otherwise(F.col("bt_confidence")),
        "status": F.when(take, "AUTO" if mode == "classifier" else "High Confidence").otherwise(F.col("status")),
    }
    return rows.withColumns(new).drop("_bt", "_gk")
