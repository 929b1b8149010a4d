"""The whole matching plan: keys, then hybrid retrieval, reranking, gates, the choice between pools, keyword filters and templates.

All steps are joins of tables keyed by input and catalog row. Texts are encoded, and pairs scored, once each. Prepared inputs, the
prepared catalog and the rows the keys leave over are settled, since several steps read them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.functions import text as T
from skuforge.operators import entities as D
from skuforge.operators import gates as GT
from skuforge.operators import matching as M
from skuforge.operators import templates as H
from skuforge.operators import vectors as V
from skuforge.sources.shared import begun, settled, together


@dataclass(frozen=True)
class Tools:
    """What a run needs besides its tables. brands and flavors are dictionaries of entities.py; dictionary has tag_type, tag."""

    encoder: V.Encoder
    scorer: V.Scorer | None = None
    domain: str = "market"
    brands: DataFrame | None = None
    flavors: DataFrame | None = None
    dictionary: DataFrame | None = None
    retrieved: int = 30
    pool: int = 15
    gated: int = 5
    written: bool = False


def written(tools: Tools) -> Tools:
    """``tools`` with the dictionaries of entities written, which many steps read."""
    if tools.written or tools.brands is None or tools.flavors is None:
        return tools
    brands, flavors = together(lambda: settled(tools.brands), lambda: settled(tools.flavors))
    return replace(tools, brands=brands, flavors=flavors, written=True)


@dataclass(frozen=True)
class Stages:
    """The tables a match goes through, for traces. final has one row an input; tools has the dictionaries written."""

    tools: Tools
    inputs: DataFrame
    catalog: DataFrame
    keyed: DataFrame
    candidates: DataFrame
    gated: DataFrame
    chosen: DataFrame
    templates: DataFrame
    final: DataFrame


def _none() -> F.Column:
    return F.array().cast("array<string>")


def with_entities(rows: DataFrame, tools: Tools, uid: str, text: str = "clean_text") -> DataFrame:
    """``rows`` with brand and flavor arrays: a filled column's own parts (text or comma list), else what the dictionaries find."""
    given = [c for c in ("brand", "flavor") if c in rows.columns]
    rows = rows.withColumnsRenamed({c: f"_{c}" for c in given})
    if tools.brands is None or tools.flavors is None:
        rows = rows.withColumns({"brand": _none(), "flavor": _none()})
    else:
        rows = rows.join(_found(rows.select(uid, F.col(text).alias("text")), tools, uid), uid)
    return rows.withColumns({c: D.prefilled(F.col(f"_{c}"), F.col(c)) for c in given}).drop(*[f"_{c}" for c in given])


def _found(texts: DataFrame, tools: Tools, uid: str) -> DataFrame:
    """uid, brand, flavor arrays: what the dictionaries find, and where one finds nothing, the first word or pair that resembles an alias."""
    texts = settled(texts)
    found = settled(D.entities(texts, tools.brands, tools.flavors, uid))

    def near(kind: str, dictionary: DataFrame) -> DataFrame | None:
        missed = found.filter(F.size(kind) == 0).select(uid)
        if missed.isEmpty():
            return None
        none = texts.join(missed, uid, "left_semi")
        return settled(D.fuzzy_entities(none, dictionary, uid).select(F.col(uid).alias("_u"), F.array("canonical").alias("_n")))

    out = found
    for kind, more in zip(("brand", "flavor"), together(lambda: near("brand", tools.brands), lambda: near("flavor", tools.flavors)), strict=True):
        if more is not None:
            out = out.join(more, F.col(uid) == F.col("_u"), "left").withColumn(kind, F.coalesce("_n", kind)).drop("_u", "_n")
    return settled(out)


def enriched(inputs: DataFrame, tools: Tools) -> DataFrame:
    """Food inputs (uid, name, description, category) with ' mixed' or ' veg' behind names whose flavors say so; others as they are."""
    if tools.domain != "food" or tools.brands is None or tools.flavors is None:
        return inputs
    texts = inputs.select("uid", F.trim(F.concat_ws(" ", "name", "description", "category")).alias("text"))
    kinds = D.triage(_found(texts, tools, "uid").select("uid", "flavor"), tools.flavors)
    kinds = kinds.select(F.col("uid").alias("_u"), F.filter("land_meats", lambda m: m != "egg").alias("_m"), F.col("seafood").alias("_s"), F.col("vegetables").alias("_v"))
    rows = inputs.join(kinds, F.col("uid") == F.col("_u"), "left")
    none = lambda c: F.coalesce(c, _none())
    return settled(rows.withColumn("name", D.enrich_name(F.col("name"), none("_m"), none("_s"), none("_v"))).drop("_u", "_m", "_s", "_v"))


def _default(df: DataFrame, **columns: str) -> DataFrame:
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def _tokens(df: DataFrame, uid: str, text: str, *more: str) -> DataFrame:
    words = df.select(uid, *more, F.explode(T.words(F.col(text))).alias("token"))
    return words.groupBy(uid, *more, "token").agg(F.sqrt(F.count(F.lit(1))).alias("weight"))


def _asked(rest: DataFrame) -> DataFrame:
    """``rest`` with what a search asks for: _guard (the type, where it is confident), _stripped (the text without brands)."""
    guard = F.when(M.bt_is_confident(F.col("bt_confidence"), F.col("bt_source")), F.lower(F.trim("predicted_bt")))
    return rest.withColumns({"_guard": guard, "_stripped": D.strip_brands(F.col("clean_text"), F.col("brand"))})


def with_units(rest: DataFrame) -> DataFrame:
    """``rest`` with unit: inputs that ask for the same share their candidates, which are found once, for the lowest uid among them."""
    same = {x: f"_u{x}" for x in ("clean_text", "_guard", "_stripped")}
    rows = _asked(rest)
    units = rows.groupBy(*same).agg(F.min("uid").alias("unit")).withColumnsRenamed(same)
    return rows.join(units, [F.equal_null(x, y) for x, y in same.items()]).drop(*same.values(), "_guard", "_stripped")


@dataclass(frozen=True)
class Side:
    """One side of the searches: rows uid, clean_text (and bt) with their vectors, and their words."""

    coded: DataFrame
    words: DataFrame


def searchable(catalog: DataFrame, tools: Tools) -> tuple[Side, Side]:
    """The distinct texts of the catalog, within their types and over all: what searches take from it, whatever the inputs."""
    bt = F.coalesce(F.lower(F.trim("basictype")), F.lit(""))
    units = settled(catalog.filter("clean_text <> ''").groupBy("clean_text", bt.alias("bt")).agg(F.min("source_pos").alias("uid")))
    texts = units.groupBy("clean_text").agg(F.min("uid").alias("uid"))
    coded = lambda rows: settled(V.encode(rows, "clean_text", tools.encoder))
    words = lambda rows, *on: settled(_tokens(rows, "uid", "clean_text", *on))
    a, b, c, d = together(lambda: coded(units), lambda: words(units, "bt"), lambda: coded(texts), lambda: words(texts))
    return Side(a, b), Side(c, d)


def retrieve(spark: SparkSession, rest: DataFrame, catalog: DataFrame, tools: Tools, met: Callable[[], tuple[Side, Side]] | None = None) -> DataFrame:
    """uid, pool (filtered or open), cand, score: fused dense and sparse hits of up to three queries an input.

    Distinct queries meet distinct texts of the catalog (within the type, or over all); the lowest position stands for a text.
    met: gives searchable() of the catalog, where that was begun before.
    """
    queries = V.expand_queries(_asked(rest), "uid", F.col("clean_text"), F.col("_guard"), F.col("_stripped"))
    queries = settled(queries.filter("query <> ''").withColumn("query_id", F.md5(F.concat_ws("\u0001", "query", F.coalesce("bt", F.lit(""))).cast("binary"))))
    # searches count their sides and read them in blocks: what is encoded is kept, so that it is encoded once
    asked = settled(V.encode(queries.select("query_id", "query", "bt").distinct(), "query", tools.encoder))
    units, texts = met() if met else searchable(catalog, tools)

    def hybrid(ask: DataFrame, side: Side, same: str | None) -> DataFrame:
        on = [same] if same else []
        dense, sparse = together(
            lambda: settled(V.dense_top_k(spark, ask, side.coded, tools.retrieved, same=same)),
            lambda: settled(V.sparse_top_k(settled(_tokens(ask, "query_id", "query", *on)), side.words, tools.retrieved, same)),
        )  # written, or they would be done one behind the other, where they are read
        return V.hybrid_search(dense, sparse, tools.retrieved).select("query_id", F.col("uid").alias("cand"), "score")

    filtered, open_ = together(lambda: hybrid(asked.filter("bt IS NOT NULL"), units, "bt"), lambda: hybrid(asked.filter("bt IS NULL").drop("bt"), texts, None))
    hits = filtered.unionByName(open_)
    pool = F.when(F.col("kind") == "filtered", "filtered").otherwise("open")
    return queries.join(hits, "query_id").select("uid", pool.alias("pool"), "cand", "score")


def candidates(spark: SparkSession, rest: DataFrame, catalog: DataFrame, tools: Tools, met: Callable[[], tuple[Side, Side]] | None = None) -> DataFrame:
    """uid, pool, cand, score, rerank_score and both rows' texts: the reranked pools, of ``pool`` distinct texts at most."""
    texts = catalog.select(F.col("source_pos").alias("cand"), F.col("clean_text").alias("c_clean_text"))
    hits = retrieve(spark, rest, catalog, tools, met).join(texts, "cand")
    hits = hits.select(F.struct("uid", "pool").alias("q"), F.col("cand").alias("uid"), "score", "c_clean_text")
    kept = V.candidate_pool(hits, "q", "c_clean_text", tools.pool)
    pairs = settled(kept.select("q.uid", "q.pool", F.col("uid").alias("cand"), "score", "c_clean_text").join(rest.select("uid", "clean_text"), "uid"))  # read for its texts, and for its scores
    return V.rerank(pairs, "clean_text", "c_clean_text", tools.scorer)


def of_inputs(pool: DataFrame, rest: DataFrame) -> DataFrame:
    """The candidates of each input of ``rest`` (uid, unit), from those of its unit."""
    return pool.withColumnRenamed("uid", "unit").join(rest.select("uid", "unit"), "unit").select(*pool.columns)


def gate(pool: DataFrame, rest: DataFrame, catalog: DataFrame, tools: Tools) -> DataFrame:
    """The ``gated`` best candidates of each unit's pools by rerank score, for each of its inputs with score, status and notes of the domain's gates."""
    best = V.top_k(pool.withColumn("q", F.struct("uid", "pool")), "q", "rerank_score", "cand", tools.gated, "rerank_rank").drop("q")
    best = of_inputs(best, rest)
    mine = rest.select("uid", "clean_no_weights", "weight_val", "price", "category", "predicted_bt", F.struct("brand", "flavor").alias("entities"))
    theirs = catalog.select(
        F.col("source_pos").alias("cand"),
        F.col("clean_no_weights").alias("c_clean_no_weights"),
        F.col("weight_val").alias("c_weight_val"),
        F.col("price").alias("c_price"),
        F.col("basictype").alias("c_basictype"),
        T.comma_list(F.col("generic_keywords")).alias("c_generic_keywords"),
        F.col("category").alias("c_categories"),
        F.struct("brand", "flavor").alias("c_entities"),
    )
    pairs = best.withColumnRenamed("score", "retrieval_score").join(mine, "uid").join(theirs, "cand").withColumn("raw_score", F.col("rerank_score"))
    gates = GT.market_gates if tools.domain == "market" else GT.food_gates
    return gates(settled(GT.with_ratios(settled(pairs))))  # pairs are read for their texts, and for themselves


def _keywords(rows: DataFrame, tools: Tools) -> DataFrame:
    """``rows`` (gk, flavor, c_flavor) with the domain's keyword filter on gk."""
    if tools.flavors is None:
        return rows
    if tools.domain == "market":
        return rows.withColumn("gk", M.filter_market_keywords(F.col("gk"), F.array_union(F.coalesce("flavor", _none()), F.coalesce("c_flavor", _none()))))
    words = rows.select(F.explode("gk").alias("k")).distinct()
    named = D.scan(words, tools.flavors, "k", "k").select("k", "alias", "canonical")
    named = rows.select("uid", F.explode("gk").alias("k")).join(named, "k").groupBy("uid").agg(F.collect_set("alias").alias("_specific"), F.collect_set(F.struct("alias", "canonical")).alias("_terms"))
    out = rows.join(named, "uid", "left")
    # an alias of a flavor that the input has is supported too
    own = F.transform(F.filter("_terms", lambda t: F.array_contains("flavor", t["canonical"])), lambda t: t["alias"])
    kept = M.filter_food_keywords(F.col("gk"), own, F.col("_specific"))
    return out.withColumn("gk", F.when(F.col("_specific").isNull(), F.col("gk")).otherwise(kept)).drop("_specific", "_terms")


def _template_side(catalog: DataFrame, tools: Tools) -> Callable[[], tuple[DataFrame, DataFrame, DataFrame]]:
    """Begins what templates take from the catalog, whatever the inputs: its rows as they need them, offers() of these, and the tags that are known."""
    rows = catalog.select("source_pos", "name", "clean_text", "basictype", T.comma_list(F.col("generic_keywords")).alias("keywords"), "brand", "flavor")
    given = tools.dictionary if tools.dictionary is not None else catalog.sparkSession.createDataFrame([], "tag_type string, tag string")
    return begun(lambda: (rows, *together(lambda: H.offers(rows, True), lambda: settled(H.dictionary_or_catalog(given, rows)))))


def _templates(rows: DataFrame, inputs: DataFrame, side: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """Tag suggestions for the rows that aren't sure yet."""
    open_ = rows.filter(~F.col("status").isin("High Confidence", "AUTO")).select("uid", "bt")
    mine = inputs.select("uid", "name", "clean_text", "brand", "flavor").join(open_, "uid")
    theirs, offered, known = side()
    return settled(H.suggest(mine, theirs, known, offered=lambda: offered))


def prepared(inputs: DataFrame, catalog: DataFrame, tools: Tools) -> tuple[Tools, DataFrame, DataFrame]:
    """``tools`` with the dictionaries written, and both sides cleaned, with entities, once. Only food names need the dictionaries to be cleaned."""
    i = _default(inputs, price="double", category="string", predicted_bt="string", bt_confidence="double", bt_source="string")
    c = _default(catalog, price="double", category="string")
    i, dictionaries = _default(i, description="string"), begun(lambda: written(tools))

    def side(rows: Callable[[], DataFrame], uid: str) -> DataFrame:
        clean = settled(M.prepare(rows()))
        return settled(with_entities(clean, dictionaries(), uid))

    i, c = together(lambda: side(lambda: enriched(i, dictionaries()) if tools.domain == "food" else i, "uid"), lambda: side(lambda: c, "source_pos"))
    return dictionaries(), i, c


def stages(spark: SparkSession, inputs: DataFrame, catalog: DataFrame, tools: Tools, left: Callable[[DataFrame, Tools], None] | None = None) -> Stages:
    """inputs: uid, name, and optionally price, category, predicted_bt, bt_confidence, bt_source; catalog: source_pos, name, basictype,
    generic_keywords, and optionally price, category.

    final: uid, name, matched_pos, matched_catalog_name, bt, gk, score, status, match_source, logic_notes; a row an input, no rules.
    What searches take from the catalog is made beside the keys, what templates take beside the gates. left: is given the inputs that no key reached, as soon as they are known.
    """
    tools, i, c = prepared(inputs, catalog, tools)
    met = begun(lambda: searchable(c, tools))
    found = settled(M.cascade(i, c))
    rest = settled(with_units(i.join(found.filter("match_source = 'vector'").select("uid"), "uid", "left_semi")))
    if left:
        left(rest, tools)
    pool = settled(candidates(spark, rest.filter("uid = unit"), c, tools, met))
    side = _template_side(c, tools)
    gated = settled(gate(pool, rest, c, tools))
    winner = lambda name: M.pick_winner(gated.filter(F.col("pool") == name), top=tools.gated)
    chosen = settled(M.choose_pool(rest, winner("filtered"), winner("open")))
    keyed = found.filter("match_source <> 'vector'").select("uid", "matched_pos", "score", F.lit("High Confidence").alias("status"), "match_source", "logic_notes")
    searched = chosen.select("uid", F.col("cand").alias("matched_pos"), "score", "status", F.lit("vector").alias("match_source"), F.col("notes").alias("logic_notes"))
    theirs = c.select(F.col("source_pos").alias("matched_pos"), F.col("name").alias("matched_catalog_name"), F.col("basictype").alias("bt"), T.comma_list(F.col("generic_keywords")).alias("gk"), F.col("flavor").alias("c_flavor"))
    rows = keyed.unionByName(searched).join(i.select("uid", "name", "flavor"), "uid").join(theirs, "matched_pos", "left").withColumn("gk", F.coalesce("gk", _none()))
    rows = settled(_keywords(rows, tools).drop("flavor", "c_flavor"))
    tips = _templates(rows, i, side)
    final = H.enrich(rows.withColumn("bt_confidence", F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0))), tips, "matcher")
    final = final.select("uid", "name", "matched_pos", "matched_catalog_name", "bt", "gk", "score", "status", "match_source", "logic_notes")
    return Stages(tools, i, c, found, of_inputs(pool, rest), gated, chosen, tips, final)


def match(spark: SparkSession, inputs: DataFrame, catalog: DataFrame, tools: Tools) -> DataFrame:
    return stages(spark, inputs, catalog, tools).final
