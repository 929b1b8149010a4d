"""The tagging plans: classification with rules, the whole run, and their common steps: shaping, escalation, rules, traces and statistics.

Matching is match() of matcher.py, which applies no rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuforge.functions import text as T
from skuforge.operators import classify as G
from skuforge.operators import rules as R
from skuforge.operators import templates as H
from skuforge.plans import classifier, matcher
from skuforge.sources.shared import begun, settled

WEAK = ["Medium Confidence", "Low / Rejected", "Rejected"]


def shape(raw: DataFrame) -> DataFrame:
    """uid, name, price, description, category with defaults for nulls; the name may come as sku_name or sku."""
    have = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in raw.columns], F.lit(""))
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0)) if "price" in raw.columns else F.lit(0.0)
    return raw.select("uid", F.trim(have("name", "sku_name", "sku")).alias("name"), price.alias("price"), have("description").alias("description"), have("category").alias("category"))


def classify(spark: SparkSession, inputs: DataFrame, catalog: DataFrame, tools: matcher.Tools, rules: list[R.Rule], **models: DataFrame) -> DataFrame:
    """Classified inputs after the rules: a row an input with its tags and the rules that fired."""
    c = classifier.classify(spark, inputs, catalog, tools, **models)
    own = "category" if tools.domain == "market" else "region"
    rows = c.rows.join(inputs.select("uid", "name"), "uid").withColumn(own, F.col("third_tag"))
    return with_rules(rows, rules)


def escalate(matched: DataFrame, classified: DataFrame) -> DataFrame:
    """Matched rows, where weak ones take the classifier's tags if its confidence is above the match's score (1 at most); notes are chained."""
    c = classified.select("uid", F.struct("bt", "bt_confidence", "bt_status", "gk", "reasoning").alias("c"))
    rows = matched.join(c, "uid", "left")
    weak = F.col("status").isin(WEAK) & F.col("c").isNotNull()
    won = weak & (F.col("c.bt_confidence") > F.least(F.col("score"), F.lit(1.0)))
    prior = F.trim("logic_notes")
    notes = F.when(prior != "", F.concat(F.lit("Escalated from matcher ["), prior, F.lit("] -> "), F.col("c.reasoning"))).otherwise(F.col("c.reasoning"))
    return rows.select(
        "uid", "name", "matched_catalog_name", "score", "status",
        F.when(won, F.col("c.bt")).otherwise(F.col("bt")).alias("bt"),
        F.when(won, F.col("c.gk")).otherwise(F.col("gk")).alias("gk"),
        F.when(won, F.col("c.bt_confidence")).otherwise(F.greatest(F.col("score"), F.lit(0.0))).alias("bt_confidence"),
        F.when(won, "Classifier").otherwise("Matcher").alias("pipeline_source"),
        weak.alias("escalated"),
        F.when(won, notes).otherwise(F.col("logic_notes")).alias("logic_notes"),
    )


def run(spark: SparkSession, inputs: DataFrame, catalog: DataFrame, tools: matcher.Tools, rules: list[R.Rule], **models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole pipeline, and its trace: match, classification of weak rows, escalation, templates, rules.

    Returns a row an input with its tags, and for each input a row of structs of what every stage saw and decided.
    """
    beside = []

    def left(rest: DataFrame, tools: matcher.Tools) -> None:
        """Rows that classification may get are read beside the searches, then the catalog; only the weak rows are encoded, once they are known."""
        own = rest.drop("brand", "flavor").select(*inputs.columns)
        names = begun(lambda: settled(classifier.named(own, tools)))

        def about() -> classifier.Known:
            names()
            return classifier.known(catalog, tools)

        beside.extend([names, begun(about)])

    m = matcher.stages(spark, inputs, catalog, tools, left)
    names, about = beside
    weak = m.final.filter(F.col("status").isin(WEAK)).select("uid")
    c = classifier.classified(spark, names().join(weak, "uid", "left_semi"), about, m.tools, **models)
    joined = escalate(m.final, c.rows)
    third = c.rows.select("uid", "third_tag")
    done = H.enrich(joined, m.templates, "matcher").join(third, "uid", "left").withColumn("category" if tools.domain == "market" else "region", F.col("third_tag")).drop("third_tag")
    ruled = with_rules(done, rules)
    return ruled, trace(m, c, joined, ruled)


def trace(m: matcher.Stages, c: classifier.Classified, joined: DataFrame, final: DataFrame) -> DataFrame:
    """One wide row an input: input, keys, candidates, gates, match, template, classification, keywords, escalation, final; null where a stage passed it by."""
    pack = lambda df, name, cols=None: df.select("uid", F.struct(*[x for x in cols or df.columns if x != "uid"]).alias(name))

    def many(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
        return df.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    out = pack(m.inputs, "input", ["name", "clean_text", "weight_val", "brand", "flavor"])
    stages = [
        pack(m.keyed, "keys"),
        many(m.candidates, "candidates", ["pool", "cand", "score", "rerank_score"]),
        many(m.gated, "gates", ["pool", "cand", "raw_score", "token_ratio", "typo_ratio", "brand_check", "flavor_check", "gate_raw", "score", "status", "notes"]),
        pack(m.final, "match"),
        pack(m.templates, "template"),
        pack(c.rows, "classification"),
        many(c.keywords, "keywords", ["tag", "source", "score", "allowed", "above_cut", "selected", "pruned"]),
        pack(joined, "escalation", ["escalated", "pipeline_source", "bt", "logic_notes"]),
        pack(final, "final", [x for x in final.columns if x in ("bt", "gk", "status", "rules_applied", "category", "region")]),
    ]
    for df in stages:
        out = out.join(df, "uid", "left")
    return out


def with_rules(rows: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """Tagged rows after the rules; columns a rule may read or set are added as nulls where they are missing."""
    record = rows.withColumn("sku_name", F.col("name"))
    for c, kind in R.RECORD.items():
        if c not in record.columns:
            record = record.withColumn(c, F.lit(None).cast(kind))
    return R.apply_rules(record, rules).drop("flavors", "flavor_kinds")


def audit_rows(results: DataFrame, task: str, domain: str, job: str) -> DataFrame:
    """Results in the shape of the audit table; source and confidence depend on the task."""
    have = lambda c, kind: F.col(c) if c in results.columns else F.lit(None).cast(kind)
    source = F.lit(task) if task in ("matcher", "classifier") else F.coalesce(have("pipeline_source", "string"), F.lit(""))
    confidence = {"matcher": have("score", "double"), "classifier": have("bt_confidence", "double")}.get(task, F.coalesce(have("bt_confidence", "double"), have("score", "double")))
    return results.select(
        F.col("uid").alias("sku_uid"), F.lit(job).alias("job_id"), F.col("name").alias("sku_name"), F.lit(domain).alias("domain"), F.coalesce(have("bt", "string"), F.lit("")).alias("bt"),
        F.coalesce(have("gk", "array<string>"), F.array().cast("array<string>")).alias("gk"), confidence.alias("confidence"), source.alias("match_source"),
        have("matched_catalog_name", "string").alias("matched_catalog_name"), F.coalesce(have("score", "double"), F.lit(0.0)).alias("match_score"), F.coalesce(have("logic_notes", "string"), F.lit("")).alias("logic_notes"),
    )


def run_statistics(results: DataFrame, task: str) -> DataFrame:
    """total, high, medium, low, match_rate; by status for matches, by confidence for classifications."""
    n = F.count(F.lit(1))
    if task == "classifier":
        high, medium = F.col("bt_status") == "AUTO", F.col("bt_status") == "REVIEW"
    else:
        high, medium = F.col("status").isin("High Confidence", "AUTO"), F.col("status").isin("Medium Confidence", "REVIEW")
    h, m = F.count_if(high), F.count_if(medium)
    return results.agg(n.alias("total"), h.alias("high"), m.alias("medium"), (n - h - m).alias("low"), F.round(h / F.greatest(n, F.lit(1)), 4).alias("match_rate"))


def candidate_trace(candidates: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` candidates of each input with raw score, token penalty and brand boost (for the trace alone; gates use the raw score).

    candidates: uid, cand, input_text, cand_text, brand, rerank_score.
    """
    penalty = F.when(T.token_count(F.col("cand_text")) > T.token_count(F.col("input_text")) + 2, -2.0).otherwise(0.0)
    boost = F.when(F.coalesce(F.lower("cand_text").contains(F.lower("brand")), F.lit(False)), 1.0).otherwise(0.0)
    rows = candidates.withColumns({"token_penalty": penalty, "brand_boost": boost, "rank": F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("rerank_score"), "cand"))})
    return rows.filter(F.col("rank") <= top)


def win_loss(candidates: DataFrame) -> DataFrame:
    """``candidates`` (uid, cand, score) with won, and a note that sets each beside the best."""
    w = Window.partitionBy("uid").orderBy(F.desc("score"), "cand").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, name = F.first("score").over(w), F.first("cand").over(w)
    won = F.col("cand") == name
    return candidates.withColumns({"won": won, "note": F.when(won, F.format_string("won with %.4f", "score")).otherwise(F.format_string("lost by %.4f to %s", best - F.col("score"), name.cast("string")))})


def keyword_decisions(sources: list[tuple[str, DataFrame]], selected: DataFrame) -> DataFrame:
    """uid, tag, source, score, selected: each considered keyword with the first source (in the given order) that named it.

    sources: (name, table of uid, tag, score); selected: uid, tag.
    """
    every = None
    for k, (name, df) in enumerate(sources):
        part = df.select("uid", "tag", F.col("score").cast("double").alias("score"), F.lit(name).alias("source"), F.lit(k).alias("_k"))
        every = part if every is None else every.unionByName(part)
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("uid", F.lower("tag")).orderBy("_k", "tag"))).filter("_n = 1")
    chosen = selected.select(F.col("uid").alias("_u"), F.lower("tag").alias("_t")).distinct()
    return first.join(chosen, (F.col("uid") == F.col("_u")) & (F.lower("tag") == F.col("_t")), "left").select("uid", "tag", "source", "score", F.col("_u").isNotNull().alias("selected"))
