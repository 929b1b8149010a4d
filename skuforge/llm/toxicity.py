"""Toxicity scores by a classifier whose score must not depend on which group a sentence names.

A logistic model over the distinct words and stems of a text is fitted on a bounded sample of labelled rows (SAMPLE, by hash of
doc_id, held-out rows never among them). Each sampled text that names a group has counterfactuals: its identity terms are
swapped for others of the same kind, pronouns too. Besides the log loss, the square of the score's change under each swap is penalised,
so that weight cannot rest on the mention itself. Scoring is one pass over the texts with the word weights (bounded by
the sample) broadcast; nothing is shuffled. labels, lang, source and doc_id are no inputs of a score.

Cases: null text counts as empty and scores what a text without known words does; null doc_id is not held out; repeated
labels of a document count as toxic if one does; of rows that repeat a doc_id one is fitted and all are scored; without labels of both classes the score is 0; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage, table, text_or_empty

#: Labelled rows that the model is fitted on at most.
SAMPLE = 8000
#: Identity terms by kind and language; terms of one kind stand in for each other.
IDENTITY = {
    "gender": "women men woman man girls boys girl boy female male transgender",
    "gender, French": "femme homme femmes hommes fille garçon filles garçons",
    "gender, German": "frau mann frauen männer mädchen junge",
    "gender, Spanish": "mujer hombre mujeres hombres chica chico",
    "pronoun": "he she",
    "pronoun, French": "il elle",
    "pronoun, German": "er sie",
    "pronoun, Spanish": "él ella",
    "faith": "muslim christian jewish hindu buddhist atheist muslims christians jews hindus buddhists atheists",
    "faith, French": "musulman chrétien juif bouddhiste athée musulmans chrétiens juifs",
    "faith, German": "muslime christen juden buddhisten atheisten",
    "faith, Spanish": "musulmán cristiano judío budista ateo musulmanes cristianos judíos",
    "origin": "black white asian african european american latino arab mexican chinese indian german french spanish immigrants natives",
    "origin, French": "noirs blancs arabes africains européens chinois allemands immigrés",
    "origin, German": "schwarze weiße araber afrikaner europäer chinesen franzosen einwanderer",
    "origin, Spanish": "negros blancos árabes africanos europeos chinos alemanes inmigrantes",
    "orientation": "gay straight lesbian heterosexual bisexual homosexual queer",
    "ability": "disabled blind deaf autistic",
    "age": "old young elderly teenage",
}
WORDS = re.compile(r"[^\W\d_]+")


def with_stems(words: set[str]) -> set[str]:
    """Distinct words, and the stems (first five letters) of longer ones."""
    return words | {w[:5] + "-" for w in words if len(w) > 6}


def words_of(text: str) -> set[str]:
    return with_stems(set(WORDS.findall(text.lower())))


def swaps(words: set[str]) -> list[set[str]]:
    """The same words with the identity terms of one kind exchanged for another term of it, twice a kind; stems go and come with them.

    words: as words_of() gives them. Stand-ins are drawn from all other terms of the kind, by hash of term and words.
    """
    out, whole = [], {w for w in words if not w.endswith("-")}
    own = zlib.crc32(" ".join(sorted(whole)).encode())
    for terms in (v.split() for v in IDENTITY.values()):
        named = whole & set(terms)
        if named:
            others = sorted((t for t in terms if t not in named), key=lambda t: hashlib.sha256(f"{own} {t}".encode()).digest())
            out += [with_stems((whole - named) | {o}) for o in others[:2]]
    return out


def informative(rows: DataFrame, least: int = 3, z: float = 3.5) -> list[str]:
    """Words in at least ``least`` rows whose share among toxic rows differs from the others' by z standard errors, and identity terms.

    rows: toxic, words. Counted on the executors; what comes back is bounded by the sample's vocabulary.
    """
    n, n1 = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n1 = n1 or 0
    if not 0 < n1 < n:
        return []
    k, k1, p = F.col("k"), F.col("k1"), F.col("k") / n
    error = F.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
    named = F.col("word").isin([w for v in IDENTITY.values() for w in v.split()])
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.sum("toxic").alias("k1"))
    kept = counts.filter(named | (k >= least) & (error > 0) & (F.abs(k1 / n1 - (k - k1) / (n - n1)) > z * error))
    return sorted(r.word for r in kept.select("word").collect())


def fit(texts: list[set[str]], labels: list[int], words: list[str], l2: float = 1e-4, fairness: float = 20.0, rounds: int = 300, swapped: list[list[set[str]]] | None = None) -> tuple[dict[str, float], float]:
    """Weights of ``words`` and a bias, by Adam over all rows at once. swapped: each text's counterfactuals, where texts hold some words only."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return {}, -np.inf
    column = {w: k for k, w in enumerate(words)}
    x = [[column[w] for w in t if w in column] for t in texts]
    row, col = np.repeat(np.arange(len(x)), [len(r) for r in x]), np.array([c for r in x for c in r], dtype=np.int64)
    base, pair, word, sign = [], [], [], []
    for k, t in enumerate(texts):
        for s in swaps(t) if swapped is None else swapped[k]:
            for w in (t ^ s) & column.keys():
                pair.append(len(base))
                word.append(column[w])
                sign.append(1.0 if w in s else -1.0)
            base.append(k)
    base, pair, word, sign = (np.array(v, dtype=kind) for v, kind in ((base, np.int64), (pair, np.int64), (word, np.int64), (sign, float)))
    weight = np.where(y == 1, ((1 - y).sum() / y.sum()) ** 0.5, 1.0)
    weight /= weight.sum()
    n, d = len(y), len(column)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, rounds + 1):
        logit = np.bincount(row, w[col], n) + w[d]
        p = 1 / (1 + np.exp(-logit))
        by_row = weight * (p - y)
        g = np.zeros(d + 1)
        if len(base):
            q = 1 / (1 + np.exp(-(logit[base] + np.bincount(pair, sign * w[word], len(base)))))
            c = 2 * fairness * (p[base] - q) / len(base)
            by_row = by_row + np.bincount(base, c * (p[base] * (1 - p[base]) - q * (1 - q)), n)
            g[:d] -= np.bincount(word, (c * q * (1 - q))[pair] * sign, d)
        g[:d] += np.bincount(col, by_row[row], d) + l2 * w[:d]
        g[d] = by_row.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / ((v / (1 - 0.999**step)) ** 0.5 + 1e-9)
    return dict(zip(column, w[:d].tolist(), strict=True)), float(w[d])


def unfairness(model: tuple[dict[str, float], float], texts: list[str]) -> tuple[int, float, int]:
    """Of texts: the number of counterfactuals, the mean change of the score under them, and how many turn a verdict."""
    pairs = [(score(*model, t), of_words(*model, s)) for t in texts for s in swaps(words_of(t))]
    return len(pairs), float(np.mean([abs(a - b) for a, b in pairs])) if pairs else 0.0, sum((a >= 0.5) != (b >= 0.5) for a, b in pairs)


def score(weights: dict[str, float], bias: float, text: str) -> float:
    return of_words(weights, bias, words_of(text))


def of_words(weights: dict[str, float], bias: float, words: set[str]) -> float:
    if bias == -np.inf:  # no model
        return 0.0
    total = bias + sum(weights[w] for w in sorted(words & weights.keys()))
    return float(1 / (1 + np.exp(-min(max(total, -500.0), 500.0))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Fits on at most ``sample`` labelled rows that aren't held out, one for each doc_id. The ids are broadcast: they are bounded by ``sample``.

    Of rows that share a labelled doc_id, the one with the smallest digest of its text is taken, whatever their number.
    """
    small_batches(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": (pdf["toxic"] > 0).astype(int), "words": [sorted(words_of(t)) for t in pdf["text"]]})

    joined = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    joined = stage(spark, joined, "toxicity-labelled")
    # digests are combined before their shuffle; equal texts of one id leave one row in all
    first = joined.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    joined = joined.join(first, ["doc_id", "digest"]).dropDuplicates(["doc_id"])
    rows = stage(spark, joined.mapInPandas(run, "doc_id long, toxic int, words array<string>"), "toxicity-sample")
    words = informative(rows)
    known_words = set(words)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": [" ".join(w for w in t if w in known_words) for t in pdf["words"]], "swapped": [[" ".join(sorted(s & known_words)) for s in swaps(set(t))] for t in pdf["words"]]})

    # counterfactuals are made of all words: a stem stays where a word that isn't known has it too
    sampled = rows.mapInPandas(told, "doc_id long, toxic int, words string, swapped array<string>").toPandas().sort_values(["doc_id", "words"])
    return fit([set(t.split()) for t in sampled["words"]], sampled["toxic"].tolist(), words, swapped=[[set(s.split()) for s in own] for own in sampled["swapped"]])


def scored(spark: SparkSession, docs: DataFrame, model: tuple[dict[str, float], float], name: str = "toxicity_score") -> DataFrame:
    """``docs`` with one more column, ``name``; a column of that name is replaced."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(text: pd.Series) -> pd.Series:
        weights, bias = shared.value
        return pd.Series([score(weights, bias, t) for t in text], dtype=float)

    return docs.withColumn(name, toxicity(text_or_empty()))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(spark, docs.select("doc_id", "text"), train(spark, docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
