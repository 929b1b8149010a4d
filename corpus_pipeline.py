"""The corpus pipeline: toxic documents go, exact and near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``. A stage's result is written as
Parquet and read again as the next one's ``docs``. The mixing stage writes its rows in order, so that file and row index tell
the last stage each row's place in the mixture, which it returns as ``position``.

Cases, in every stage: null text counts as empty, and any text however long is one row; rows are told apart by their numbers, so null
and repeated doc_ids are rows like others (toxicity decides by text, dedup keeps one row a group); a null source is a source of its own;
ties are broken by doc_id, nulls last, then by row; further columns of any name pass through all stages but the last; an empty table
gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm import byte_bpe, exact_dedup, pfair_mixing, simhash, toxicity
from skuforge.llm.common import numbered, row_ids, small_batches, stage, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below one half. The model is fitted on labelled documents of ``docs`` outside the held-out fold."""
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "_score")
    return toxicity.scored(spark, docs, model, score).filter(F.col(score) < 0.5).drop(score)


def _one_a_group(spark: SparkSession, rows: DataFrame, number: str, groups: DataFrame, last: bool) -> DataFrame:
    """Of each group the row with the smallest or the last doc_id, null ids after all others, then the smallest or last row.

    rows: column ``number``, doc_id and more. groups: row and group. A row is chosen by its number, so null and repeated ids are safe.
    """
    ids = rows.select(F.col(number).alias("of"), "doc_id")
    known = stage(spark, groups.join(ids, F.col("row") == F.col("of")).drop("of"), "grouped")
    pick, order = (F.max, F.col("doc_id").isNotNull()) if last else (F.min, F.col("doc_id").isNull())
    kept = known.groupBy("group").agg(pick(F.struct(order.alias("ordered"), "doc_id", "row")).alias("pick"))
    kept = kept.select(F.col("pick.row").alias("kept"))
    # texts meet only the numbers of the rows that go, the fewer ones as a rule
    name = unused(rows, "_gone")
    gone = stage(spark, known.join(kept, F.col("row") == F.col("kept"), "left_anti").select(F.col("row").alias(name)), "gone")
    return rows.join(gone, F.col(number) == F.col(name), "left_anti").drop(number)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts: the largest doc_id, ids before nulls, the last such row."""
    number = unused(docs, "_row")
    rows = row_ids(spark, docs, number)
    # the operator tells rows apart by their numbers: doc_ids may be null or repeated
    groups = exact_dedup.exact_dedup(spark, rows.select(F.col(number).alias("doc_id"), "text"))
    return _one_a_group(spark, rows, number, groups.select(F.col("doc_id").alias("row"), F.col("text_sha256").alias("group")), last=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id, ids before nulls, the first such row."""
    number = unused(docs, "_row")
    rows = row_ids(spark, docs, number)
    groups = simhash.simhash_groups(spark, rows.select(F.col(number).alias("doc_id"), "text"))
    return _one_a_group(spark, rows, number, groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), last=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source")  # names that mixing uses stay untouched within
    return pfair_mixing.mix(spark, packed).orderBy("slot", "place").select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of every document, and its position in the mixture, from 0."""
    import public_tokenizers as public

    small_batches(spark)
    rows = row_ids(spark, docs.drop("position"), "position")
    digests = byte_bpe.encode_digests(rows, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, "position")
    digests = stage(spark, digests.withColumnRenamed("position", "row"), "digests")
    return numbered(spark, digests, "position", "row")  # the digests are narrow; texts meet no join


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: Toxicity scores and fingerprints are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(spark, function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
