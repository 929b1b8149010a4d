"""Streams: tagging of arriving product files, live volume, and catalog upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tag_stream(products: DataFrame, tag: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Tags each micro-batch of a stream of products. A batch's rows go to their own folder, replaced when it is run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tag(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return products.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_volume(rows: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "10 minutes", value: str = "confidence") -> DataFrame:
    """start, n, mean by tumbling window; rows later than the watermark are dropped."""
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late).groupBy(F.window(at, size)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def _part(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The rows of ``path/kind`` with the number of their batch, or None where nothing was written yet."""
    try:
        return spark.read.parquet(f"{path}/{kind}").withColumn("batch", F.col("batch").cast("long"))
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The table of ``upsert_stream`` as of batch ``upto`` (the last by default): of each uid the row of its last batch.

    Reads the last finished whole table and the changes since; earlier folders are pruned, and so is a table whose writing broke off.
    """
    past = lambda df: df if df is None or upto is None else df.filter(F.col("batch") <= upto)
    finished, changes = past(_part(spark, path, "finished")), past(_part(spark, path, "changes"))
    last = None if finished is None else finished.agg(F.max("batch")).first()[0]
    rows = changes
    if last is not None:
        rows = _part(spark, path, "whole").filter(F.col("batch") == last)
        if changes is not None:
            rows = rows.unionByName(changes.filter(F.col("batch") > last))
    if rows is None:
        raise ValueError(f"nothing was written to {path} yet")
    return rows.groupBy("uid").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("uid", "batch")]), "batch").alias("r")).select("uid", "r.*")


def _write_whole(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/whole/batch={batch}")
    rows.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/finished/batch={batch}")


def start_table(rows: DataFrame, path: str) -> None:
    """Makes ``rows`` (uid, row_hash, ...), one a uid, the table that a stream of changes starts from."""
    _write_whole(rows, path, -1)


def upsert_stream(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str, at: str = "ts", late: str = "1 hour", every: int = 50) -> StreamingQuery:
    """Applies a stream of catalog rows (uid, row_hash, ...) to the table under ``path``, read by ``current``; repeats within the watermark count once.

    A batch writes its own changes alone, one row a uid (the latest, ties by hash), to its own folder; each ``every`` batches the whole table is
    written anew, so the work of a batch does not grow with the table. A batch that is run again writes the same folders. Folders of
    batches before the last whole table are not read any more and can be cleared.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("uid").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "uid"]), F.struct(at, "row_hash")).alias("r")).select("uid", "r.*")
        new.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        finished = _part(spark, path, "finished")
        if (batch_id + 1) % every == 0 and (finished is None or finished.filter(F.col("batch") == batch_id).isEmpty()):
            older = current(spark, path, batch_id - 1) if batch_id or finished is not None else None
            rows = new if older is None else older.join(new.select("uid"), "uid", "left_anti").unionByName(new)
            _write_whole(rows, path, batch_id)

    once = changes.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["uid", "row_hash"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
