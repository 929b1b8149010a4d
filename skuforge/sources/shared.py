"""The folder that all executors share, checkpoints in it, and steps that run at the same time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Whether shuffle files go when the execution that wrote them ends. By Spark's default they stay until the driver collects garbage, so a plan of many steps holds those of all.
SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where it is unset and Spark runs locally, as in tests."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="skuforge-")
    return _OWN[sc.applicationId]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, its lineage cut, and the planner's estimate of its size with it.

    A checkpoint keeps that estimate, for a join the product of both sides' bytes. From checkpoint to checkpoint the digits add up, and a plan of many
    joins soon spends its time on multiplying them, and never broadcasts. A table's estimate is its files' size.
    """
    spark = df.sparkSession
    if SWEPT not in spark.conf.getAll:  # a session that sets it keeps its choice
        spark.conf.set(SWEPT, "true")
    path = f"{folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*steps: Callable[[], Any]) -> list[Any]:
    """What the steps return, in their order; steps that don't need each other run at the same time, as the jobs of one seldom fill all cores."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(step)) for step in steps]]


def begun(step: Callable[[], Any]) -> Callable[[], Any]:
    """The step begins at once, beside what follows; the function that is returned waits for it and gives what it returns, however often it is called."""
    pool = ThreadPoolExecutor(1)
    found = pool.submit(inheritable_thread_target(step))
    pool.shutdown(wait=False)
    return found.result
