"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where it is unset and Spark runs locally, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN_FOLDER.setdefault(app, "") or tempfile.mkdtemp(prefix="skuforge-")
        _OWN_FOLDER[app] = base
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut lineage that survives lost executors."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A row id is its part's number, then its index in the part, of so many bits.
INDEX_BITS = 39
_PART = r"^part-(\d{1,7})-"


def row_ids(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` with a long ``name``, unique to each row, the same at every read and growing in the order in which rows were written.

    It is made of a Parquet file's part number and the row's index there, so nothing is joined, counted or sent. What is not read
    from Parquet, or from files whose part numbers are missing or repeat, is written first.
    """
    number = F.regexp_extract(F.substring_index(F.col("_metadata.file_path"), "/", -1), _PART, 1).try_cast("long")
    path, of = unused(df, "_file"), unused(df, "_of")
    try:
        files = df.select(F.col("_metadata.file_path").alias(path), number.alias(of)).groupBy(path, of).agg(F.count(F.lit(1)).alias("n"))
        n, numbers, known = files.agg(F.count(F.lit(1)), F.countDistinct(of), F.count(of)).first()
        rows = df if n == numbers == known else None
    except AnalysisException:
        rows = None
    if rows is None:
        where = new_path(spark, "rows")
        df.write.option("maxRecordsPerFile", 0).parquet(where)
        rows = spark.read.schema(df.schema).parquet(where)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft(number, INDEX_BITS) + F.col("_metadata.row_index")).alias(name))


def numbered(spark: SparkSession, df: DataFrame, name: str, ids: str | None = None) -> DataFrame:
    """``df`` with column ``name``: each row's number from 0 in the order of row_ids(), without gaps. For narrow rows: they may be shuffled once.

    ids: a column of ``df`` with row_ids(), in place of new ones; it goes. Parts are counted; the counts before a part are added up in two
    levels and meet the rows in a plain join, so no table of files is broadcast by hint or gathered.
    """
    own = ids or unused(df, "_id")
    rows = df if ids else row_ids(spark, df, own)
    part, of, before, n = (unused(rows, c) for c in ("_part", "_of", "_before", "_n"))
    rows = rows.withColumn(part, F.shiftright(F.col(own), INDEX_BITS))
    earlier = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stage(spark, rows.groupBy(F.col(part).alias(of)).agg(F.count(F.lit(1)).alias(n)).withColumn("group", F.shiftright(of, 10)), "parts")
    groups = sizes.groupBy("group").agg(F.sum(n).alias(n)).select(F.col("group").alias("g"), earlier(Window.orderBy("group")).alias("base"))
    starts = sizes.withColumn("own", earlier(Window.partitionBy("group").orderBy(of))).join(groups, F.col("group") == F.col("g"))
    starts = stage(spark, starts.select(of, (F.col("base") + F.col("own")).alias(before)), "part-starts")
    index = F.col(own).bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    kept = [F.col(f"`{c}`") for c in df.columns if c != ids]
    return rows.join(starts, F.col(part) == F.col(of)).select(*kept, (F.col(before) + index).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker's memory is bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def id_text(name: str = "doc_id") -> Column:
    """A long id as text, for its way through pandas, which would round longs beside a null. id_long() undoes it."""
    return F.col(name).cast("long").cast("string").alias(name)


def id_long(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)
