"""Search and reporting queries over catalogs, results, jobs and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuforge.functions import text as T

#: Confidence cut-offs differ by report on purpose; each is a parameter.
DASHBOARD, JOB_FALLBACK, STATUS = (0.85, 0.60), 0.80, (0.80, 0.50)
SEVERITIES = ["CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG"]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _has(c: str, part: str) -> Column:
    return F.coalesce(F.lower(F.col(c)).contains(part.lower()), F.lit(False))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page, with the total before paging in column total."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))  # one row


def catalog_filter(catalog: DataFrame, low: float | None = None, high: float | None = None, contains: dict[str, str] | None = None, terms: list[str] = (), free: str = "", columns: list[str] = ()) -> DataFrame:
    """Price range, substrings by column, every keyword term, and free text in any of ``columns``."""
    conditions = [_has(c, v) for c, v in (contains or {}).items() if v]
    conditions += [_has("generic_keywords", t) for t in terms]
    if low is not None:
        conditions.append(F.col("price") >= low)
    if high is not None:
        conditions.append(F.col("price") <= high)
    if free:
        conditions.append(reduce(lambda a, b: a | b, [_has(c, free) for c in columns]))
    return catalog.filter(_all(conditions))


def dictionary_filter(dictionary: DataFrame, domain: str, like: str = "", tag_type: str | None = None) -> DataFrame:
    conditions = [F.col("domain") == domain, _has("tag", like)] + ([F.col("tag_type") == tag_type] if tag_type else [])
    return dictionary.filter(_all(conditions))


def dataset_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """dataset, domain, n for each table with a column domain."""
    parts = [df.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dataset"), "domain", "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def history_filter(rows: DataFrame, bt: str = "", gk: str = "", source: str = "", least: float | None = None, name: str = "") -> DataFrame:
    conditions = [_has("bt", bt)] if bt else []
    conditions += [F.exists("gk", lambda g: F.lower(g).contains(gk.lower()))] if gk else []
    conditions += [F.lower("match_source") == source.lower()] if source else []
    conditions += [F.col("confidence") >= least] if least is not None else []
    conditions += [_has("sku_name", name)] if name else []
    return rows.filter(_all(conditions))


def headline(rows: DataFrame, cuts: tuple[float, float] = DASHBOARD) -> DataFrame:
    c, n = F.coalesce("confidence", F.lit(0.0)), F.count(F.lit(1))
    high, medium, low = F.count_if(c >= cuts[0]), F.count_if((c >= cuts[1]) & (c < cuts[0])), F.count_if(c < cuts[1])
    share = lambda x: F.round(100.0 * x / F.greatest(n, F.lit(1)), 1)
    return rows.agg(n.alias("total"), F.round(F.avg(c), 4).alias("mean_confidence"), high.alias("high"), medium.alias("medium"), low.alias("low"), share(high).alias("high_pct"), share(medium).alias("medium_pct"), share(low).alias("low_pct"))


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    """value, n, pct."""
    n = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("value", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).alias("pct"))  # as many rows as values


def volume_trend(rows: DataFrame, unit: str, at: str, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """bucket, label, n by hour or day, empty buckets included; labels in local time."""
    n = rows.groupBy(F.date_trunc(unit, at).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_trunc(unit, F.lit(start).cast("timestamp")), F.date_trunc(unit, F.lit(end).cast("timestamp")), F.expr(f"interval 1 {unit}"))).alias("bucket"))
    label = F.date_format(F.from_utc_timestamp("bucket", zone), "HH:00" if unit == "hour" else "MM-dd")
    return spine.join(n, "bucket", "left").select("bucket", label.alias("label"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def window_counters(rows: DataFrame, at: str, now: str) -> DataFrame:
    ts = F.lit(now).cast("timestamp")
    since = lambda d: F.count_if((F.col(at) > ts - F.expr(f"interval {d} days")) & (F.col(at) <= ts))
    return rows.agg(F.count(F.lit(1)).alias("n_all"), since(1).alias("n_1d"), since(7).alias("n_7d"), since(30).alias("n_30d"))


def top_values(rows: DataFrame, value: Column, k: int = 10, least: int = 1) -> DataFrame:
    """value, n of the k most frequent non-blank values; ties go to the first by name."""
    n = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & ~T.blank(F.col("value")))
    return n.orderBy(F.desc("n"), "value").limit(k)


def status_counts(rows: DataFrame, kinds: dict[str, str], cuts: tuple[float, float] = STATUS) -> DataFrame:
    """kind, auto, review, low for each kind -> confidence column."""
    packed = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c), F.lit(0.0)).alias("c")) for k, c in kinds.items()]))
    c = F.col("x.c")
    return rows.select(packed.alias("x")).groupBy(F.col("x.kind").alias("kind")).agg(F.count_if(c >= cuts[0]).alias("auto"), F.count_if((c >= cuts[1]) & (c < cuts[0])).alias("review"), F.count_if(c < cuts[1]).alias("low"))


def job_summaries(jobs: DataFrame, rows: DataFrame, cut: float = JOB_FALLBACK) -> DataFrame:
    """job_id, total, high: stored counts, or where they are null those of the rows."""
    n = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("confidence") >= cut).alias("_h"))
    zero = F.lit(0).cast("long")
    return jobs.join(n, "job_id", "left").select("job_id", F.coalesce("total_count", "_t", zero).alias("total"), F.coalesce("high_count", "_h", zero).alias("high"))


def job_details(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of the given jobs with the confidence that their source stands for."""
    matched = F.lower(F.coalesce("match_source", F.lit(""))).contains("match")
    own = rows.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    return own.withColumn("shown_confidence", T.display_confidence(F.when(matched, F.coalesce("match_score", "confidence")).otherwise(F.coalesce("bt_confidence", "confidence"))))


def query_table(spark: SparkSession, name: str, columns: list[str] | None = None, where: str | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    df = spark.table(name)
    if where:
        df = df.filter(where)
    if order:
        df = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])
    df = df.selectExpr(*columns) if columns else df
    return df.limit(limit) if limit else df


def run_select(spark: SparkSession, sql: str) -> DataFrame:
    """One SELECT (or WITH ... SELECT) statement over the registered views. Anything else, text after a semicolon too, raises and is not run.

    Spark runs commands as soon as it analyses them, also behind WITH, but takes none as a subquery: so the text is analysed as one first.
    """
    text = sql.strip().rstrip(";")
    if not text.lower().startswith(("select", "with")):
        raise ValueError("only SELECT statements are run")
    try:
        spark.sql(f"SELECT 1 FROM (\n{text}\n) AS q LIMIT 0")
    except ParseException as e:
        raise ValueError("only SELECT statements are run") from e
    return spark.sql(text)


def table_list(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns, columns."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(", ".join(df.columns)).alias("columns")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def request_filter(rows: DataFrame, method: str = "", path: str = "", least_status: int = 0, least_ms: float = 0) -> DataFrame:
    conditions = [F.col("status_code") >= least_status, F.col("duration_ms") >= least_ms] + ([F.upper("method") == method.upper()] if method else []) + ([_has("path", path)] if path else [])
    return rows.filter(_all(conditions))


def log_lines(lines: DataFrame, needle: str = "", severity: str = "") -> DataFrame:
    """value, severity of the lines that hold ``needle`` and have the severity."""
    kind = F.lit("INFO")
    for s in reversed(SEVERITIES):
        kind = F.when(F.upper("value").contains(s), s).otherwise(kind)
    rows = lines.select("value", kind.alias("severity"))
    return rows.filter(_all(([_has("value", needle)] if needle else []) + ([F.col("severity") == severity] if severity else [])))


def low_confidence_names(rows: DataFrame, jobs: DataFrame, cut: float = 0.75) -> DataFrame:
    weak = (F.coalesce("confidence", F.lit(0.0)) < cut) | T.blank(F.col("bt")) | ~F.coalesce(F.col("match_source") == "Matcher", F.lit(False))
    return rows.join(jobs.select("job_id").distinct(), "job_id", "left_semi").filter(weak).select("sku_name").distinct()


def few_shots(catalog: DataFrame, per_category: int, seed: int = 7) -> DataFrame:
    """category, basictype, name, keywords: one row a type, then a pseudo-random ``per_category`` types a category (a sampling operator)."""
    one = catalog.withColumn("_n", F.row_number().over(Window.partitionBy("category", "basictype").orderBy("source_pos"))).filter("_n = 1")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "category", "basictype"))
    some = one.withColumn("_k", F.row_number().over(Window.partitionBy("category").orderBy(order, "basictype"))).filter(F.col("_k") <= per_category)
    return some.select("category", "basictype", "name", T.comma_list(F.col("generic_keywords")).alias("keywords"))


def merge_keyword_groups(groups: DataFrame) -> DataFrame:
    """basictype, keywords, n, n_unique: keywords of all groups of a type, sanitised; n_unique counts them over all types."""
    rows = groups.select("basictype", F.explode("keywords").alias("k")).select("basictype", T.sanitize_keyword(F.col("k")).alias("k")).filter("k <> ''").distinct()
    unique = rows.agg(F.count_distinct("k").alias("n_unique"))
    merged = rows.groupBy("basictype").agg(F.array_sort(F.collect_set("k")).alias("keywords"))
    return merged.select("basictype", "keywords", F.size("keywords").alias("n")).join(F.broadcast(unique))  # one row
