"""All registered queries of the product operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skuforge.plans import cases_match, cases_reports, cases_tags, cases_text
from skuforge.plans.samples import Samples

CASES = {**cases_text.CASES, **cases_match.CASES, **cases_tags.CASES, **cases_reports.CASES}


#: Bytes of rows in memory for a byte of a columnar file, as Spark estimates the sides of a join before it has measured them. Spark's own 1 broadcasts
#: a table of 8 MB on disk that is hundreds of MB in the driver.
COMPRESSION, ESTIMATE = "20.0", "spark.sql.sources.fileCompressionFactor"


def _query(build: Callable[[Samples], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if float(spark.conf.get(ESTIMATE, "1.0")) == 1.0:
            spark.conf.set(ESTIMATE, COMPRESSION)
        return build(Samples(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, (build, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items() if sql}
