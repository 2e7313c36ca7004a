"""Additive schema evolution of the stored metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Columns every stored metrics table must end up with, in order.
# Power sums are decimal texts, since no Spark number holds them whatever the input.
POWER_SUM_TYPES = {"sum_x": "string", "sum_x2": "string", "sum_x3": "string", "sum_x4": "string"}
SHIFTED_SUM_TYPES = {
    "shift_c": "double",
    "s1": "double",
    "s2": "double",
    "s3": "double",
    "s4": "double",
}
DEPRECATED_TYPES = {"skewness": "double", "kurtosis": "double"}


def evolve_metrics(metrics: DataFrame) -> DataFrame:
    """Add any missing power-sum and deprecated column as a typed NULL; keep what is there.

    Power sums that another writer left as numbers become texts.
    """
    present = set(metrics.columns)
    numbers = [n for n in POWER_SUM_TYPES if n in present and metrics.schema[n].dataType != StringType()]
    metrics = metrics.withColumns({n: F.col(n).cast("string") for n in numbers})
    wanted = POWER_SUM_TYPES | SHIFTED_SUM_TYPES | DEPRECATED_TYPES
    return metrics.withColumns(
        {
            name: F.lit(None).cast(sql_type)
            for name, sql_type in wanted.items()
            if name not in present
        }
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append a run; files of different ages may differ in columns."""
    metrics.write.mode("append").partitionBy("run_id").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read all runs with merged columns, evolved to the current layout."""
    return evolve_metrics(spark.read.option("mergeSchema", "true").parquet(path))
