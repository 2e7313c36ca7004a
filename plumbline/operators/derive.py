"""Metrics derived on read from stored aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.raw_moments import raw_shape_batches
from plumbline.functions.stats import (
    CHI2_Z,
    chi2_quantile,
    kurtosis_from_sums,
    mean_margin,
    null_rate,
    skewness_from_sums,
    stddev_bound,
)

ALPHA = 0.05

# Two-sided 95% chi-squared critical values (lower, upper) for df 1 to 30.
CHI2_TABLE = (
    (0.00098207, 5.02388619),
    (0.05063562, 7.37775891),
    (0.21579528, 9.34840360),
    (0.48441856, 11.14328678),
    (0.83121161, 12.83250199),
    (1.23734425, 14.44937534),
    (1.68986918, 16.01276427),
    (2.17973075, 17.53454614),
    (2.70038950, 19.02276780),
    (3.24697278, 20.48317735),
    (3.81574825, 21.92004926),
    (4.40378851, 23.33666416),
    (5.00875051, 24.73560488),
    (5.62872610, 26.11894805),
    (6.26213780, 27.48839286),
    (6.90766435, 28.84535072),
    (7.56418645, 30.19100912),
    (8.23074619, 31.52637844),
    (8.90651648, 32.85232686),
    (9.59077739, 34.16960690),
    (10.28289778, 35.47887591),
    (10.98232073, 36.78071208),
    (11.68855192, 38.07562725),
    (12.40115022, 39.36407703),
    (13.11972002, 40.64646912),
    (13.84390498, 41.92317010),
    (14.57338273, 43.19451097),
    (15.30786055, 44.46079184),
    (16.04707170, 45.72228580),
    (16.79077227, 46.97924224),
)


def chi2_critical_values(metrics: DataFrame) -> DataFrame:
    """(df, alpha, chi2_lower, chi2_upper) for the degrees of freedom the metrics need.

    Exact up to df 30, by the Wilson-Hilferty approximation above.
    """
    exact = F.array(
        *[
            F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))
            for low, high in CHI2_TABLE
        ]
    )
    df = F.col("df")
    tabulated = df <= len(CHI2_TABLE)
    row = F.get(exact, (df - 1).cast("int"))
    return (
        metrics.where("valid_count > 1")
        .select((F.col("valid_count") - 1).alias("df"))
        .distinct()
        .select(
            "df",
            F.lit(ALPHA).alias("alpha"),
            F.when(tabulated, row["low"])
            .otherwise(chi2_quantile(df, -CHI2_Z))
            .alias("chi2_lower"),
            F.when(tabulated, row["high"])
            .otherwise(chi2_quantile(df, CHI2_Z))
            .alias("chi2_upper"),
        )
    )


def with_null_rate(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("null_rate", null_rate(F.col("null_count"), F.col("total_count")))


def with_mean_ci(metrics: DataFrame) -> DataFrame:
    margin = mean_margin(F.col("stddev_val"), F.col("valid_count"))
    return metrics.withColumns(
        {
            "mean_ci_lower": F.col("mean_val") - margin,
            "mean_ci_upper": F.col("mean_val") + margin,
        }
    )


def with_stddev_ci(metrics: DataFrame, chi2: DataFrame) -> DataFrame:
    """Left lookup of the critical values; no row gives NULL, two rows for one df fail."""
    values = (
        chi2.where(F.col("alpha") == ALPHA)
        .groupBy(F.col("df").alias("_df"))
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.any_value("chi2_lower").alias("_lower"),
            F.any_value("chi2_upper").alias("_upper"),
        )
    )

    def unique(column: str):
        message = F.concat(F.lit("several critical values for df "), F.col("_df").cast("string"))
        return F.when(F.col("_rows") > 1, F.raise_error(message)).otherwise(F.col(column))

    joined = metrics.join(values, metrics["valid_count"] - 1 == values["_df"], "left")
    sd, n = F.col("stddev_val"), F.col("valid_count")
    return joined.withColumns(
        {
            "stddev_ci_lower": stddev_bound(sd, n, unique("_upper")),
            "stddev_ci_upper": stddev_bound(sd, n, unique("_lower")),
        }
    ).drop("_df", "_rows", "_lower", "_upper")


def with_derived_shape(metrics: DataFrame) -> DataFrame:
    """Skewness and excess kurtosis from the stored sums about `shift_c`.

    Rows that hold raw sums and no shift, as other writers of the table leave them, get theirs from
    the raw sums. Only those rows go through Python; the table has a row per run and column.
    """
    n = F.col("valid_count")
    s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(1, 5))
    shaped = metrics.withColumns(
        {
            "skewness_derived": skewness_from_sums(n, s1, s2, s3),
            "kurtosis_derived": kurtosis_from_sums(n, s1, s2, s3, s4),
        }
    )
    raw_only = metrics.where("shift_c IS NULL AND sum_x IS NOT NULL AND run_id IS NOT NULL")
    raw = shape_from_raw_sums(raw_only).select(
        F.col("run_id").alias("_run"),
        F.col("column_name").alias("_column"),
        F.col("skewness_derived").alias("_skewness"),
        F.col("kurtosis_derived").alias("_kurtosis"),
    )
    own = (F.col("run_id") == F.col("_run")) & (F.col("column_name") == F.col("_column"))
    return (
        shaped.join(raw, own & F.col("shift_c").isNull(), "left")
        .withColumns(
            {
                "skewness_derived": F.coalesce("skewness_derived", "_skewness"),
                "kurtosis_derived": F.coalesce("kurtosis_derived", "_kurtosis"),
            }
        )
        .drop("_run", "_column", "_skewness", "_kurtosis")
    )


def derive_metrics(metrics: DataFrame, chi2: DataFrame | None = None) -> DataFrame:
    """All stored columns plus null rate, confidence intervals, skewness and kurtosis."""
    chi2 = chi2 if chi2 is not None else chi2_critical_values(metrics)
    return with_derived_shape(with_stddev_ci(with_mean_ci(with_null_rate(metrics)), chi2))


def create_derived_view(
    spark: SparkSession,
    metrics: DataFrame,
    chi2: DataFrame | None = None,
    name: str = "profiler_run_metrics_with_ci",
) -> DataFrame:
    """Register the derived metrics as a temporary view and return it."""
    derive_metrics(metrics, chi2).createOrReplaceTempView(name)
    return spark.table(name)


def shape_from_raw_sums(metrics: DataFrame) -> DataFrame:
    """Skewness and kurtosis of rows that carry raw sums only, in 50-digit decimals.

    Spark decimals stop at 38 digits, too few for the cancellation in raw moments. The metrics
    table has one row per profiled column, and each partition is worked on by itself.
    """
    needed = metrics.select(
        "run_id", "column_name", "valid_count", "sum_x", "sum_x2", "sum_x3", "sum_x4"
    )
    return needed.mapInPandas(
        raw_shape_batches,
        "run_id string, column_name string, skewness_derived double, kurtosis_derived double",
    )
