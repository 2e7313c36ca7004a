"""Pass 3: value frequencies, character patterns and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import char_pattern
from plumbline.sources.templates import quoted

FREQUENCY = "freq"
PATTERN = "pattern"
HISTOGRAM = "hist"

# Spark's own bound on grouping expressions in one GROUPING SETS clause.
MAX_GROUPING_SETS = 64


@dataclass(frozen=True)
class Bins:
    """Equal-width bins between the exact bounds of a column."""

    low: float
    high: float
    count: int


def bucket_of(column: Column, bins: Bins) -> Column:
    """Bucket 1..n for values in [low, high), n + 1 for the highest value itself; none if not finite."""
    value = column.cast("double")
    bucket = F.width_bucket(value, F.lit(bins.low), F.lit(bins.high), F.lit(bins.count))
    return F.when(F.abs(value) < F.lit(float("inf")), bucket)


def extrapolation_factor(total_rows: int, cap: int) -> float:
    """From sample to population scale; 1 where nothing was sampled."""
    return total_rows / cap if total_rows > cap else 1.0


def distribution_counts(
    df: DataFrame,
    frequencies: Sequence[str] = (),
    patterns: Sequence[str] = (),
    histograms: Mapping[str, Bins] | None = None,
) -> DataFrame:
    """(kind, column_name, value, count) of all three families in one scan and one shuffle.

    Rows are stacked to narrow (series, value) pairs instead of grouping sets: there is no
    bound on the number of series, and a real NULL is dropped rather than confused with a
    column that is absent from a set. Hot values are combined on the map side.
    """
    series: dict[str, Column] = {}
    for name in frequencies:
        series[f"{FREQUENCY}.{name}"] = F.col(quoted(name)).cast("string")
    for name in patterns:
        series[f"{PATTERN}.{name}"] = char_pattern(F.col(quoted(name)))
    for name, bins in (histograms or {}).items():
        series[f"{HISTOGRAM}.{name}"] = bucket_of(F.col(quoted(name)), bins).cast("string")
    projected = df.select(*[e.alias(key) for key, e in series.items()])
    stacked = projected.unpivot([], [F.col(quoted(k)) for k in series], "series", "value")
    counts = (
        stacked.where("value IS NOT NULL")
        .groupBy("series", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    parts = F.split("series", "[.]", 2)
    return counts.select(
        parts[0].alias("kind"), parts[1].alias("column_name"), "value", "count"
    )


def grouping_set_counts(df: DataFrame, series: Mapping[str, Column]) -> DataFrame:
    """(column_name, value, count) by literal GROUPING SETS of single columns."""
    names = list(series)
    if len(names) > MAX_GROUPING_SETS:
        raise ValueError(f"at most {MAX_GROUPING_SETS} grouping sets; use distribution_counts")
    keyed = df.select(*[e.cast("string").alias(n) for n, e in series.items()])
    columns = [F.col(quoted(n)) for n in names]
    grouped = keyed.groupingSets([[c] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.grouping(c).alias(f"g{i}") for i, c in enumerate(columns)],
    )
    in_set = [F.col(f"g{i}") == 0 for i in range(len(names))]
    chosen_name, chosen_value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, present in zip(names, in_set, strict=True):
        chosen_name = F.when(present, F.lit(name)).otherwise(chosen_name)
        chosen_value = F.when(present, F.col(quoted(name))).otherwise(chosen_value)
    return grouped.select(
        chosen_name.alias("column_name"), chosen_value.alias("value"), "count"
    ).where("value IS NOT NULL")


def top_k(counts: DataFrame, k: int, by: Sequence[str] = ("column_name",)) -> DataFrame:
    """The k most frequent values per group; equal counts rank by value.

    The rank filter lets Spark keep only k rows per group in each partition before the shuffle.
    """
    window = Window.partitionBy(*by).orderBy(F.desc("count"), F.asc("value"))
    return (
        counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    )


def distribution_summary(counts: DataFrame, k: int, factor: float = 1.0) -> DataFrame:
    """Reduce the counts of all families at once: top k values, top k patterns, all buckets.

    A bucket is ranked within itself, so the rank bound keeps every bucket while it stays at k
    for values and patterns. Bucket counts are brought to population scale and cut to whole
    rows; values and patterns stay at sample scale.
    """
    is_bucket = F.col("kind") == HISTOGRAM
    spread = counts.withColumn("bucket", F.when(is_bucket, F.col("value")))
    ranked = top_k(spread, max(k, 1), by=("kind", "column_name", "bucket"))
    scaled = F.floor(F.col("count") * F.lit(factor)).cast("long")
    return ranked.where(is_bucket | (F.col("rank") <= k)).select(
        "kind",
        "column_name",
        "value",
        F.when(is_bucket, scaled).otherwise(F.col("count")).alias("count"),
    )


def frequencies_of(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("kind") == FREQUENCY).drop("kind")


def patterns_of(summary: DataFrame) -> DataFrame:
    return (
        summary.where(F.col("kind") == PATTERN).drop("kind").withColumnRenamed("value", "pattern")
    )


def histograms_of(summary: DataFrame) -> DataFrame:
    buckets = summary.where(F.col("kind") == HISTOGRAM).drop("kind")
    return buckets.withColumn("bucket", F.col("value").cast("long")).drop("value")
