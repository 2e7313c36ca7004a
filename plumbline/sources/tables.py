"""Readers: files and database connectors, always lazy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

FILE_FORMATS = ("parquet", "orc", "csv", "json")


def read_source(
    spark: SparkSession,
    platform: str,
    target: str,
    options: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Read a path, or a query through the connector named after the platform.

    A JDBC query is read by one task unless a partition column with bounds is given; the
    connector then splits it into range scans.
    """
    fmt = platform.strip().lower()
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if fmt in FILE_FORMATS:
        return reader.load(target)
    if partition_column is None:
        return reader.option("query", target).load()
    if bounds is None or partitions is None:
        raise ValueError("partition_column needs bounds and partitions")
    return (
        reader.option("dbtable", f"({target}) source")
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(bounds[0]))
        .option("upperBound", str(bounds[1]))
        .option("numPartitions", str(partitions))
        .load()
    )


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """One Parquet table per name in a folder."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
