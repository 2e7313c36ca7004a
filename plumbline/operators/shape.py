"""Pass 2: skewness, kurtosis and box plot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.templates import DEFAULT_TEMPLATES, expand, finite_template, quoted

QUARTILES = (0.25, 0.5, 0.75)


def shape_moments(
    sample: DataFrame,
    wanted: Mapping[str, Sequence[str]],
    templates: Mapping[str, str] = DEFAULT_TEMPLATES,
) -> DataFrame:
    """(column_name, skewness_val, kurtosis_val), NULL where not wanted; one scan."""
    aggregates: list[Column] = []
    for i, (name, stats) in enumerate(wanted.items()):
        for stat in ("Skewness", "Kurtosis"):
            template = finite_template(stat, templates.get(stat), sample.schema[name].dataType)
            value = expand(template, name) if template and stat in stats else F.lit(None)
            aggregates.append(value.cast("double").alias(f"{stat}{i}"))
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(f"Skewness{i}").alias("skewness_val"),
            F.col(f"Kurtosis{i}").alias("kurtosis_val"),
        )
        for i, name in enumerate(wanted)
    ]
    return sample.agg(*aggregates).select(F.inline(F.array(*entries)))


def _ranked(counts: DataFrame, quantiles: Sequence[float], parts: int) -> DataFrame:
    """(i, q, low, high, value_low, value_high, share): where each quantile of column i lies.

    Counted values are dealt by ranges of (column, value). One total per range tells the ranks that
    it holds, and only ranges that hold a wanted rank are numbered value by value. Both readers
    share one shuffle: its number of ranges is given, so neither merges any.
    """
    ranged = counts.repartitionByRange(parts, "i", "value").withColumn("part", F.spark_partition_id())
    column, before = Window.partitionBy("i"), Window.partitionBy("i").orderBy("part")
    totals = (
        ranged.groupBy("i", "part")
        .agg(F.sum("times").alias("size"), F.min("value").alias("least"), F.max("value").alias("most"))
        .select(
            "i",
            "part",
            "size",
            (F.sum("size").over(before) - F.col("size")).alias("start"),
            F.sum("size").over(column).alias("n"),
            F.min("least").over(column).alias("low"),
            F.max("most").over(column).alias("high"),
        )
    )
    position = (F.col("n") - 1) * F.col("q")
    due = (
        totals.withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
        .withColumn("share", position - F.floor(position))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .where("start <= rank AND rank < start + size")
        .select("i", "part", "start", "low", "high", "q", "share", "rank")
    )  # at most two rows for each quantile of a column
    places = due.groupBy("i", "part").agg(F.first("start").alias("start"))
    upto = Window.partitionBy("i", "part").orderBy("value")
    numbered = ranged.join(F.broadcast(places), ["i", "part"]).withColumn("end", F.col("start") + F.sum("times").over(upto))
    return (
        numbered.select("i", "part", "value", (F.col("end") - F.col("times")).alias("first"), "end")
        .join(F.broadcast(due.drop("start")), ["i", "part"])
        .where("first <= rank AND rank < end")
        .groupBy("i", "low", "high", "q", "share")
        .agg(F.min("value").alias("value_low"), F.max("value").alias("value_high"))
    )


def box_plots(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """(column_name, box_plot) with [min, q1, median, q3, max] by exact, interpolated quantiles.

    Columns are stacked and equal values counted before their shuffle. No task holds all values of
    a column: see `_ranked`; parts, by default the session's shuffle partitions, is the number of
    ranges. What is broadcast has two rows for each quantile of a column. Quantiles are of finite
    values; a column without any has no row.
    """
    parts = parts or max(2 * len(columns), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbers = [F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    entries = [F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("value")) for i in range(len(columns))]
    stacked = df.select(*numbers).select(F.inline(F.array(*entries)))
    counts = (
        stacked.where("value IS NOT NULL AND abs(value) < double('Infinity')")  # also drops NaN
        .groupBy("i", "value")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    between = F.col("value_low") * (1 - F.col("share")) + F.col("value_high") * F.col("share")
    points = F.array_sort(F.collect_list(F.struct("q", between.alias("v"))))
    return (
        _ranked(counts, QUARTILES, parts)
        .groupBy("i", "low", "high")
        .agg(F.transform(points, lambda p: p["v"]).alias("quartiles"))
        .select(
            F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1).alias("column_name"),
            F.concat(F.array("low"), F.col("quartiles"), F.array("high")).alias("box_plot"),
        )
    )
