"""Mergeable aggregates of numeric columns, stored so that shape can be derived later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import power_sums as exact
from plumbline.sources.metrics_table import POWER_SUM_TYPES, evolve_metrics
from plumbline.sources.templates import quoted, sql_text

# Rows of that many groups of tasks are combined before those of a column are.
_BUNDLES = 256
_COMBINED = (
    "i int, n long, nulls long, v long, not_finite long, m double, m2 double, m3 double, m4 double, "
    "sum_1 string, sum_2 string, sum_3 string, sum_4 string"
)


def stored_metrics(df: DataFrame, columns: Sequence[str], run_id: str) -> DataFrame:
    """One row per numeric column: counts, moments, raw and centred power sums.

    One scan of the columns: each task sums them up, in numpy, by column and number of decimals, and
    sends on a row of each. No Spark number holds such sums, and the same arithmetic as expressions
    made methods too long for the JIT compiler, ten times slower. An empty table gives no rows.

    `sum_x..sum_x4` are exact decimal texts of any length; doubles and floats count as the decimal
    that they are written as. `s1..s4` are sums of powers about `shift_c`, the mean; skewness and
    kurtosis do not depend on the shift. NaN and infinite values are neither null nor valid: moments
    leave them out, raw sums are NULL, and `power_sum_note` says so.
    """
    numbers = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    partial = numbers.mapInArrow(exact.sum_batches, exact.PARTIAL)
    # two steps, so that however many tasks there are, none has to combine the rows of all
    bundles = partial.groupBy("i", F.pmod("part", F.lit(_BUNDLES))).applyInPandas(exact.combine_tasks, exact.PARTIAL)
    combined = bundles.groupBy("i").applyInPandas(exact.combine_scales, _COMBINED)
    names = ", ".join(sql_text(c) for c in columns)
    rows = combined.selectExpr(
        f"{sql_text(run_id)} AS run_id",
        f"element_at(array({names}), i + 1) AS column_name",
        "n AS total_count",
        "nulls AS null_count",
        "v AS valid_count",
        "m AS mean_val",
        "if(v > 1, sqrt(m2 / (v - 1)), NULL) AS stddev_val",
        *[f"sum_{k} AS sum_x{k if k > 1 else ''}" for k in exact.POWERS],
        "if(v > 0, m, NULL) AS shift_c",
        "if(v > 0, 0D, NULL) AS s1",
        "m2 AS s2",
        "m3 AS s3",
        "m4 AS s4",
        "if(not_finite > 0, 'Skipped: Values are not finite.', NULL) AS power_sum_note",
    )
    return evolve_metrics(rows)


def merge_runs(metrics: DataFrame, run_id: str) -> DataFrame:
    """One row per column that describes the rows of all its runs together.

    Every run's sums are about its own mean; they are moved to the common mean before they are
    added, so the result is that of one run over everything. Raw sums are added if all runs with
    values have them. A column without values in any run keeps its counts.
    """
    together = metrics.groupBy("column_name").agg(
        F.try_divide(
            F.sum(F.col("mean_val") * F.col("valid_count")), F.sum("valid_count")
        ).alias("_mean")
    )
    n, d = F.col("valid_count"), F.col("shift_c") - F.col("_mean")
    s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(1, 5))
    moved = {
        "_1": s1 + n * d,
        "_2": s2 + 2 * d * s1 + n * d**2,
        "_3": s3 + 3 * d * s2 + 3 * d**2 * s1 + n * d**3,
        "_4": s4 + 4 * d * s3 + 6 * d**2 * s2 + 4 * d**3 * s1 + n * d**4,
    }
    filled = n > 0

    def whole(name: str):
        lacking = F.count_if(filled & F.col(name).isNull()) > 0
        return F.when(~lacking, F.collect_list(name)).alias(name)  # a text for each run

    text_sums = F.pandas_udf(exact.sum_texts, "string")

    def total(k: int, name: str):
        lists = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return text_sums(F.struct(lists.alias("texts"), F.lit(2 * k).alias("least")))

    merged = (
        metrics.join(together, "column_name")
        .withColumns(moved)
        .groupBy("column_name")
        .agg(
            F.sum("total_count").alias("total_count"),
            F.sum("null_count").alias("null_count"),
            F.sum("valid_count").alias("valid_count"),
            F.first("_mean").alias("mean_val"),
            *[whole(name) for name in POWER_SUM_TYPES],
            *[F.sum(f"_{k}").alias(f"s{k}") for k in range(1, 5)],
        )
    )
    merged = merged.withColumns({name: total(k, name) for k, name in enumerate(POWER_SUM_TYPES, start=1)})
    spread = F.sqrt(F.col("s2") / (F.col("valid_count") - 1))
    return evolve_metrics(
        merged.select(
            F.lit(run_id).alias("run_id"),
            "*",
            F.when(F.col("valid_count") > 1, spread).alias("stddev_val"),
            F.col("mean_val").alias("shift_c"),
        )
    )
