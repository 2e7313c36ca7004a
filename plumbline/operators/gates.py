"""Gates: which costly statistics are worth computing, judged from pass 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import NUMERIC, SHAPE_STATS, STRING, Limits
from plumbline.functions.text import is_id_name


def percent(ratio: Column) -> Column:
    """One decimal and a percent sign; exact halves go to the even digit."""
    return F.format_string("%.1f%%", F.bround(ratio.cast("double") * 100, 1))


def with_gates(base: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add the gate verdicts to pass-1 rows.

    `shape_ok`, `topk_ok`, `pattern_ok` and `hist_ok` say what may run. A missing distinct count
    counts as zero and so passes. A number without a number of bins gets the default one; zero asks
    for no histogram.
    """
    distinct = F.coalesce(F.col("distinct_count"), F.lit(0))
    patterns = F.coalesce(F.col("pattern_distinct_count"), F.lit(0))
    total = F.col("total_count")
    is_string = F.col("data_type") == STRING
    is_number = F.col("data_type") == NUMERIC
    return (
        base.withColumns(
            {
                "is_id": is_id_name(F.col("column_name")),
                "uniqueness_ratio": F.when(total > 0, distinct / total).otherwise(F.lit(0.0)),
            }
        )
        .withColumn(
            "is_high_cardinality", F.col("uniqueness_ratio") > limits.high_cardinality_ratio
        )
        .withColumns(
            {
                "shape_ok": is_number & ~F.col("is_id") & ~F.col("is_high_cardinality"),
                "topk_ok": is_string & ~F.col("is_id") & (distinct <= limits.top_k_max_distinct),
                "pattern_ok": is_string
                & ~F.col("is_id")
                & (patterns <= limits.pattern_max_distinct),
                "hist_ok": is_number
                & (F.coalesce("histogram_bins", F.lit(limits.default_bins)) > 0)
                & ~(F.col("is_id") & F.col("is_high_cardinality"))
                & F.coalesce(F.col("min_number") != F.col("max_number"), F.lit(False)),
            }
        )
    )


def with_ledger(gated: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add `skipped_operations`: JSON from operation to reason, `{}` where nothing was skipped."""
    is_string = F.col("data_type") == STRING
    is_number = F.col("data_type") == NUMERIC
    is_id = F.col("is_id")
    unique_or_id = is_id | F.col("is_high_cardinality")
    shape_reason = (
        F.when(
            unique_or_id,
            F.concat(
                F.lit("Skipped: High Cardinality ("),
                percent(F.col("uniqueness_ratio")),
                F.lit(" unique) or PK."),
            ),
        )
        .when(~is_number, F.lit("Skipped: Not a numeric column."))
    )
    reasons = [
        (stat, F.when(F.array_contains("stats", stat), shape_reason)) for stat in SHAPE_STATS
    ]
    reasons.append(
        (
            "Top-K Frequencies",
            F.when(
                is_string & ~is_id & (F.col("distinct_count") > limits.top_k_max_distinct),
                F.concat(
                    F.lit("Skipped: Distinct count ("),
                    F.col("distinct_count").cast("string"),
                    F.lit(f") > {limits.top_k_max_distinct} limit."),
                ),
            ),
        )
    )
    reasons.append(
        (
            "Patterns",
            F.when(
                is_string
                & ~is_id
                & (F.col("pattern_distinct_count") > limits.pattern_max_distinct),
                F.concat(
                    F.lit("Skipped: Distinct patterns ("),
                    F.col("pattern_distinct_count").cast("string"),
                    F.lit(f") > {limits.pattern_max_distinct}."),
                ),
            ),
        )
    )
    reasons.append(
        (
            "Histograms",
            F.when(
                is_number
                & (F.coalesce("histogram_bins", F.lit(limits.default_bins)) > 0)
                & is_id
                & F.col("is_high_cardinality"),
                F.lit("Skipped: ID Columns do not require histograms."),
            ),
        )
    )
    reasons.append(
        (
            "Normality",
            F.when(
                F.col("normality_test_wanted") & ~is_number & ~is_id,
                F.lit("Skipped: Not a numeric column."),
            ),
        )
    )
    if "not_finite_count" in gated.columns:
        left_out = F.concat(F.lit("Left out: "), F.col("not_finite_count").cast("string"), F.lit(" values are not finite."))
        reasons.append(("Bounds, Moments and Histograms", F.when(F.col("not_finite_count") > 0, left_out)))
    entries = [
        F.when(reason.isNotNull(), F.struct(F.lit(name).alias("k"), reason.alias("v")))
        for name, reason in reasons
    ]
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return gated.withColumn("skipped_operations", F.to_json(F.map_from_entries(kept)))
