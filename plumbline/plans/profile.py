"""The profile job: four passes over a table, column batch by column batch."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.config import SHAPE_STATS, ColumnSpec, Limits
from plumbline.functions.text import is_id_literal
from plumbline.operators.base import base_metrics
from plumbline.operators.distribution import (
    Bins,
    distribution_counts,
    distribution_summary,
    extrapolation_factor,
    frequencies_of,
    histograms_of,
    patterns_of,
)
from plumbline.operators.gates import with_gates, with_ledger
from plumbline.operators.normality import normality
from plumbline.operators.sampling import draw_sample, micro_sample, store_sample
from plumbline.operators.shape import box_plots, shape_moments
from plumbline.sources.inbox import write_payloads
from plumbline.sources.templates import DEFAULT_TEMPLATES, quoted

DISTRIBUTION_SCHEMA = "kind string, column_name string, value string, count long"
SHAPE_SCHEMA = "column_name string, skewness_val double, kurtosis_val double"
BOX_SCHEMA = "column_name string, box_plot array<double>"
NORMALITY_SCHEMA = (
    "column_name string, normality_test string, normality_stat double, p_value double, "
    "is_normal boolean"
)
METRIC_COLUMNS = (
    "run_id",
    "batch_num",
    "column_name",
    "total_count",
    "empty_count",
    "min",
    "max",
    "mean_val",
    "distinct_count",
    "skewness_val",
    "kurtosis_val",
    "box_plot",
    "normality_test",
    "normality_stat",
    "p_value",
    "is_normal",
    "skipped_operations",
    "sample_rows",
)


@dataclass(frozen=True)
class ProfileResult:
    """The four payloads of a run. `release` drops the small cached distributions.

    `sample_rows` in each is the size asked for where a sample was drawn, else NULL.
    """

    metrics: DataFrame
    frequencies: DataFrame
    patterns: DataFrame
    histograms: DataFrame
    cached: tuple[DataFrame, ...] = ()

    def payloads(self) -> dict[str, DataFrame]:
        return {
            "metrics": self.metrics,
            "frequencies": self.frequencies,
            "patterns": self.patterns,
            "histograms": self.histograms,
        }

    def release(self) -> None:
        for frame in self.cached:
            frame.unpersist()


def column_batches(specs: Sequence[ColumnSpec], size: int) -> list[list[ColumnSpec]]:
    """Consecutive batches, which bound the width of one query."""
    return [list(specs[i : i + size]) for i in range(0, len(specs), size)]


def judge_columns(
    df: DataFrame,
    specs: Sequence[ColumnSpec],
    limits: Limits = Limits(),
    templates: Mapping[str, str] = DEFAULT_TEMPLATES,
    tier: str = "BASIC",
) -> DataFrame:
    """Pass 1 with gate verdicts and the skip ledger: one row per column."""
    return with_ledger(with_gates(base_metrics(df, specs, templates, tier), limits), limits)


def distribution_request(
    judged: Sequence[Row], default_bins: int | None = None
) -> dict[str, object]:
    """Arguments of `distribution_counts` for the columns that passed their gates."""
    return {
        "frequencies": [r["column_name"] for r in judged if r["topk_ok"]],
        "patterns": [r["column_name"] for r in judged if r["pattern_ok"]],
        "histograms": {
            r["column_name"]: Bins(
                r["min_number"], r["max_number"], default_bins if r["histogram_bins"] is None else r["histogram_bins"]
            )
            for r in judged
            if r["hist_ok"]
        },
    }


def profile_batches(
    df: DataFrame,
    specs: Sequence[ColumnSpec],
    run_id: str,
    tier: str = "BASIC",
    limits: Limits = Limits(),
    templates: Mapping[str, str] = DEFAULT_TEMPLATES,
    sampler: str = "random",
    sample_key: Column | None = None,
) -> Iterator[ProfileResult]:
    """Profile batch by batch; an empty table yields nothing.

    Pass 1 of a batch runs at once: its few rows, one per column, decide which columns enter
    the later passes. Everything else stays lazy.
    """
    for batch_num, batch in enumerate(column_batches(specs, limits.batch_columns)):
        judged_frame = judge_columns(df, batch, limits, templates, tier)
        judged = judged_frame.collect()  # at most `batch_columns` rows
        total = judged[0]["total_count"] if judged else 0
        if total == 0:
            return
        yield _later_passes(
            df,
            batch,
            judged,
            judged_frame.schema,
            total,
            (run_id, batch_num),
            limits,
            templates,
            sampler,
            sample_key,
        )


def _later_passes(
    df, batch, judged, judged_schema, total, run, limits, templates, sampler, sample_key
) -> ProfileResult:
    spark = df.sparkSession
    request = distribution_request(judged, limits.default_bins)
    shape = {
        r["column_name"]: [s for s in r["stats"] if s in SHAPE_STATS]
        for r in judged
        if r["shape_ok"]
    }
    shape = {name: stats for name, stats in shape.items() if stats}
    moments = {n: s for n, s in shape.items() if set(s) & {"Skewness", "Kurtosis"}}
    boxes = [n for n, s in shape.items() if "Box Plot" in s]
    tested = [
        s.column_name
        for s in batch
        if s.normality_test and s.is_numeric and not is_id_literal(s.column_name)
    ]
    needed = list(
        dict.fromkeys(
            [*request["frequencies"], *request["patterns"], *request["histograms"], *shape, *tested]
        )
    )
    sample = df
    sampled = limits.sample_rows is not None and total > limits.sample_rows
    if needed and sampled:
        drawn = draw_sample(df, total, limits.sample_rows, sampler, sample_key)
        sample = store_sample(drawn.select(*[F.col(quoted(c)) for c in needed]))

    cached = []
    if any(request.values()):
        summary = distribution_summary(
            distribution_counts(sample, **request),
            limits.top_k,
            extrapolation_factor(total, limits.sample_rows) if sampled else 1.0,
        ).persist()
        cached.append(summary)
    else:
        summary = spark.createDataFrame([], DISTRIBUTION_SCHEMA)

    moment_rows = (
        shape_moments(sample, moments, templates)
        if moments
        else spark.createDataFrame([], SHAPE_SCHEMA)
    )
    box_rows = box_plots(sample, boxes) if boxes else spark.createDataFrame([], BOX_SCHEMA)
    if tested:
        micro = micro_sample(
            sample,
            [quoted(c) for c in tested],
            limits.micro_sample_rows,
            limits.sample_rows if sampled else total,
        )
        normal_rows = normality(micro, tested)
    else:
        normal_rows = spark.createDataFrame([], NORMALITY_SCHEMA)

    labels = {
        "run_id": F.lit(run[0]),
        "batch_num": F.lit(run[1]),
        "sample_rows": F.lit(limits.sample_rows if sampled else None).cast("long"),
    }
    metrics = (
        spark.createDataFrame(judged, judged_schema)
        .join(moment_rows, "column_name", "left")
        .join(box_rows, "column_name", "left")
        .join(normal_rows, "column_name", "left")
        .withColumns(labels)
        .select(*METRIC_COLUMNS)
    )
    key = ["run_id", "batch_num", "column_name"]
    return ProfileResult(
        metrics,
        frequencies_of(summary).withColumns(labels).select(*key, "value", "count", "sample_rows"),
        patterns_of(summary).withColumns(labels).select(*key, "pattern", "count", "sample_rows"),
        histograms_of(summary).withColumns(labels).select(*key, "bucket", "count", "sample_rows"),
        tuple(cached),
    )


def profile(
    df: DataFrame, specs: Sequence[ColumnSpec], run_id: str, **options
) -> ProfileResult | None:
    """Profile a table; None for an empty one. Options are those of `profile_batches`."""
    results = list(profile_batches(df, specs, run_id, **options))
    if not results:
        return None
    frames = [list(r.payloads().values()) for r in results]
    merged = [reduce(DataFrame.unionByName, column) for column in zip(*frames, strict=True)]
    return ProfileResult(*merged, cached=tuple(f for r in results for f in r.cached))


def profile_to_inbox(
    df: DataFrame, specs: Sequence[ColumnSpec], run_id: str, path: str, **options
) -> int:
    """Profile and write batch by batch; returns the number of batches written."""
    written = 0
    for result in profile_batches(df, specs, run_id, **options):
        write_payloads(result.payloads(), path)
        result.release()
        written += 1
    return written
