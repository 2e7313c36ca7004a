"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import BASE_STATS, ColumnSpec, Limits, specs_from_schema
from plumbline.functions.hashing import hash_sampled
from plumbline.functions.text import char_pattern
from plumbline.operators.base import base_metrics, base_scan, exact_distinct_counts
from plumbline.operators.derive import (
    chi2_critical_values,
    create_derived_view,
    shape_from_raw_sums,
    with_derived_shape,
    with_mean_ci,
    with_null_rate,
    with_stddev_ci,
)
from plumbline.operators.distribution import (
    Bins,
    distribution_counts,
    distribution_summary,
    extrapolation_factor,
    frequencies_of,
    grouping_set_counts,
    histograms_of,
    patterns_of,
)
from plumbline.operators.edges import (
    apply_decisions,
    declared_edges,
    edge_summary,
    found_edges,
    venn_report,
    with_band,
    with_nodes,
)
from plumbline.operators.kv import (
    compaction,
    expired_state,
    kv_get,
    kv_state,
    live_state,
    removed_keys,
    value_index,
)
from plumbline.operators.name_match import (
    PAIR_KEY,
    candidate_pairs,
    class_links,
    name_classes,
    not_yet_evaluated,
    passing_cascade,
)
from plumbline.operators.normality import normality
from plumbline.operators.overlap import class_link_counts, column_classes
from plumbline.operators.sampling import draw_sample, micro_sample, sample_fraction
from plumbline.operators.shape import box_plots, shape_moments
from plumbline.operators.stored_metrics import merge_runs, stored_metrics
from plumbline.plans.discovery import DiscoveryOptions, discover
from plumbline.plans.profile import distribution_request, judge_columns, profile
from plumbline.sources.catalog import column_catalog, in_scope, table_nodes, without_utility
from plumbline.sources.metrics_table import evolve_metrics
from plumbline.sources.tables import read_tables
from plumbline.sources.templates import load_templates, templates_frame

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)
LIMITS = Limits()
KV_AS_OF = "2024-01-31 00:00:00"
EXTRAPOLATED_CAP = 1000
MEASURED = {
    "lineitem": ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "events": ["value"],
    "nation": ["n_nationkey"],
    "region": ["r_regionkey"],
}
GATED = ("customer", "events", "documents", "pages")
UTILITY_GLOBS = "*name, lab*, audit_*, *_tmp"
SYNONYMS = {"conv": "doc", "item": "page"}
DECLARED = [
    ("main.orders", "o_custkey", "main.customer", "c_custkey"),
    ("main.lineitem", "l_orderkey", "main.orders", "o_orderkey"),
]
ENDS_SCHEMA = "source_node string, source_col string, target_node string, target_col string"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_tables(spark, folder, [name])[name]


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return read_tables(spark, folder, TABLES)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _numeric(df: DataFrame) -> list[str]:
    return [s.column_name for s in specs_from_schema(df) if s.is_numeric]


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- pass 1 -----------------------------------------------------------------------------------


def profile_base(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "lineitem")
    specs = [
        ColumnSpec(s.column_name, s.data_type, tuple(x for x in s.stats if x != "Distinct Count"))
        for s in specs_from_schema(df)
        if s.data_type != "TEMPORAL"
    ]
    wide = base_scan(df, specs)
    kept = [c for c in wide.columns if not c.endswith("Pattern_Distinct_Count")]
    means = [c for c in kept if c.endswith("__Mean")]
    return _rounded(wide.select(*[F.col(f"`{c}`") for c in kept]), *means, digits=4)


def profile_metrics(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "lineitem")
    rows = base_metrics(df, specs_from_schema(df, force_exact_distinct=True), tier="COMPLIANCE")
    return _rounded(rows, "mean_val", digits=4).select(
        "column_name",
        "total_count",
        "empty_count",
        "min",
        "max",
        "mean_val",
        "distinct_count",
        "pattern_distinct_count",
    )


def stat_templates(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "lineitem")
    stat2sql = templates_frame(
        spark,
        {
            " Mean ": "  AVG(<<col>>) ",
            "Min": "MIN(ABS(<<col>>))",
            "Max": "",
            "Empty Count": "COUNT_IF(<<col>> = 0)",
        },
    )
    specs = [
        ColumnSpec(c, "NUMERIC", ("Mean", "Min", "Max", "Empty Count", "Mode"))
        for c in ("l_quantity", "l_discount")
    ]
    wide = base_scan(df, specs, load_templates(stat2sql))
    return _rounded(wide, "l_quantity__Mean", "l_discount__Mean", digits=4)


def exact_distinct(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "lineitem")
    counts = exact_distinct_counts(df, {c: F.col(c) for c in df.columns})
    return counts.withColumnRenamed("name", "column_name")


# Relative standard error of Spark's approx_count_distinct by default.
HLL_ERROR = 0.05


def approx_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Exact counts, and whether the approximate ones lie within three standard errors of them."""
    df = _table(spark, folder, "lineitem")
    specs = specs_from_schema(df)
    estimated = base_metrics(df, specs).select("column_name", "distinct_count")
    exact = exact_distinct_counts(df, {s.column_name: F.col(s.column_name) for s in specs}).select(
        F.col("name").alias("column_name"), F.col("distinct_count").alias("exact_count")
    )
    off = F.abs(F.col("distinct_count") - F.col("exact_count"))
    return estimated.join(exact, "column_name").select(
        "column_name", "exact_count", (off <= 3 * HLL_ERROR * F.col("exact_count")).alias("is_close")
    )


def pattern_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name in ("orders", "part"):
        df = _table(spark, folder, name)
        text = [s.column_name for s in specs_from_schema(df) if s.is_string]
        counts = exact_distinct_counts(df, {c: char_pattern(F.col(c)) for c in text})
        parts.append(
            counts.select(
                F.lit(name).alias("table_name"),
                F.col("name").alias("column_name"),
                F.col("distinct_count").alias("pattern_count"),
            )
        )
    return _union(parts)


def char_patterns(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return pages.select(
        "page_id",
        char_pattern(F.col("url")).alias("url_pattern"),
        char_pattern(F.col("html")).alias("html_pattern"),
    )


# --- gates ------------------------------------------------------------------------------------


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name in GATED:
        df = _table(spark, folder, name)
        specs = specs_from_schema(df, force_exact_distinct=True)
        rows = judge_columns(df, specs, LIMITS, tier="COMPLIANCE")
        parts.append(rows.withColumn("table_name", F.lit(name)))
    return _union(parts)


def shape_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_judged(spark, folder), "uniqueness_ratio").select(
        "table_name", "column_name", "uniqueness_ratio", "is_id", "is_high_cardinality", "shape_ok"
    )


def topk_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("table_name", "column_name", "distinct_count", "topk_ok")


def pattern_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select(
        "table_name", "column_name", "pattern_distinct_count", "pattern_ok"
    )


def hist_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select(
        "table_name", "column_name", "min_number", "max_number", "hist_ok"
    )


def skipped_operations(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("table_name", "column_name", "skipped_operations")


# --- samples and shape ------------------------------------------------------------------------


def sampled_scan(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "orders")
    sample = draw_sample(df, df.count(), EXTRAPOLATED_CAP, "hash", F.col("o_orderkey"))
    return sample.select("o_orderkey", "o_custkey", "o_totalprice")


def micro_sampled(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "orders")
    return micro_sample(
        df,
        ["o_orderkey", "o_totalprice"],
        LIMITS.micro_sample_rows,
        df.count(),
        key=F.col("o_orderkey"),
    )


def _shape_tables(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, list[str]]]:
    samples = []
    for name in ("lineitem", "events"):
        df = _table(spark, folder, name)
        columns = [c for c in _numeric(df) if not c.endswith("_id")]
        samples.append((name, df, columns))
    return samples


def shape_stats(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        shape_moments(sample, {c: ("Skewness", "Kurtosis") for c in columns}).withColumn(
            "table_name", F.lit(name)
        )
        for name, sample, columns in _shape_tables(spark, folder)
    ]
    return _rounded(_union(parts), "skewness_val", "kurtosis_val")


def box_plot(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        box_plots(sample, columns).withColumn("table_name", F.lit(name))
        for name, sample, columns in _shape_tables(spark, folder)
    ]
    names = ("low", "q1", "median", "q3", "high")
    return _union(parts).select(
        "table_name",
        "column_name",
        *[F.round(F.col("box_plot")[i], 6).alias(n) for i, n in enumerate(names)],
    )


def normality_test(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name in ("lineitem", "events"):
        df = _table(spark, folder, name)
        columns = [c for c in _numeric(df) if not c.endswith("_id")]
        micro = micro_sample(df, columns, LIMITS.micro_sample_rows, df.count())
        parts.append(normality(micro, columns).withColumn("table_name", F.lit(name)))
    return _union(parts)


# --- distributions ----------------------------------------------------------------------------


def _holed_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders")
    return orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))


def _part_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").select("p_name", "p_brand", "p_type")


def top_k_freq(spark: SparkSession, folder: str) -> DataFrame:
    orders, part = _holed_orders(spark, folder), _part_texts(spark, folder)
    counts = distribution_counts(orders, ["o_orderstatus", "o_orderpriority"]).unionByName(
        distribution_counts(part, part.columns)
    )
    return frequencies_of(distribution_summary(counts, LIMITS.top_k))


def top_k_pattern(spark: SparkSession, folder: str) -> DataFrame:
    orders, part = _holed_orders(spark, folder), _part_texts(spark, folder)
    counts = distribution_counts(
        orders, patterns=["o_orderstatus", "o_orderpriority"]
    ).unionByName(distribution_counts(part, patterns=part.columns))
    return patterns_of(distribution_summary(counts, LIMITS.top_k))


def freq_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    orders = _holed_orders(spark, folder)
    names = ("o_orderstatus", "o_orderpriority")
    return grouping_set_counts(orders, {n: F.col(n) for n in names})


def pattern_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    part = _part_texts(spark, folder)
    counts = grouping_set_counts(part, {n: char_pattern(F.col(n)) for n in part.columns})
    return counts.withColumnRenamed("value", "pattern")


def _bounds(df: DataFrame, columns: list[str], bins: int) -> dict[str, Bins]:
    """Exact bounds of numeric columns: one row comes back."""
    row = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}{c}") for c in columns for n, f in
          (("lo_", F.min), ("hi_", F.max))]
    ).first()
    return {c: Bins(row[f"lo_{c}"], row[f"hi_{c}"], bins) for c in columns}


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, columns in (
        ("orders", ["o_totalprice", "o_custkey"]),
        ("lineitem", ["l_quantity", "l_discount", "l_orderkey"]),
    ):
        df = _table(spark, folder, name)
        bins = _bounds(df, columns, LIMITS.default_bins)
        counts = distribution_counts(df, histograms=bins)
        parts.append(histograms_of(distribution_summary(counts, 0)))
    return _union(parts)


def histogram_extrapolated(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "orders")
    total = df.count()
    bins = _bounds(df, ["o_totalprice"], 10)
    sample = df.where(
        hash_sampled(F.col("o_orderkey"), sample_fraction(total, EXTRAPOLATED_CAP))
    )
    factor = extrapolation_factor(total, EXTRAPOLATED_CAP)
    counts = distribution_counts(sample, histograms=bins)
    return histograms_of(distribution_summary(counts, 0, factor))


def mega_profile(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "lineitem")
    specs = specs_from_schema(df, force_exact_distinct=True)
    judged = judge_columns(df, specs, LIMITS, tier="COMPLIANCE").collect()  # one row per column
    counts = distribution_counts(df, **distribution_request(judged))
    return distribution_summary(counts, LIMITS.top_k)


# --- stored and derived metrics ---------------------------------------------------------------


def _holed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table with some NULLs: a quantity of 1 and a value below 5 become NULL."""
    df = _table(spark, folder, name)
    if name == "lineitem":
        return df.withColumn("l_quantity", F.nullif("l_quantity", F.lit(1.0)))
    if name == "events":
        return df.withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return df


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return _union(
        [
            stored_metrics(_holed(spark, folder, name), columns, "run")
            for name, columns in MEASURED.items()
        ]
    )


def power_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Those of the measured columns, of eighths of a price and of keys of up to twelve digits."""
    sums = ("sum_x", "sum_x2", "sum_x3", "sum_x4")
    items = _table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") / 8).alias("price_eighth"), (F.col("l_orderkey") * 1_000_000).alias("long_key")
    )
    stored = _stored(spark, folder).unionByName(stored_metrics(items, items.columns, "run"))
    return stored.select("column_name", *sums)


def metrics_base(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_stored(spark, folder), "mean_val", "stddev_val", digits=4).select(
        "column_name", "total_count", "null_count", "valid_count", "mean_val", "stddev_val"
    )


def metrics_evolved(spark: SparkSession, folder: str) -> DataFrame:
    old = _stored(spark, folder).select("column_name", "total_count", "valid_count")
    evolved = evolve_metrics(old)
    added = ("sum_x", "sum_x2", "sum_x3", "sum_x4", "skewness", "kurtosis")
    return evolved.select(
        "column_name",
        "total_count",
        "valid_count",
        *[F.col(c).cast("string").alias(c) for c in added],
    )


def null_rate(spark: SparkSession, folder: str) -> DataFrame:
    return with_null_rate(_stored(spark, folder)).select("column_name", "null_rate")


def mean_ci(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_mean_ci(_stored(spark, folder))
    return _rounded(rows, "mean_ci_lower", "mean_ci_upper", digits=4).select(
        "column_name", "mean_ci_lower", "mean_ci_upper"
    )


def stddev_ci(spark: SparkSession, folder: str) -> DataFrame:
    metrics = _stored(spark, folder)
    rows = with_stddev_ci(metrics, chi2_critical_values(metrics))
    return _rounded(rows, "stddev_ci_lower", "stddev_ci_upper", digits=4).select(
        "column_name", "stddev_ci_lower", "stddev_ci_upper"
    )


def derived_shape(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_derived_shape(_stored(spark, folder))
    return _rounded(rows, "skewness_derived", "kurtosis_derived").select(
        "column_name", "skewness_derived", "kurtosis_derived"
    )


def merged_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over halves of each table, merged: counts, moments and shape of the whole."""
    halves = []
    for name, columns in MEASURED.items():
        df = _holed(spark, folder, name)
        half = F.pmod(F.xxhash64(df.columns[0]), F.lit(2))
        halves += [stored_metrics(df.where(half == i), columns, f"half {i}") for i in (0, 1)]
    rows = with_derived_shape(merge_runs(_union(halves), "both"))
    return _rounded(rows, "skewness_derived", "kurtosis_derived").select(
        "column_name", "skewness_derived", "kurtosis_derived"
    )


def derived_shape_raw(spark: SparkSession, folder: str) -> DataFrame:
    rows = shape_from_raw_sums(_stored(spark, folder))
    return _rounded(rows, "skewness_derived", "kurtosis_derived").select(
        "column_name", "skewness_derived", "kurtosis_derived"
    )


def derived_view(spark: SparkSession, folder: str) -> DataFrame:
    view = create_derived_view(spark, _stored(spark, folder))
    ends = ("mean_ci_lower", "mean_ci_upper", "stddev_ci_lower", "stddev_ci_upper")
    shape = ("skewness_derived", "kurtosis_derived")
    return _rounded(_rounded(view, *ends, digits=4), *shape).select(
        "column_name", "total_count", "valid_count", "null_rate", *ends, *shape
    )


# --- whole profile ----------------------------------------------------------------------------


def profile_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "lineitem")
    return profile(df, specs_from_schema(df), "run").metrics


def profile_wide(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "lineitem")
    copies = [F.col(c).alias(f"{c}_{i}") for i in range(5) for c in df.columns]
    wide = df.select(*copies)
    specs = [
        ColumnSpec(s.column_name, s.data_type, BASE_STATS if s.is_numeric else BASE_STATS[:3])
        for s in specs_from_schema(wide)
    ]
    result = profile(wide, specs, "run")
    return result.metrics.select(
        "run_id", "batch_num", "column_name", "total_count", "min", "max"
    )


# --- catalog and discovery --------------------------------------------------------------------


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return column_catalog(_tables(spark, folder)).select(
        "table_name", "column_name", "data_type", "type_family", "row_count", "row_label"
    )


def id_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = column_catalog(_tables(spark, folder)).where("is_id")
    return rows.select("table_name", "column_name", "row_count")


def scoped_catalog(spark: SparkSession, folder: str) -> DataFrame:
    rows = column_catalog(_tables(spark, folder))
    scope = rows.where("row_count >= 1000").select("schema_name", "table_name").distinct()
    return in_scope(rows, scope).select("table_name", "column_name", "row_count")


def excluded_utility(spark: SparkSession, folder: str) -> DataFrame:
    rows = without_utility(column_catalog(_tables(spark, folder)), UTILITY_GLOBS)
    return rows.select("table_name", "column_name", "row_count")


def semantic_tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = _measured(spark, folder)
    return rows.select("table_name", "column_name", "valid_count", "semantic_tag")


PAIR_COLUMNS = (
    "left_table",
    "left_column",
    "right_table",
    "right_column",
    "left_rows",
    "right_rows",
    "name_similarity",
)


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """The measured catalog, one row per column; kept, since pairing reads it several times."""
    return column_catalog(_tables(spark, folder), measure=True).persist()


def _pairs(spark: SparkSession, folder: str, threshold: float, **options) -> DataFrame:
    return candidate_pairs(_measured(spark, folder), threshold, **options)


def _pair_report(pairs: DataFrame) -> DataFrame:
    return _rounded(pairs, "name_similarity", digits=4).select(*PAIR_COLUMNS)


def name_similarity(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(
        spark,
        folder,
        60.0,
        strict_types=False,
        domain_clustering=False,
        synonyms=SYNONYMS,
    )
    return _pair_report(pairs)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_report(_pairs(spark, folder, 50.0))


def name_class_links(spark: SparkSession, folder: str) -> DataFrame:
    links = class_links(name_classes(_measured(spark, folder)), 50.0)
    return _rounded(links, "similarity", digits=4)


def cascade_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_report(passing_cascade(_pairs(spark, folder, 50.0), LIMITS.name_similarity))


def incremental_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder, LIMITS.name_similarity)
    stale = (F.col("left_table") == "customer").cast("long")
    evaluated = pairs.where("left_table < 'm'").select(
        "left_schema",
        "left_table",
        "left_column",
        "right_schema",
        "right_table",
        "right_column",
        (F.col("left_rows") - stale).cast("string").alias("left_version"),
        F.col("right_rows").cast("string").alias("right_version"),
    )
    return _pair_report(not_yet_evaluated(pairs, evaluated))


def incremental_versions(spark: SparkSession, folder: str) -> DataFrame:
    """What a second scan has to compare after one balance of customer changed, its length did not."""
    options = DiscoveryOptions(content_versions=True)
    before = _tables(spark, folder)
    first = discover(before, options=options)
    judged = first.pairs.select(*PAIR_KEY, "left_version", "right_version")
    changed = F.when(F.col("c_custkey") == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    after = before | {"customer": before["customer"].withColumn("c_acctbal", changed)}
    return _pair_report(discover(after, options=options, evaluated=judged, known=first.catalog).pairs)


def _directed(spark: SparkSession, folder: str, cap: int | None = None) -> DataFrame:
    options = DiscoveryOptions(sample_cap=cap)
    return discover(_tables(spark, folder), options=options).overlaps


def _overlap_report(directed: DataFrame) -> DataFrame:
    return _rounded(directed, "overlap_pct", digits=4).select(
        "child_table",
        "child_column",
        "parent_table",
        "parent_column",
        "child_distinct",
        "parent_distinct",
        "shared_distinct",
        "overlap_pct",
    )


def fk_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap_report(_directed(spark, folder))


def overlap_any_name(spark: SparkSession, folder: str) -> DataFrame:
    options = DiscoveryOptions(cascade=False)
    return _overlap_report(discover(_tables(spark, folder), options=options).overlaps)


def overlap_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every column with the class of those that hold the same values and its number of links."""
    tables = _tables(spark, folder)
    measured = column_catalog(tables, measure=True).persist()
    found = column_classes(tables, measured)
    counted = class_link_counts(found.classes, found.links)
    return counted.select("table_name", "column_name", "class_id", F.col("distinct").alias("distinct_count"), "n_links")


def fk_overlap_sampled(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap_report(_directed(spark, folder, 1000))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    declared = spark.createDataFrame(DECLARED, ENDS_SCHEMA)
    options = DiscoveryOptions(sample_cap=None)
    return discover(_tables(spark, folder), options=options, declared=declared).edges


def declared_fk_edges(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table_nodes(column_catalog(_tables(spark, folder)))
    declared = declared_edges(spark.createDataFrame(DECLARED, ENDS_SCHEMA))
    return with_nodes(declared, nodes).select(
        "id", "score", "heuristic", "status", "source_rows", "target_rows"
    )


def fk_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


def edges_with_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table_nodes(column_catalog(_tables(spark, folder)))
    return with_nodes(_edges(spark, folder), nodes).select(
        "id",
        "source_table",
        "source_rows",
        "source_row_label",
        "target_table",
        "target_rows",
        "target_row_label",
    )


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    """Edges after a reviewer accepted every full score, undid some and rejected low ones."""
    edges = _edges(spark, folder).persist()
    verdicts = [
        (1, "verified", F.col("score") >= 100),
        (2, "suggested", F.col("source_col").like("%nationkey")),
        (3, "rejected", F.col("heuristic") == "Fuzzy Name Match"),
    ]
    made = F.array(
        *[
            F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(status).alias("new_status")))
            for seq, status, when in verdicts
        ]
    )
    decisions = edges.select(F.col("id").alias("edge_id"), F.inline(made)).where("seq IS NOT NULL")
    return apply_decisions(edges, decisions)


def triage_state(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select("id", "score", "status")


def edge_bands(spark: SparkSession, folder: str) -> DataFrame:
    return with_band(_decided(spark, folder)).select("id", "score", "status", "band")


def summary_of_edges(spark: SparkSession, folder: str) -> DataFrame:
    return edge_summary(_decided(spark, folder))


def venn(spark: SparkSession, folder: str) -> DataFrame:
    directed = _directed(spark, folder)
    return venn_report(found_edges(directed), directed)


# --- key-value log ----------------------------------------------------------------------------


def _kv_log(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("op"),
        F.col("user_id").alias("key"),
        F.col("event_type").alias("value"),
        F.lit(86_400).alias("ttl_s"),
        "ts",
    )


def _as_of():
    return F.lit(KV_AS_OF).cast("timestamp_ntz")


def state(spark: SparkSession, folder: str) -> DataFrame:
    return kv_state(_kv_log(spark, folder))


def kv_removed(spark: SparkSession, folder: str) -> DataFrame:
    return removed_keys(_kv_log(spark, folder))


def kv_expired(spark: SparkSession, folder: str) -> DataFrame:
    return expired_state(state(spark, folder), _as_of())


def kv_lookup(spark: SparkSession, folder: str) -> DataFrame:
    requests = _table(spark, folder, "events").select((F.col("user_id") * 2).alias("key"))
    return kv_get(_kv_log(spark, folder), requests, _as_of())


def kv_value_index(spark: SparkSession, folder: str) -> DataFrame:
    blocks = value_index(live_state(state(spark, folder), _as_of()))
    return blocks.select("value", "block", F.array_join("keys", ",").alias("keys"))


def kv_compaction(spark: SparkSession, folder: str) -> DataFrame:
    return compaction(state(spark, folder), _as_of())


QUERIES: dict[str, Query] = {
    "profile_base": profile_base,
    "profile_metrics": profile_metrics,
    "stat_templates": stat_templates,
    "exact_distinct": exact_distinct,
    "approx_distinct": approx_distinct,
    "pattern_cardinality": pattern_cardinality,
    "char_pattern": char_patterns,
    "shape_gate": shape_gate,
    "topk_gate": topk_gate,
    "pattern_gate": pattern_gate,
    "hist_gate": hist_gate,
    "skipped_operations": skipped_operations,
    "sampled_scan": sampled_scan,
    "micro_sample": micro_sampled,
    "shape_stats": shape_stats,
    "box_plot": box_plot,
    "normality": normality_test,
    "top_k_freq": top_k_freq,
    "top_k_pattern": top_k_pattern,
    "freq_grouping_sets": freq_grouping_sets,
    "pattern_grouping_sets": pattern_grouping_sets,
    "histogram": histogram,
    "histogram_extrapolated": histogram_extrapolated,
    "mega_profile": mega_profile,
    "power_sums": power_sums,
    "metrics_base": metrics_base,
    "metrics_evolved": metrics_evolved,
    "null_rate": null_rate,
    "mean_ci": mean_ci,
    "stddev_ci": stddev_ci,
    "derived_shape": derived_shape,
    "merged_metrics": merged_metrics,
    "derived_shape_raw": derived_shape_raw,
    "derived_view": derived_view,
    "profile_lineitem": profile_lineitem,
    "profile_wide": profile_wide,
    "column_catalog": catalog,
    "id_columns": id_columns,
    "scoped_catalog": scoped_catalog,
    "excluded_utility": excluded_utility,
    "semantic_tags": semantic_tags,
    "name_similarity": name_similarity,
    "candidate_pairs": candidates,
    "name_class_links": name_class_links,
    "cascade_pairs": cascade_pairs,
    "incremental_pairs": incremental_pairs,
    "incremental_versions": incremental_versions,
    "fk_overlap": fk_overlap,
    "overlap_any_name": overlap_any_name,
    "overlap_classes": overlap_classes,
    "fk_overlap_sampled": fk_overlap_sampled,
    "venn_report": venn,
    "declared_fk_edges": declared_fk_edges,
    "fk_edges": fk_edges,
    "edges_with_nodes": edges_with_nodes,
    "edge_bands": edge_bands,
    "triage_state": triage_state,
    "edge_summary": summary_of_edges,
    "kv_state": state,
    "kv_removed": kv_removed,
    "kv_expired": kv_expired,
    "kv_get": kv_lookup,
    "kv_value_index": kv_value_index,
    "kv_compaction": kv_compaction,
}
