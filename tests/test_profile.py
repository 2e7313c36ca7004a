import json

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of

from plumbline.config import ColumnSpec, Limits, specs_from_schema
from plumbline.operators.base import base_metrics, base_scan, exact_distinct_counts
from plumbline.operators.distribution import (
    Bins,
    bucket_of,
    distribution_counts,
    distribution_summary,
    frequencies_of,
    grouping_set_counts,
    histograms_of,
    patterns_of,
)
from plumbline.operators.gates import with_gates, with_ledger
from plumbline.operators.normality import normality
from plumbline.operators.sampling import draw_sample, micro_sample
from plumbline.operators.shape import box_plots, shape_moments
from plumbline.plans.profile import column_batches, profile, profile_batches, profile_to_inbox
from plumbline.sources.inbox import read_payload
from plumbline.sources.templates import load_templates, templates_frame


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Ann-1", 1.0, None),
        (2, "Bob-2", 2.0, None),
        (3, "", 3.0, None),
        (4, None, 10.0, None),
        (5, "Bob-2", None, None),
    ]
    return spark.createDataFrame(rows, "row_id long, name string, score double, hole double")


def test_base_metrics_with_nulls(people):
    specs = specs_from_schema(people, force_exact_distinct=True)
    rows = {r["column_name"]: r for r in base_metrics(people, specs, tier="COMPLIANCE").collect()}
    assert rows["name"]["empty_count"] == 2
    assert rows["name"]["distinct_count"] == 3
    assert rows["name"]["pattern_distinct_count"] == 2
    assert rows["score"]["empty_count"] == 1
    assert rows["score"]["mean_val"] == 4.0
    assert rows["hole"]["distinct_count"] == 0
    assert rows["hole"]["min"] is None
    assert rows["row_id"]["max"] == "5"


def test_exact_counts_need_tier_and_flag(people):
    specs = specs_from_schema(people, force_exact_distinct=True)
    assert "name__Distinct Count" in base_scan(people, specs, tier="BASIC").columns
    assert "name__Distinct Count" not in base_scan(people, specs, tier="COMPLIANCE").columns
    with pytest.raises(ValueError, match="unknown tier"):
        base_scan(people, specs, tier="GOLD")


def test_exact_distinct_over_types(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "a", True), (1, 2.5, "a", False), (2, None, "b", None)],
        "i int, d double, s string, b boolean",
    )
    counts = exact_distinct_counts(df, {c: F.col(c) for c in df.columns}).collect()
    assert {r["name"]: r["distinct_count"] for r in counts} == {"i": 2, "d": 2, "s": 2, "b": 2}


def test_base_scan_is_one_scan(people):
    plan = plan_of(base_scan(people, specs_from_schema(people)))
    assert plan.count("Scan") == 1
    assert "Expand" not in plan


def test_templates_are_stripped_and_blank_ones_skipped(spark, people):
    table = templates_frame(spark, {" Mean ": " AVG(<<col>>) ", "Min": "  ", "Max": None})
    assert load_templates(table) == {"Mean": "AVG(<<col>>)"}
    wide = base_scan(
        people, [ColumnSpec("score", "NUMERIC", ("Mean", "Min", "Mode"))], load_templates(table)
    )
    assert wide.columns == ["total_count", "score__Mean"]


def gate_row(spark, **values):
    base = {
        "column_name": "c",
        "data_type": "STRING",
        "stats": ["Skewness"],
        "histogram_bins": None,
        "normality_test_wanted": False,
        "total_count": 2000,
        "min_number": None,
        "max_number": None,
        "distinct_count": 10,
        "pattern_distinct_count": 5,
    } | values
    schema = (
        "column_name string, data_type string, stats array<string>, histogram_bins int, "
        "normality_test_wanted boolean, total_count long, min_number double, max_number double, "
        "distinct_count long, pattern_distinct_count long"
    )
    order = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(base[c] for c in order)], schema)
    row = with_ledger(with_gates(df)).first()
    return row, json.loads(row["skipped_operations"])


def test_gate_boundaries(spark):
    row, _ = gate_row(spark, data_type="NUMERIC", distinct_count=1800)
    assert row["uniqueness_ratio"] == 0.9 and row["shape_ok"]
    row, ledger = gate_row(spark, data_type="NUMERIC", distinct_count=1995)
    assert not row["shape_ok"]
    assert ledger == {"Skewness": "Skipped: High Cardinality (99.8% unique) or PK."}
    row, ledger = gate_row(spark, stats=[], distinct_count=1000)
    assert row["topk_ok"] and ledger == {}
    row, ledger = gate_row(spark, stats=[], distinct_count=1001)
    assert ledger == {"Top-K Frequencies": "Skipped: Distinct count (1001) > 1000 limit."}
    row, ledger = gate_row(spark, stats=[], pattern_distinct_count=100)
    assert row["pattern_ok"]
    row, ledger = gate_row(spark, stats=[], pattern_distinct_count=101)
    assert ledger == {"Patterns": "Skipped: Distinct patterns (101) > 100."}


def test_missing_distinct_count_passes(spark):
    row, ledger = gate_row(spark, stats=[], distinct_count=None, pattern_distinct_count=None)
    assert row["topk_ok"] and row["pattern_ok"] and ledger == {}


def test_histogram_gate(spark):
    numeric = {"data_type": "NUMERIC", "stats": [], "histogram_bins": 5}
    assert gate_row(spark, **numeric, min_number=0.0, max_number=1.0)[0]["hist_ok"]
    assert not gate_row(spark, **numeric, min_number=1.0, max_number=1.0)[0]["hist_ok"]
    assert not gate_row(spark, **numeric)[0]["hist_ok"]
    unique_id = numeric | {"column_name": "row_id", "distinct_count": 2000}
    row, ledger = gate_row(spark, **unique_id, min_number=0.0, max_number=9.0)
    assert not row["hist_ok"]
    assert ledger == {"Histograms": "Skipped: ID Columns do not require histograms."}
    repeated_id = numeric | {"column_name": "user_id"}
    assert gate_row(spark, **repeated_id, min_number=0.0, max_number=9.0)[0]["hist_ok"]


def test_id_column_skips_shape(spark):
    row, ledger = gate_row(spark, data_type="NUMERIC", column_name="user_id", distinct_count=30)
    assert ledger == {"Skewness": "Skipped: High Cardinality (1.5% unique) or PK."}


def test_width_bucket_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,), (-1.0,), (None,)], "x double")
    got = [r[0] for r in df.select(bucket_of(F.col("x"), Bins(0, 10, 5))).collect()]
    assert got == [1, 3, 6, 6, 0, None]


def test_distributions_drop_nulls_and_break_ties_by_value(spark):
    rows = [(c, float(i % 4)) for i, c in enumerate("abcdefghijkl")] + [(None, None), ("b", 1.0)]
    df = spark.createDataFrame(rows, "c string, x double")
    counts = distribution_counts(df, ["c"], ["c"], {"x": Bins(0, 3, 3)})
    summary = distribution_summary(counts, 10)
    frequencies = [(r["value"], r["count"]) for r in frequencies_of(summary).collect()]
    assert frequencies[0] == ("b", 2)
    assert [v for v, _ in frequencies[1:]] == list("acdefghij")
    assert [(r["pattern"], r["count"]) for r in patterns_of(summary).collect()] == [("A", 13)]
    buckets = {r["bucket"]: r["count"] for r in histograms_of(summary).collect()}
    assert buckets == {1: 3, 2: 4, 3: 3, 4: 3}
    assert sum(buckets.values()) == df.where("x IS NOT NULL").count()


def test_distributions_take_one_scan_and_limit_before_the_shuffle(spark, people):
    summary = distribution_summary(distribution_counts(people, ["name"], ["name"]), 10)
    plan = plan_of(summary)
    assert plan.count("Scan") == 1
    assert plan.count("WindowGroupLimit") == 2


def test_grouping_sets_equal_long_form(spark):
    rows = [("x", "1"), ("x", None), (None, "1"), ("y", "2")]
    df = spark.createDataFrame(rows, "a string, b string")
    long_form = distribution_counts(df, ["a", "b"]).select("column_name", "value", "count")
    literal = grouping_set_counts(df, {"a": F.col("a"), "b": F.col("b")})
    assert long_form.exceptAll(literal).isEmpty() and literal.exceptAll(long_form).isEmpty()
    with pytest.raises(ValueError, match="at most 64"):
        grouping_set_counts(df, {f"c{i}": F.col("a") for i in range(65)})


def test_extrapolation_truncates(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (1.0,)], "x double")
    counts = distribution_counts(df, histograms={"x": Bins(0, 1, 1)})
    scaled = histograms_of(distribution_summary(counts, 0, factor=1.5)).collect()
    assert {r["bucket"]: r["count"] for r in scaled} == {1: 4, 2: 1}


def test_moments_and_quartiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    row = shape_moments(df, {"x": ("Skewness", "Kurtosis")}).first()
    assert row["skewness_val"] == pytest.approx(1.0182337649)
    assert row["kurtosis_val"] == pytest.approx(-0.7696)
    assert box_plots(df, ["x"]).first()["box_plot"] == [1.0, 1.75, 2.5, 4.75, 10.0]
    partial = shape_moments(df, {"x": ("Kurtosis",)}).first()
    assert partial["skewness_val"] is None and partial["kurtosis_val"] is not None


def test_normality_of_few_or_constant_values(spark):
    rows = [(float(i), 1.0, float(i) if i < 3 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, constant double, few double")
    got = {r["column_name"]: r for r in normality(df, df.columns).collect()}
    assert got["a"]["is_normal"] is True and got["a"]["normality_test"] == "Shapiro-Wilk"
    for name in ("constant", "few"):
        assert got[name]["normality_stat"] is None and got[name]["is_normal"] is None


def test_samples(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    assert draw_sample(df, 10_000, 20_000) is df
    drawn = draw_sample(df, 10_000, 1000, "hash", F.col("k"))
    assert 850 < drawn.count() < 1150
    assert drawn.exceptAll(draw_sample(df.repartition(7), 10_000, 1000, "hash", F.col("k"))).isEmpty()
    assert micro_sample(df, ["k"], 100, 10_000).count() == 100
    thin = micro_sample(df, ["k"], 100, 10_000, key=F.col("k"))
    whole = micro_sample(df, ["k"], 100, 1, key=F.col("k"))
    assert thin.count() == 100 and thin.exceptAll(whole).isEmpty()


def test_batches_and_empty_table(spark, people):
    specs = [ColumnSpec(f"c{i}", "STRING") for i in range(120)]
    assert [len(b) for b in column_batches(specs, 50)] == [50, 50, 20]
    empty = people.where("false")
    assert list(profile_batches(empty, specs_from_schema(empty), "r")) == []
    assert profile(empty, specs_from_schema(empty), "r") is None


def test_profile_of_a_table_beyond_the_sample_cap(spark):
    df = spark.range(6000).select(
        (F.col("id") % 50).cast("double").alias("x"),
        F.concat(F.lit("v"), F.col("id") % 7).alias("s"),
    )
    specs = specs_from_schema(df, histogram_bins=5)
    limits = Limits(sample_rows=2000, micro_sample_rows=300)
    result = profile(df, specs, "r1", limits=limits)
    metrics = {r["column_name"]: r for r in result.metrics.collect()}
    assert metrics["x"]["total_count"] == 6000
    assert metrics["x"]["box_plot"][0] == 0.0 and metrics["x"]["is_normal"] is False
    assert metrics["s"]["skipped_operations"] == "{}"
    buckets = sum(r["count"] for r in result.histograms.collect())
    assert abs(buckets - 6000) < 600
    values = sum(r["count"] for r in result.frequencies.collect())
    assert abs(values - 2000) < 200
    result.release()


def test_whole_tables_are_profiled_and_samples_are_marked(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 3).alias("x"))
    whole = profile(df, specs_from_schema(df), "r1")
    assert sorted(r["count"] for r in whole.frequencies.collect()) == [1666, 1667, 1667]
    assert {r["sample_rows"] for f in whole.payloads().values() for r in f.collect()} == {None}
    drawn = profile(df, specs_from_schema(df), "r1", limits=Limits(sample_rows=1000))
    assert {r["sample_rows"] for f in drawn.payloads().values() for r in f.collect()} == {1000}
    whole.release()
    drawn.release()


def test_micro_sample_spans_a_sorted_table(spark):
    ids = [r[0] for r in micro_sample(spark.range(60_000), ["id"], 2000, 60_000).collect()]
    assert len(ids) == 2000 and min(ids) < 1000 and max(ids) > 59_000


@pytest.mark.parametrize("pieces", [2, 7, 256])
def test_box_plot_equals_exact_quantiles(spark, pieces):
    df = spark.range(3001).select(
        (F.col("id") * F.col("id") % 977).cast("double").alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit(4)).otherwise(F.col("id")).cast("int").alias("b"),
        F.when(F.col("id") == 5, 1.5).alias("c"),
        F.lit(None).cast("double").alias("d"),
    )
    found = {r["column_name"]: r["box_plot"] for r in box_plots(df, ["a", "b", "c", "d"], pieces).collect()}
    assert set(found) == {"a", "b", "c"}
    for name, box in found.items():
        exact = df.agg(F.percentile(name, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))).first()[0]
        assert box == pytest.approx(exact)


def test_inbox_is_partitioned_and_rerun_replaces_its_batch(spark, tmp_path, people):
    path = str(tmp_path / "inbox")
    specs = specs_from_schema(people)
    for run in ("r1", "r2", "r1"):
        written = profile_to_inbox(people, specs, run, path, limits=Limits(batch_columns=2))
        assert written == 2
    metrics = read_payload(
        spark, path, "metrics", "column_name string, total_count long, run_id string, batch_num int"
    )
    assert metrics.count() == 8
    assert {r[0] for r in metrics.select("run_id").distinct().collect()} == {"r1", "r2"}


def test_values_that_are_not_finite_are_left_out_and_noted(spark):
    values = [float("nan"), float("inf"), float("-inf"), None, *[float(i % 50) for i in range(200)]]
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "x double, y int")
    result = profile(df, specs_from_schema(df, histogram_bins=5), "r")
    row = {r["column_name"]: r for r in result.metrics.collect()}["x"]
    assert (row["min"], row["max"], row["mean_val"]) == ("0.0", "49.0", 24.5)
    assert row["box_plot"][0] == 0.0 and row["box_plot"][-1] == 49.0
    ledger = json.loads(row["skipped_operations"])
    assert ledger == {"Bounds, Moments and Histograms": "Left out: 3 values are not finite."}
    histogram = [r["count"] for r in result.histograms.where("column_name = 'x'").collect()]
    assert sum(histogram) == 200


def test_no_number_of_bins_means_the_default_and_zero_means_no_histogram(spark):
    df = spark.range(1000).selectExpr("CAST(id % 100 AS DOUBLE) AS a", "CAST(id % 100 AS DOUBLE) AS b")
    specs = [ColumnSpec("a", "NUMERIC"), ColumnSpec("b", "NUMERIC", histogram_bins=0)]
    found = profile(df, specs, "r").histograms.groupBy("column_name").agg(F.max("bucket").alias("top")).collect()
    assert [(r["column_name"], int(r["top"])) for r in found] == [("a", 21)]
