import random
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators.derive import (
    chi2_critical_values,
    create_derived_view,
    derive_metrics,
    shape_from_raw_sums,
    with_stddev_ci,
)
from plumbline.operators.stored_metrics import merge_runs, stored_metrics
from plumbline.sources.metrics_table import append_metrics, evolve_metrics, read_metrics


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def test_power_sums_are_exact(spark):
    row = stored_metrics(numbers(spark, [0.1, 0.2, -0.3, None]), ["x"], "r").first()
    assert [str(row[c]) for c in ("sum_x", "sum_x2", "sum_x3", "sum_x4")] == [
        "0.00",
        "0.1400",
        "-0.018000",
        "0.00980000",
    ]
    assert (row["total_count"], row["null_count"], row["valid_count"]) == (4, 1, 3)
    assert row["power_sum_note"] is None


def exact_power_sums(texts):
    """(sum of k-th powers) of decimal texts as fractions."""
    return [sum(Fraction(t) ** k for t in texts) for k in (1, 2, 3, 4)]


def power_sum_fractions(row):
    return [Fraction(row[c]) for c in ("sum_x", "sum_x2", "sum_x3", "sum_x4")]


def test_raw_sums_are_exact_whatever_the_number(spark):
    lossy = stored_metrics(numbers(spark, [0.125, 1.0]), ["x"], "r").first()
    assert (lossy["sum_x"], lossy["sum_x4"], lossy["power_sum_note"]) == ("1.125", "1.000244140625", None)
    wide = stored_metrics(numbers(spark, [1e9, 2e9, 1.0]), ["x"], "r").first()
    assert wide["sum_x2"] == "5000000000000000001.0000"
    assert wide["sum_x4"] == "17000000000000000000000000000000000001.00000000"
    rng = random.Random(3)
    odd = [rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30) for _ in range(300)] + [1e300, -1e-300, 5e-324, 0.1, 1 / 3, -0.0, 2.0**53]
    row = stored_metrics(numbers(spark, [*odd, None]), ["x"], "r").first()
    assert power_sum_fractions(row) == exact_power_sums([repr(x) for x in odd])


def test_raw_sums_of_long_float_and_wide_decimal_columns(spark):
    longs = [2**63 - 1, -(2**63) + 1, 10**18, -7, 0, None, 999_999, 1_000_000]
    texts = ["99999999999999999999999999.999999999999", "-0.000000000001", "12345678901234567890.5", None, "0", "7", "-1", "3.25"]
    floats = [0.1, -2.5, 3e30, 1e-20, None, 16777216.0, 0.0, 1.0]
    df = spark.createDataFrame(list(zip(longs, texts, floats)), "l long, t string, f float").selectExpr("l", "CAST(t AS DECIMAL(38,12)) AS d", "f")
    rows = {r["column_name"]: r for r in stored_metrics(df, ["l", "d", "f"], "r").collect()}
    written = ["0.1", "-2.5", "3e30", "1e-20", "16777216", "0", "1"]
    assert power_sum_fractions(rows["l"]) == exact_power_sums([x for x in longs if x is not None])
    assert power_sum_fractions(rows["d"]) == exact_power_sums([t for t in texts if t is not None])
    assert power_sum_fractions(rows["f"]) == exact_power_sums(written)


def test_values_that_are_not_finite_are_noted(spark):
    row = stored_metrics(numbers(spark, [1, 2, float("nan"), float("inf"), None]), ["x"], "r").first()
    assert (row["total_count"], row["null_count"], row["valid_count"], row["mean_val"]) == (5, 1, 2, 1.5)
    assert row["sum_x"] is None and "not finite" in row["power_sum_note"]


def test_moments_merge_over_scales(spark):
    values = [1e6 + i / 8 for i in range(999)] + [3, 0.1, 1e-9]
    df = numbers(spark, values)
    built_in = df.agg(F.avg("x"), F.stddev_samp("x"), F.skewness("x"), F.kurtosis("x")).first()
    row = derive_metrics(stored_metrics(df, ["x"], "r")).first()
    found = [row[c] for c in ("mean_val", "stddev_val", "skewness_derived", "kurtosis_derived")]
    assert found == [pytest.approx(x, rel=1e-9) for x in built_in]


def test_integer_and_decimal_columns(spark):
    df = spark.createDataFrame([(3, 4), (-1, 2)], "i int, j long").withColumn(
        "d", F.col("i").cast("decimal(10,4)") / 4
    )
    rows = {r["column_name"]: r for r in stored_metrics(df, ["i", "j", "d"], "r").collect()}
    assert str(rows["i"]["sum_x3"]) == "26.000000"
    assert str(rows["j"]["sum_x4"]) == "272.00000000"
    assert str(rows["d"]["sum_x"]) == "0.50"


@pytest.mark.parametrize("values", [[1, 2, 3, 10], [1e6 + i % 97 for i in range(2000)], [5, 5, 5, 9, 0]])
def test_derived_shape_equals_builtin(spark, values):
    df = numbers(spark, values)
    metrics = stored_metrics(df, ["x"], "r")
    built_in = df.agg(F.skewness("x").alias("s"), F.kurtosis("x").alias("k")).first()
    derived = derive_metrics(metrics).first()
    raw = shape_from_raw_sums(metrics).first()
    for row, tolerance in ((derived, 1e-9), (raw, 1e-9)):
        assert row["skewness_derived"] == pytest.approx(built_in["s"], abs=tolerance)
        assert row["kurtosis_derived"] == pytest.approx(built_in["k"], abs=tolerance)


def test_rows_with_raw_sums_only_get_their_shape(spark):
    metrics = stored_metrics(numbers(spark, [1, 2, 3, 10]), ["x"], "r")
    foreign = metrics.withColumns({c: F.lit(None).cast("double") for c in ("shift_c", "s1", "s2", "s3", "s4")}).withColumn("run_id", F.lit("f"))
    rows = {r["run_id"]: r for r in derive_metrics(metrics.unionByName(foreign)).collect()}
    assert len(rows) == 2
    for name in ("skewness_derived", "kurtosis_derived"):
        assert rows["f"][name] == pytest.approx(rows["r"][name], abs=1e-9)


@pytest.mark.parametrize("parts", [([1, 2, 3], [10, 4.5]), ([1e6 + i % 7 for i in range(50)], [5]), ([], [1, 2, 4, 4]), ([None], [None, None])])
def test_merged_runs_equal_one_run(spark, parts):
    runs = [stored_metrics(numbers(spark, p), ["x"], str(i)) for i, p in enumerate(parts)]
    merged = derive_metrics(merge_runs(runs[0].unionByName(runs[1]), "m")).first()
    whole = derive_metrics(stored_metrics(numbers(spark, parts[0] + parts[1]), ["x"], "w")).first()
    for name in ("total_count", "null_count", "valid_count", "sum_x", "sum_x4"):
        assert merged[name] == whole[name]
    for name in ("mean_val", "stddev_val", "skewness_derived", "kurtosis_derived"):
        assert merged[name] == (None if whole[name] is None else pytest.approx(whole[name], rel=1e-8, abs=1e-8))


@pytest.mark.parametrize(
    ("values", "has_skew", "has_kurt"),
    [([1], False, False), ([1, 2], False, False), ([1, 2, 4], True, False), ([1, 2, 4, 4], True, True),
     ([7, 7, 7, 7], False, False), ([None, None], False, False)],
)
def test_small_samples(spark, values, has_skew, has_kurt):
    metrics = stored_metrics(numbers(spark, values), ["x"], "r")
    for row in (derive_metrics(metrics).first(), shape_from_raw_sums(metrics).first()):
        assert (row["skewness_derived"] is not None) is has_skew
        assert (row["kurtosis_derived"] is not None) is has_kurt


def test_intervals(spark):
    row = derive_metrics(stored_metrics(numbers(spark, [1, 2, 3, 10]), ["x"], "r")).first()
    sd = row["stddev_val"]
    assert row["mean_ci_upper"] == pytest.approx(4 + 1.96 * sd / 2)
    assert row["stddev_ci_lower"] == pytest.approx(sd * (3 / 9.34840360) ** 0.5)
    assert row["stddev_ci_upper"] == pytest.approx(sd * (3 / 0.21579528) ** 0.5)
    assert row["null_rate"] == 0.0
    single = derive_metrics(stored_metrics(numbers(spark, [1]), ["x"], "r")).first()
    assert single["mean_ci_lower"] is None and single["stddev_ci_lower"] is None


def test_chi2_lookup_is_unique_and_optional(spark):
    metrics = stored_metrics(numbers(spark, [1, 2, 3, 10]), ["x"], "r")
    other = spark.createDataFrame([(9, 0.05, 1.0, 2.0)], "df long, alpha double, chi2_lower double, chi2_upper double")
    assert with_stddev_ci(metrics, other).first()["stddev_ci_lower"] is None
    twice = chi2_critical_values(metrics)
    with pytest.raises(PySparkException, match="several critical values"):
        with_stddev_ci(metrics, twice.unionByName(twice)).collect()


def test_schema_evolution_and_view(spark, tmp_path):
    path = str(tmp_path / "metrics")
    metrics = stored_metrics(numbers(spark, [1, 2, 3, 10]), ["x"], "r2")
    old = metrics.select("column_name", "total_count", "valid_count").withColumn("run_id", F.lit("r1"))
    append_metrics(old, path)
    append_metrics(metrics, path)
    rows = {r["run_id"]: r for r in read_metrics(spark, path).collect()}
    assert rows["r1"]["sum_x"] is None and str(rows["r2"]["sum_x"]) == "16.00"
    assert rows["r2"]["skewness"] is None
    assert evolve_metrics(metrics).columns == metrics.columns
    view = create_derived_view(spark, metrics)
    assert spark.table("profiler_run_metrics_with_ci").count() == view.count() == 1
