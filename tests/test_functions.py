import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import bounded_key, hash_sampled, trailing_zero_bits
from plumbline.functions.shapiro import shapiro_wilk
from plumbline.functions.text import (
    char_pattern,
    char_pattern_sql,
    is_id_literal,
    is_id_name,
    matches_any_glob,
    name_aliases,
    name_similarity,
    short_count,
)


def one(spark, value, expression, sql_type="string"):
    df = spark.createDataFrame([(value,)], f"v {sql_type}")
    return df.select(expression(F.col("v")).alias("r")).first()["r"]


def test_char_pattern_keeps_what_is_not_ascii_alphanumeric(spark):
    assert one(spark, "AbC-12é3", char_pattern) == "AAA-NNéN"
    assert one(spark, "AbC-12é3", lambda v: F.expr(char_pattern_sql("v"))) == "AAA-NNéN"
    assert one(spark, "", char_pattern) == ""
    assert one(spark, None, char_pattern) is None


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("event_id", True),
        ("DIM_SK", True),
        ("order_key", True),
        ("rowuuid", True),
        ("ID", True),
        ("pk", True),
        ("l_orderkey", False),
        ("idea", False),
        ("paid", False),
    ],
)
def test_id_rule(spark, name, expected):
    assert one(spark, name, is_id_name) is expected
    assert is_id_literal(name) is expected


def test_globs_are_anchored(spark):
    globs = "*_tmp, *_bak, audit_*, sys_*"
    rows = [("orders_tmp", True), ("audit_log", True), ("my_audit_log", False), ("a.tmp", False)]
    for name, expected in rows:
        assert one(spark, name, lambda v: matches_any_glob(v, globs)) is expected
    assert one(spark, "x", lambda v: matches_any_glob(v, "")) is False


def test_name_similarity_and_aliases(spark):
    df = spark.createDataFrame([("l_orderkey", "o_orderkey"), ("abc", "abc"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([90.0, 100.0, 100.0])
    aliases = spark.createDataFrame([("ID", "ORDERS")], "c string, t string").select(
        name_aliases(F.col("c"), F.col("t"))
    )
    assert aliases.first()[0] == ["id", "order_id"]


def test_short_count(spark):
    pairs = [(999, "999"), (1000, "1k"), (450_000, "450k"), (1_250_000, "1.2M"), (4_500_000, "4.5M")]
    for n, label in pairs:
        assert one(spark, n, short_count, "long") == label


def test_trailing_zero_bits(spark):
    for n in (1, 2, 8, 12, -8, 2**40, 0):
        expected = 64 if n == 0 else (n & -n).bit_length() - 1
        assert one(spark, n, trailing_zero_bits, "long") == expected


def test_bounded_key_never_mixes_values_and_digests(spark):
    assert one(spark, "x" * 64, bounded_key) == "x" * 64
    long_key = one(spark, "x" * 65, bounded_key)
    assert len(long_key) == 65 and long_key.startswith("#")
    assert one(spark, "x" * 66, bounded_key) != long_key


def test_hash_sample_share(spark):
    n = spark.range(20_000).where(hash_sampled(F.col("id"), 0.25)).count()
    assert abs(n / 20_000 - 0.25) < 0.02


def test_shapiro_published_example():
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.788815, abs=1e-5)
    assert p == pytest.approx(0.006704, abs=1e-5)


def test_shapiro_guards_and_large_samples():
    assert shapiro_wilk(np.array([1.0, 2.0, 3.0])) is None
    assert shapiro_wilk(np.array([2.0] * 10)) is None
    assert shapiro_wilk(np.array([1.0, 2.0, 3.0, math.nan])) is None
    rng = random.Random(7)
    normal = np.array([rng.gauss(10, 3) for _ in range(2000)])
    skewed = np.array([rng.expovariate(1) for _ in range(2000)])
    assert shapiro_wilk(normal)[1] > 0.05
    assert shapiro_wilk(skewed)[1] < 1e-6
