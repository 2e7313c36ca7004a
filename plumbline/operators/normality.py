"""Pass 4: Shapiro-Wilk normality of a micro-sample."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shapiro import shapiro_wilk
from plumbline.functions.shipping import ship_by_value
from plumbline.sources.templates import quoted

TEST_NAME = "Shapiro-Wilk"
ALPHA = 0.05

_SCHEMA = "column_name string, normality_stat double, p_value double"


def _test_group(group: pd.DataFrame) -> pd.DataFrame:
    result = shapiro_wilk(group["value"].dropna().to_numpy(dtype=float))
    stat, p_value = result if result else (None, None)
    return pd.DataFrame(
        {
            "column_name": [group["column_name"].iloc[0]],
            "normality_stat": pd.array([stat], dtype="Float64"),
            "p_value": pd.array([p_value], dtype="Float64"),
        }
    )


def normality(micro: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Test name, W, p and verdict per numeric column of a micro-sample.

    Fewer than four values, or a constant column, give NULLs. Each group holds one column of
    the micro-sample, so its size is fixed.
    """
    stacked = micro.select(
        *[F.col(quoted(c)).cast("double").alias(c) for c in columns]
    ).unpivot([], [F.col(quoted(c)) for c in columns], "column_name", "value")
    tested = stacked.groupBy("column_name").applyInPandas(_test_group, _SCHEMA)
    return tested.select(
        "column_name",
        F.lit(TEST_NAME).alias("normality_test"),
        "normality_stat",
        "p_value",
        (F.col("p_value") > ALPHA).alias("is_normal"),
    )


ship_by_value(__name__)
