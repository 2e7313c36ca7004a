"""Column specs, limits and type families shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Statistic names as callers spell them.
BASE_STATS = ("Empty Count", "Min", "Max", "Mean", "Distinct Count")
SHAPE_STATS = ("Skewness", "Kurtosis", "Box Plot")

# Execution tiers. Only COMPLIANCE changes what is computed.
TIERS = ("BASIC", "ADVANCED", "COMPLIANCE")

STRING = "STRING"
NUMERIC = "NUMERIC"
TEMPORAL = "TEMPORAL"
BOOLEAN = "BOOLEAN"
OTHER = "OTHER"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the profiler and of discovery.

    Whole tables are profiled unless `sample_rows` asks for a sample of about so many rows.
    """

    high_cardinality_ratio: float = 0.90
    top_k_max_distinct: int = 1000
    pattern_max_distinct: int = 100
    top_k: int = 10
    batch_columns: int = 50
    sample_rows: int | None = None
    micro_sample_rows: int = 2000
    default_bins: int = 20
    name_similarity: float = 85.0
    overlap_sample: int | None = None


@dataclass(frozen=True)
class ColumnSpec:
    """What to compute for one column of the profiled table."""

    column_name: str
    data_type: str
    stats: tuple[str, ...] = BASE_STATS + SHAPE_STATS
    force_exact_distinct: bool = False
    histogram_bins: int | None = None
    normality_test: bool = False

    @property
    def is_string(self) -> bool:
        return self.data_type == STRING

    @property
    def is_numeric(self) -> bool:
        return self.data_type == NUMERIC


def type_family(data_type: T.DataType) -> str:
    """The coarse type class used by the gates and by strict type matching."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def specs_from_schema(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    histogram_bins: int | None = 20,
    normality_test: bool = True,
    force_exact_distinct: bool = False,
) -> list[ColumnSpec]:
    """Default specs for every scalar column: shape, histogram and normality only for numbers."""
    wanted = set(columns) if columns is not None else None
    specs = []
    for field in df.schema.fields:
        if wanted is not None and field.name not in wanted:
            continue
        family = type_family(field.dataType)
        if family == OTHER:
            continue
        numeric = family == NUMERIC
        if numeric:
            stats = BASE_STATS + SHAPE_STATS
        else:
            stats = tuple(s for s in BASE_STATS if s != "Mean")
        specs.append(
            ColumnSpec(
                column_name=field.name,
                data_type=family,
                stats=stats,
                force_exact_distinct=force_exact_distinct,
                histogram_bins=histogram_bins if numeric else None,
                normality_test=normality_test and numeric,
            )
        )
    return specs
