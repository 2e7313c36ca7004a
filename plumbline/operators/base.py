"""Pass 1: every cheap statistic of a column batch in one scan of the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import BASE_STATS, TIERS, ColumnSpec
from plumbline.functions.hashing import bounded_key
from plumbline.functions.text import char_pattern, char_pattern_sql, is_id_literal
from plumbline.sources.templates import (
    DEFAULT_TEMPLATES,
    NOT_FINITE_TEMPLATE,
    NULL_COUNT_TEMPLATE,
    expand_sql,
    finite_template,
    is_floating,
    quoted,
    sql_text,
)

TOTAL = "total_count"
PATTERN_STAT = "Pattern_Distinct_Count"
NOT_FINITE_STAT = "Not_Finite_Count"


def alias_of(column: str, stat: str) -> str:
    return f"{column}__{stat}"


def wants_exact(spec: ColumnSpec, tier: str) -> bool:
    """Exact distinct counts need both the compliance tier and the column's own flag."""
    if tier.upper() not in TIERS:
        raise ValueError(f"unknown tier {tier!r}")
    return tier.upper() == "COMPLIANCE" and spec.force_exact_distinct


def wants_pattern_count(spec: ColumnSpec) -> bool:
    return spec.is_string and not is_id_literal(spec.column_name)


def _template_for(stat: str, spec: ColumnSpec, templates: Mapping[str, str]) -> str | None:
    template = templates.get(stat)
    if stat == "Empty Count" and not spec.is_string and template == DEFAULT_TEMPLATES[stat]:
        return NULL_COUNT_TEMPLATE
    return template


def base_scan(
    df: DataFrame,
    specs: Sequence[ColumnSpec],
    templates: Mapping[str, str] = DEFAULT_TEMPLATES,
    tier: str = "BASIC",
    count_not_finite: bool = False,
) -> DataFrame:
    """One wide row: total_count and `{column}__{statistic}` for each requested base statistic.

    Unknown statistics are skipped. The built-in bounds and mean of floating columns leave out NaN and
    infinite values; `count_not_finite` adds their number. Columns forced to exact distinct counts are left to
    `exact_distinct_counts`, which keeps this scan a plain partial aggregate.
    """
    aggregates = [f"count(1) AS {TOTAL}"]
    for spec in specs:
        name = spec.column_name
        exact = wants_exact(spec, tier)
        for stat in spec.stats:
            template = finite_template(stat, _template_for(stat, spec, templates), df.schema[name].dataType)
            if stat not in BASE_STATS or not template or (stat == "Distinct Count" and exact):
                continue
            alias = quoted(alias_of(name, stat))
            aggregates.append(f"{expand_sql(template, name)} AS {alias}")
        if count_not_finite and is_floating(df.schema[name].dataType):
            aggregates.append(f"{expand_sql(NOT_FINITE_TEMPLATE, name)} AS {quoted(alias_of(name, NOT_FINITE_STAT))}")
        if wants_pattern_count(spec) and not exact:
            alias = quoted(alias_of(name, PATTERN_STAT))
            aggregates.append(
                f"approx_count_distinct({char_pattern_sql(quoted(name))}) AS {alias}"
            )
    return df.selectExpr(*aggregates)


_LONG_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DOUBLE_TYPES = (T.FloatType, T.DoubleType)


def _native_class(data_type: T.DataType) -> str:
    if isinstance(data_type, _LONG_TYPES):
        return "bigint"
    if isinstance(data_type, _DOUBLE_TYPES):
        return "double"
    if isinstance(data_type, T.DateType):
        return "date"
    return data_type.simpleString()


def _grouping_key(name: str, sql_type: str) -> Column:
    """The value in its storage class; a long text is grouped by its digest."""
    value = F.col(quoted(name)).cast(sql_type)
    return bounded_key(value) if sql_type == "string" else value


def exact_distinct_counts(df: DataFrame, expressions: Mapping[str, Column]) -> DataFrame:
    """(name, distinct_count) of each expression, NULLs not counted.

    Columns of one storage class are stacked into narrow (name, value) rows, so a class costs
    one scan of its own columns and one shuffle of values already deduplicated on the map
    side. A multi-column COUNT(DISTINCT) would instead widen each row to all columns.
    """
    projected = df.select(*[e.alias(name) for name, e in expressions.items()])
    groups: dict[str, list[str]] = {}
    for field in projected.schema.fields:
        groups.setdefault(_native_class(field.dataType), []).append(field.name)
    parts = []
    for sql_type, names in groups.items():
        typed = projected.select(*[_grouping_key(n, sql_type).alias(n) for n in names])
        stacked = typed.unpivot([], [F.col(quoted(n)) for n in names], "name", "value")
        parts.append(
            stacked.where("value IS NOT NULL")
            .groupBy("name", "value")
            .agg(F.lit(1).alias("seen"))
            .groupBy("name")
            .agg(F.count(F.lit(1)).alias("distinct_count"))
        )
    return reduce(DataFrame.unionByName, parts)


def exact_expressions(specs: Sequence[ColumnSpec], tier: str) -> dict[str, Column]:
    """The distinct counts the compliance tier wants exactly, named as in the wide row."""
    expressions = {}
    for spec in specs:
        if not wants_exact(spec, tier):
            continue
        column = F.col(quoted(spec.column_name))
        if "Distinct Count" in spec.stats:
            expressions[alias_of(spec.column_name, "Distinct Count")] = column
        if wants_pattern_count(spec):
            expressions[alias_of(spec.column_name, PATTERN_STAT)] = char_pattern(column)
    return expressions


def base_metrics(
    df: DataFrame,
    specs: Sequence[ColumnSpec],
    templates: Mapping[str, str] = DEFAULT_TEMPLATES,
    tier: str = "BASIC",
) -> DataFrame:
    """Pass 1 unpivoted to one row per column, together with the column's own settings.

    The bounds of a numeric column are always taken, since its histogram needs them.
    """
    specs = [_with_bounds(s) for s in specs]
    placed = list(enumerate(specs))
    text = [(i, s) for i, s in placed if s.is_string]
    other = [(i, s) for i, s in placed if not s.is_string]
    parts = [_long_rows(df, part, templates, tier) for part in (text, other) if part]
    rows = reduce(DataFrame.unionByName, parts)
    exact = exact_expressions(specs, tier)
    return _with_exact_counts(rows, df, specs, tier, exact) if exact else rows


def _long_rows(
    df: DataFrame,
    placed: Sequence[tuple[int, ColumnSpec]],
    templates: Mapping[str, str],
    tier: str,
) -> DataFrame:
    """Text columns are scanned apart from the rest.

    Their bounds force a slower aggregate, which would otherwise take in all columns. The two
    scans read disjoint columns, so a columnar source delivers each column once.
    """
    wide = base_scan(df, [s for _, s in placed], templates, tier, count_not_finite=True)
    present = set(wide.columns)

    def stat(spec: ColumnSpec, name: str, sql_type: str) -> str:
        alias = alias_of(spec.column_name, name)
        return f"CAST({quoted(alias) if alias in present else 'NULL'} AS {sql_type})"

    def entry(position: int, spec: ColumnSpec) -> str:
        low = high = "CAST(NULL AS DOUBLE)"
        if spec.is_numeric:
            low, high = stat(spec, "Min", "DOUBLE"), stat(spec, "Max", "DOUBLE")
        stats = ", ".join(sql_text(s) for s in spec.stats)
        bins = "NULL" if spec.histogram_bins is None else str(spec.histogram_bins)
        fields = {
            "position": str(position),
            "column_name": sql_text(spec.column_name),
            "data_type": sql_text(spec.data_type),
            "stats": f"CAST(array({stats}) AS array<string>)",
            "histogram_bins": f"CAST({bins} AS INT)",
            "normality_test_wanted": str(spec.normality_test).lower(),
            TOTAL: TOTAL,
            "empty_count": stat(spec, "Empty Count", "BIGINT"),
            "min": stat(spec, "Min", "STRING"),
            "max": stat(spec, "Max", "STRING"),
            "min_number": low,
            "max_number": high,
            "mean_val": stat(spec, "Mean", "DOUBLE"),
            "distinct_count": stat(spec, "Distinct Count", "BIGINT"),
            "pattern_distinct_count": stat(spec, PATTERN_STAT, "BIGINT"),
            "not_finite_count": stat(spec, NOT_FINITE_STAT, "BIGINT"),
        }
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    entries = ", ".join(entry(i, s) for i, s in placed)
    return wide.selectExpr(f"inline(array({entries}))")


def _with_exact_counts(
    rows: DataFrame,
    df: DataFrame,
    specs: Sequence[ColumnSpec],
    tier: str,
    exact: Mapping[str, Column],
) -> DataFrame:
    """Put exact distinct counts in place; a forced column without values counts zero."""
    counts = exact_distinct_counts(df, exact).select(
        F.regexp_extract("name", "^(.*)__(.*)$", 1).alias("column_name"),
        F.regexp_extract("name", "^(.*)__(.*)$", 2).alias("stat"),
        F.col("distinct_count").alias("exact_count"),
    )
    by_column = counts.groupBy("column_name").agg(
        F.max(F.when(F.col("stat") == "Distinct Count", F.col("exact_count"))).alias("exact"),
        F.max(F.when(F.col("stat") == PATTERN_STAT, F.col("exact_count"))).alias("exact_patterns"),
    )
    forced = [s.column_name for s in specs if wants_exact(s, tier)]
    zero_if_forced = F.when(F.col("column_name").isin(*forced), F.lit(0).cast("long"))
    patterned = [s.column_name for s in specs if wants_exact(s, tier) and wants_pattern_count(s)]
    zero_if_patterned = F.when(F.col("column_name").isin(*patterned), F.lit(0).cast("long"))
    return (
        rows.join(by_column, "column_name", "left")
        .withColumns(
            {
                "distinct_count": F.coalesce("exact", zero_if_forced, "distinct_count"),
                "pattern_distinct_count": F.coalesce(
                    "exact_patterns", zero_if_patterned, "pattern_distinct_count"
                ),
            }
        )
        .select(*rows.columns)
    )


def _with_bounds(spec: ColumnSpec) -> ColumnSpec:
    missing = tuple(s for s in ("Min", "Max") if s not in spec.stats)
    if not spec.is_numeric or not missing:
        return spec
    return ColumnSpec(
        spec.column_name,
        spec.data_type,
        spec.stats + missing,
        spec.force_exact_distinct,
        spec.histogram_bins,
        spec.normality_test,
    )
