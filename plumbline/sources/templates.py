"""Statistic templates: the user-extensible dictionary from statistic name to SQL expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = "<<col>>"

# Built-in templates. Distinct counts are approximate unless a spec forces them.
DEFAULT_TEMPLATES = {
    "Empty Count": "COUNT_IF(<<col>> IS NULL OR TRIM(<<col>>) = '')",
    "Min": "MIN(<<col>>)",
    "Max": "MAX(<<col>>)",
    "Mean": "AVG(<<col>>)",
    "Distinct Count": "APPROX_COUNT_DISTINCT(<<col>>)",
    "Skewness": "SKEWNESS(<<col>>)",
    "Kurtosis": "KURTOSIS(<<col>>)",
}
# Floating columns: NaN and infinite values are left out, or one of them would be the result.
_FINITE = "CASE WHEN abs(<<col>>) < double('Infinity') THEN <<col>> END"
FINITE_TEMPLATES = {
    stat: DEFAULT_TEMPLATES[stat].replace(PLACEHOLDER, _FINITE)
    for stat in ("Min", "Max", "Mean", "Skewness", "Kurtosis")
}
NOT_FINITE_TEMPLATE = "COUNT_IF(NOT abs(<<col>>) < double('Infinity'))"
# Only text can be blank; other types skip the trim.
NULL_COUNT_TEMPLATE = "COUNT_IF(<<col>> IS NULL)"


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def finite_template(stat: str, template: str | None, data_type: T.DataType) -> str | None:
    """The built-in template's finite form for a floating column; any other as it is."""
    if is_floating(data_type) and template == DEFAULT_TEMPLATES.get(stat):
        return FINITE_TEMPLATES.get(stat, template)
    return template


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def expand_sql(template: str, column: str) -> str:
    """The template as SQL text over one column."""
    return template.replace(PLACEHOLDER, quoted(column))


def expand(template: str, column: str) -> Column:
    """The template as a Spark expression over one column."""
    return F.expr(expand_sql(template, column))


def templates_frame(spark: SparkSession, templates: Mapping[str, str | None]) -> DataFrame:
    return spark.createDataFrame(list(templates.items()), "stat string, template string")


def load_templates(stat2sql: DataFrame, platform: str = "template") -> dict[str, str]:
    """Read one platform's templates from the (stat, <platform>) table.

    Names and templates are stripped; blank templates are left out. The table is a
    configuration dictionary with one row per statistic name.
    """
    template = F.trim(F.col(quoted(platform.lower())))
    rows = (
        stat2sql.select(F.trim("stat").alias("stat"), template.alias("template"))
        .where("template IS NOT NULL AND template <> ''")
        .collect()
    )
    return {row["stat"]: row["template"] for row in rows}
