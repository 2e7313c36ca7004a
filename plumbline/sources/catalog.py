"""The column catalog: one row per column of every table, with measured statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import OTHER, STRING, type_family
from plumbline.functions.text import (
    SEMANTIC_PATTERNS,
    SEMANTIC_SHARE,
    is_id_name,
    matches_any_glob,
    semantic_test_sql,
    short_count,
)
from plumbline.sources.templates import quoted, sql_text


def _tag_sql(i: int) -> str:
    """First tag whose pattern fits at least the required share of the values."""
    cases = " ".join(
        f"WHEN t{i}_{k} >= {SEMANTIC_SHARE} * v{i} THEN {sql_text(tag)}"
        for k, (tag, _) in enumerate(SEMANTIC_PATTERNS)
    )
    return f"CASE WHEN v{i} = 0 THEN 'NONE' {cases} ELSE 'NONE' END"


def _table_rows(schema_name: str, table: str, df: DataFrame, measure: bool) -> DataFrame | None:
    fields = [f for f in df.schema.fields if type_family(f.dataType) != OTHER]
    if not fields:
        return None
    aggregates = ["count(1) AS n"]
    entries = []
    for i, field in enumerate(fields):
        family = type_family(field.dataType)
        valid = distinct = "CAST(NULL AS BIGINT)"
        chosen = "CAST(NULL AS STRING)"
        if measure:
            column = quoted(field.name)
            aggregates.append(f"count({column}) AS v{i}")
            aggregates.append(f"approx_count_distinct({column}) AS d{i}")
            valid, distinct, chosen = f"v{i}", f"d{i}", "'NONE'"
            if family == STRING:
                aggregates += [
                    f"count_if({semantic_test_sql(tag, column)}) AS t{i}_{k}"
                    for k, (tag, _) in enumerate(SEMANTIC_PATTERNS)
                ]
                chosen = _tag_sql(i)
        entries.append(
            f"named_struct('schema_name', {sql_text(schema_name)}, "
            f"'table_name', {sql_text(table)}, 'column_name', {sql_text(field.name)}, "
            f"'data_type', {sql_text(field.dataType.simpleString())}, "
            f"'type_family', {sql_text(family)}, 'row_count', n, 'valid_count', {valid}, "
            f"'distinct_count', {distinct}, 'semantic_tag', {chosen})"
        )
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")


def column_catalog(
    tables: Mapping[str, DataFrame],
    schema_name: str = "main",
    measure: bool = False,
) -> DataFrame:
    """Catalog of all scalar columns.

    One aggregate scan per table. Without `measure` only the row count is taken, which a
    columnar source answers without reading columns; with it, the same scan also yields valid
    and approximate distinct counts and the semantic tag of text columns.
    """
    parts = [_table_rows(schema_name, name, df, measure) for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, [p for p in parts if p is not None])
    return rows.withColumns(
        {"row_label": short_count(F.col("row_count")), "is_id": is_id_name(F.col("column_name"))}
    )


def without_utility(catalog: DataFrame, globs: str | Sequence[str]) -> DataFrame:
    """Drop utility tables and columns by glob."""
    return catalog.where(
        ~matches_any_glob(F.col("table_name"), globs)
        & ~matches_any_glob(F.col("column_name"), globs)
    )


def in_scope(catalog: DataFrame, scope: DataFrame) -> DataFrame:
    """Keep the columns of the tables listed in `scope(schema_name, table_name)`."""
    return catalog.join(scope, ["schema_name", "table_name"], "left_semi")


def table_nodes(catalog: DataFrame, tags: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One graph node per table, with its row count, label and user tags."""
    entries = [
        F.struct(F.lit(t).alias("t"), F.array(*[F.lit(x) for x in values]).alias("tags"))
        for t, values in (tags or {}).items()
        if values
    ]
    nodes = catalog.groupBy("schema_name", "table_name").agg(
        F.max("row_count").alias("row_count"), F.max("row_label").alias("row_label")
    )
    empty = F.array().cast("array<string>")
    lookup = F.map_from_entries(F.array(*entries))[F.col("table_name")] if entries else empty
    return nodes.select(
        F.concat_ws(".", "schema_name", "table_name").alias("id"),
        "schema_name",
        "table_name",
        "row_count",
        "row_label",
        F.coalesce(lookup, empty).alias("tags"),
    )
