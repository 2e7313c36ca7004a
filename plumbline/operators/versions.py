"""Content versions of tables, so that an incremental scan reads only what has changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.templates import quoted

STAMP_SCHEMA = "schema_name string, table_name string, files string, version string"


@dataclass(frozen=True)
class Stamp:
    """A table's file list and content version; `is_known` if a former scan saw that version."""

    table_name: str
    files: str | None
    version: str
    is_known: bool


def _hashable(column: Column, data_type: T.DataType) -> Column:
    """Maps have no order and no hash; their sorted entries have both."""
    return F.array_sort(F.map_entries(column)) if isinstance(data_type, T.MapType) else column


def content_version(df: DataFrame) -> DataFrame:
    """(version): one row that is equal for equal multisets of rows, in whatever order or files.

    Two 64-bit hashes of every row are summed without overflow, next to the number of rows; both are
    partial aggregates, so a task sends one row. Column names and types are part of the version.
    """
    columns = sorted(df.schema.fields, key=lambda f: f.name)
    values = [_hashable(F.col(quoted(f.name)), f.dataType) for f in columns]
    # a hash skips nulls, so that where they stand has to be said apart
    holes = F.concat(F.lit(""), *[F.when(F.col(quoted(f.name)).isNull(), "1").otherwise("0") for f in columns])
    sums = [F.sum(F.xxhash64(F.lit(salt), holes, *values).cast("decimal(20,0)")) for salt in (1, 2)]
    layout = F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in columns))
    parts = [F.count(F.lit(1)).cast("string"), *[F.coalesce(s, F.lit(0)).cast("string") for s in sums]]
    return df.agg(F.concat_ws(":", *parts, F.hex(F.xxhash64(layout))).alias("version"))


def file_stamp(df: DataFrame) -> DataFrame | None:
    """(files): one row that names the files behind a table, their sizes and times; None if it has none.

    Only file metadata is read. The plan on top of the files is part of it, since the same files may
    be read in another way.
    """
    try:
        files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    except AnalysisException:
        return None
    each = F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(20,0)")
    parts = [F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(each), F.lit(0)).cast("string"), F.lit(str(df.semanticHash()))]
    return files.agg(F.concat_ws(":", *parts).alias("files"))


def _one_row_each(rows: Mapping[str, DataFrame]) -> dict[str, str]:
    """The single value of each frame, in one job; one row a table comes back."""
    parts = [frame.toDF("value").withColumn("table_name", F.lit(name)) for name, frame in rows.items()]
    return {r["table_name"]: r["value"] for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}


def table_stamps(tables: Mapping[str, DataFrame], schema_name: str, known: DataFrame | None = None) -> list[Stamp]:
    """The current version of every table.

    `known` has (schema_name, table_name, files, version) of former scans. A table whose files are
    those of a known row has its version unread; others are read once for their content.
    """
    seen: dict[str, list] = {name: [] for name in tables}
    if known is not None:
        listed = known.where((F.col("schema_name") == schema_name) & F.col("table_name").isin(*tables))
        for row in listed.select("table_name", "files", "version").distinct().collect():
            seen[row["table_name"]].append((row["files"], row["version"]))
    stamps = {name: stamp for name, df in tables.items() if (stamp := file_stamp(df)) is not None}
    files = _one_row_each(stamps)
    versions = {}
    for name in tables:
        same = [v for f, v in seen[name] if f is not None and f == files.get(name)]
        if same:
            versions[name] = same[0]
    versions |= _one_row_each({name: content_version(df) for name, df in tables.items() if name not in versions})
    return [Stamp(n, files.get(n), versions[n], versions[n] in {v for _, v in seen[n]}) for n in tables]


def with_versions(catalog: DataFrame, schema_name: str, stamps: Sequence[Stamp]) -> DataFrame:
    """The catalog with `files` and `version` of each column's table."""
    rows = [(schema_name, s.table_name, s.files, s.version) for s in stamps]
    stamped = catalog.sparkSession.createDataFrame(rows, STAMP_SCHEMA)
    return catalog.join(F.broadcast(stamped), ["schema_name", "table_name"])  # one row a table
