"""Run registered queries against their SQL: python -m checks.compare [folder] [names...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES, TABLES


def _cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(round(value, 6) + 0.0)
    return str(value)


def _rows(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, folder: str, name: str) -> str:
    """An empty text if both agree, otherwise the first difference."""
    frame = QUERIES[name](spark, folder)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        return "" if got else "no rows"
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = connection.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} <> {sorted(columns)}"
    wanted = _rows(columns, cursor.fetchall())
    if got == wanted:
        return ""
    extra = [r for r in got if r not in set(wanted)][:2]
    lacking = [r for r in wanted if r not in set(got)][:2]
    return f"{len(got)} <> {len(wanted)} rows; only here {extra}; only there {lacking}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    failures = 0
    for name in names:
        started = time.time()
        try:
            verdict = compare(spark, folder, name)
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error).splitlines()[0][:300]}"
        failures += bool(verdict)
        checked = "oracle" if name in ORACLES else "rows"
        spent = f"{time.time() - started:6.1f}s"
        print(f"{name:24s} {checked:7s} {spent} {verdict or 'ok'}", flush=True)
    print(f"{failures} failures of {len(names)}")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
