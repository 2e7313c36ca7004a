"""Content versions and the incremental scan that rests on them."""

from conftest import plan_of
from pyspark.sql import functions as F

from plumbline.operators.versions import content_version, file_stamp, table_stamps
from plumbline.plans.discovery import DiscoveryOptions, discover


def version(df):
    return content_version(df).first()["version"]


def test_versions_tell_multisets_of_rows_apart(spark):
    schema = "a int, b int, m map<string,int>, x array<double>"
    rows = [(1, None, {"k": 1, "l": 2}, [0.5]), (None, 1, None, None), (1, None, {"k": 1, "l": 2}, [0.5])]
    base = spark.createDataFrame(rows, schema)
    same = spark.createDataFrame([rows[1], rows[0], (1, None, {"l": 2, "k": 1}, [0.5])], schema).repartition(3)
    assert version(base) == version(same) == version(base.select("x", "m", "b", "a"))
    others = [
        spark.createDataFrame(rows[:2], schema),
        spark.createDataFrame([rows[0], rows[0], rows[0]], schema),
        spark.createDataFrame([rows[0], (1, None, None, None), rows[0]], schema),
        base.withColumnRenamed("a", "c"),
        base.withColumn("a", F.col("a").cast("long")),
        base.limit(0),
    ]
    assert len({version(df) for df in [base, *others]}) == 1 + len(others)


def test_unchanged_files_are_not_read_and_rewritten_ones_keep_their_version(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v").write.parquet(f"{tmp_path}/a")
    spark.range(50).selectExpr("id AS k").write.parquet(f"{tmp_path}/b")
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("a", "b")}
    first = table_stamps(read, "main")
    assert not any(s.is_known for s in first) and all(s.files for s in first)
    known = spark.createDataFrame([("main", s.table_name, s.files, "as stored") for s in first], "schema_name string, table_name string, files string, version string")
    again = table_stamps({n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("a", "b")}, "main", known)
    assert [(s.version, s.is_known) for s in again] == [("as stored", True)] * 2
    read["b"].repartition(3).write.parquet(f"{tmp_path}/c")
    stored = spark.createDataFrame([("main", s.table_name, s.files, s.version) for s in first], "schema_name string, table_name string, files string, version string")
    moved = table_stamps({"b": spark.read.parquet(f"{tmp_path}/c")}, "main", stored)[0]
    assert moved.is_known and moved.files != first[1].files
    assert "id" not in plan_of(file_stamp(read["a"])).split("ReadSchema")[1].split(">")[0]


def test_only_changed_tables_are_measured_and_compared(spark, tmp_path):
    for name, rows in (("orders", 60), ("customers", 40), ("items", 30)):
        spark.range(rows).selectExpr("id AS customer_code", "id % 7 AS part_code").write.parquet(f"{tmp_path}/{name}")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("orders", "customers", "items")}
    options = DiscoveryOptions(content_versions=True)
    first = discover(tables, options=options)
    first.catalog.write.parquet(f"{tmp_path}/catalog")
    first.pairs.write.parquet(f"{tmp_path}/pairs")
    assert first.pairs.count() == 6
    first.release()
    known, judged = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("catalog", "pairs"))
    keys = [c for c in judged.columns if c.endswith(("_schema", "_table", "_column", "_version"))]
    evaluated = judged.select(*keys)
    nothing = discover(tables, options=options, evaluated=evaluated, known=known)
    assert nothing.pairs.count() == 0 and nothing.catalog.count() == 6
    plan = nothing.catalog._jdf.queryExecution().analyzed().toString()
    assert not any(f"{tmp_path}/{n}" in plan for n in tables) and "approx_count_distinct" not in plan
    nothing.release()
    changed = tables | {"items": tables["items"].withColumn("part_code", F.col("part_code") + F.when(F.col("customer_code") == 3, 1).otherwise(0))}
    second = discover(changed, options=options, evaluated=evaluated, known=known)
    found = {(r["left_table"], r["right_table"]) for r in second.pairs.collect()}
    assert found == {("customers", "items"), ("items", "orders")}
    assert second.overlaps.count() == 4
    second.release()
