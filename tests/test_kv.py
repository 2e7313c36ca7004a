import datetime as dt

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of

from plumbline.operators import kv
from plumbline.streaming.kv_stream import stream_state

NOON = dt.datetime(2024, 1, 1, 12, 0, 0)
SCHEMA = "seq long, op string, key long, value string, ttl_s long, ts timestamp_ntz"
OPERATIONS = [
    ("put", 1, "AbCD", 600),
    ("put", 2, "A", 300),
    ("put", 2, "PQRS", -300),
    ("put", 3, "PQRS", 300),
    ("put", 4, "PQRS", 300),
    ("put", 5, "PQRS", 300),
    ("put", 6, "AbCD", 300),
    ("put", 7, "AbCD", 300),
    ("remove", 1, None, None),
    ("put", 8, "ccd", 300),
]


def log_of(spark, operations):
    rows = [(i, op, key, value, ttl, NOON) for i, (op, key, value, ttl) in enumerate(operations)]
    return spark.createDataFrame(rows, SCHEMA)


def at(seconds=0):
    return F.lit(NOON + dt.timedelta(seconds=seconds)).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def log(spark):
    return log_of(spark, OPERATIONS)


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_state_after_the_demo(log):
    state = kv.kv_state(log)
    assert keys(kv.live_state(state, at())) == [3, 4, 5, 6, 7, 8]
    assert keys(kv.expired_state(state, at())) == [2]
    assert keys(kv.removed_keys(log)) == [1]
    assert keys(kv.live_state(state, at(300))) == [3, 4, 5, 6, 7, 8]
    assert keys(kv.live_state(state, at(301))) == []


def test_lookups(spark, log):
    asked = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 3, 99)], "key long")
    got = {r["key"]: (r["value"], r["times"]) for r in kv.kv_get(log, asked, at()).collect()}
    assert got == {1: (None, 1), 2: (None, 1), 3: ("PQRS", 3), 99: (None, 1)}
    with_expired = kv.kv_get(log, asked, at(), include_expired=True).collect()
    assert {r["key"]: r["value"] for r in with_expired}[2] == "PQRS"


def test_lookup_narrows_the_log_before_its_state_is_built(spark, log):
    asked = spark.createDataFrame([(k,) for k in range(12)], "key long")
    plan = plan_of(kv.kv_get(log, asked, at()))
    assert "LeftSemi" in plan
    assert plan.index("Aggregate") < plan.rindex("LeftSemi")


def test_reinsert_and_renewal(spark):
    log = log_of(
        spark, [("put", 1, "a", 10), ("remove", 1, None, None), ("put", 1, "b", 20), ("put", 1, "b", 90)]
    )
    row = kv.kv_state(log).first()
    assert (row["value"], row["expiry"]) == ("b", NOON + dt.timedelta(seconds=90))
    absent = log_of(spark, [("remove", 5, None, None)])
    assert kv.kv_state(absent).isEmpty()


def test_value_index_blocks(log):
    live = kv.live_state(kv.kv_state(log), at())
    whole = {r["value"]: r["keys"] for r in kv.value_index(live).collect()}
    assert whole == {"AbCD": [6, 7], "PQRS": [3, 4, 5], "ccd": [8]}
    blocks = kv.value_index(live, block_keys=2).orderBy("value", "block").collect()
    assert [(r["value"], r["block"], r["keys"]) for r in blocks] == [
        ("AbCD", 3, [6, 7]),
        ("PQRS", 1, [3]),
        ("PQRS", 2, [4, 5]),
        ("ccd", 4, [8]),
    ]
    assert max(len(r["keys"]) for r in blocks) <= 2


def test_compaction_splits_the_state(log):
    state = kv.kv_state(log)
    marked = kv.compaction(state, at())
    assert marked.count() == state.count()
    assert keys(marked.where("keep")) == [3, 4, 5, 6, 7, 8]
    assert keys(marked.where("NOT keep")) == [2]


def test_stored_state_prunes_expired_days(spark, log, tmp_path):
    path = str(tmp_path / "state")
    kv.write_state(kv.kv_state(log), path)
    live = kv.read_live(spark.read.parquet(path), at())
    assert keys(live) == [3, 4, 5, 6, 7, 8]
    assert "PartitionFilters: [isnotnull(expiry_date" in plan_of(live)


def test_hot_key_is_combined_before_the_shuffle(spark):
    hot = spark.range(20_000).select(
        F.col("id").alias("seq"),
        F.lit("put").alias("op"),
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("long").alias("key"),
        F.col("id").cast("string").alias("value"),
        F.lit(60).cast("long").alias("ttl_s"),
        F.lit(NOON).cast("timestamp_ntz").alias("ts"),
    )
    state = kv.kv_state(hot)
    assert state.where("key = 7").first()["value"] == "19999"
    plan = plan_of(state)
    assert plan.count("Exchange") == 1
    assert plan.index("partial_max_by") > plan.index("Exchange")


def test_stream_keeps_the_latest_operation(spark, log, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("source", "out", "marks"))
    operations = log.orderBy("seq")
    for low, high in ((0, 5), (5, 100)):
        operations.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream_state(stream, out, marks).awaitTermination(120)
    changes = spark.read.parquet(out)
    latest = changes.groupBy("key").agg(F.max_by(F.struct("op", "value"), "batch").alias("l"))
    got = {r["key"]: (r["l"]["op"], r["l"]["value"]) for r in latest.collect()}
    wanted = {r["key"]: (r["op"], r["value"]) for r in kv.last_operations(log).collect()}
    assert got == wanted
