"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.queries import KV_AS_OF, QUERIES, TABLES, _kv_log
from plumbline.config import specs_from_schema
from plumbline.operators.kv import compaction, kv_state, live_state, value_index
from plumbline.plans.discovery import DiscoveryOptions, discover
from plumbline.plans.profile import profile
from plumbline.sources.tables import read_tables

RUNS = 3
SINGLE = (
    "profile_base",
    "exact_distinct",
    "pattern_cardinality",
    "shape_stats",
    "box_plot",
    "top_k_freq",
    "histogram",
    "mega_profile",
    "power_sums",
    "kv_get",
)


def drain(frame: DataFrame) -> None:
    """Run a plan to its end without moving rows to the driver."""
    frame.write.format("noop").mode("overwrite").save()


def full_profile(spark: SparkSession, folder: str) -> None:
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    result = profile(df, specs_from_schema(df), "bench")
    for frame in result.payloads().values():
        drain(frame)
    result.release()


def full_discovery(spark: SparkSession, folder: str) -> None:
    tables = read_tables(spark, folder, TABLES)
    result = discover(tables, options=DiscoveryOptions(sample_cap=None))
    drain(result.edges)
    result.release()


def full_kv(spark: SparkSession, folder: str) -> None:
    as_of = F.lit(KV_AS_OF).cast("timestamp_ntz")
    state = kv_state(_kv_log(spark, folder))
    drain(compaction(state, as_of))
    drain(value_index(live_state(state, as_of)))


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    actions = {
        "profile_lineitem": lambda: full_profile(spark, folder),
        "discovery_all_tables": lambda: full_discovery(spark, folder),
        "kv_events": lambda: full_kv(spark, folder),
    }
    for name in SINGLE:
        actions[name] = lambda name=name: drain(QUERIES[name](spark, folder))
    seconds = {
        name: round(statistics.median(timed(action) for _ in range(RUNS)), 3)
        for name, action in actions.items()
    }
    print(
        json.dumps(
            {
                "metric": "headline query wall time, median of 3, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
