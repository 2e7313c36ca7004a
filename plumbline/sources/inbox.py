"""The result inbox: JSON payload folders partitioned by run and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAYLOADS = ("metrics", "frequencies", "patterns", "histograms")


def write_payloads(payloads: dict[str, DataFrame], path: str) -> None:
    """Write each payload under path/<name>/run_id=.../batch_num=.../.

    Re-running a batch replaces its own partitions and leaves every other run alone.
    """
    for name, frame in payloads.items():
        (
            frame.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id", "batch_num")
            .json(f"{path}/{name}")
        )


def read_payload(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Read one payload back; the schema is given so that no inference scan is needed."""
    return spark.read.schema(schema).json(f"{path}/{name}")
