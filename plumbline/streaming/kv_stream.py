"""The key-value state kept up to date from a stream of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.kv import last_operations


def stream_state(operations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed keys per micro-batch to path/batch=<n>/, as their latest operation.

    Spark keeps one row per key in its state store. A batch folder is overwritten if its
    micro-batch is retried, so every change lands exactly once. The newest batch of a key wins.
    """

    def write_batch(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        last_operations(operations)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch)
        .trigger(availableNow=True)
        .start()
    )
