"""A key-value table with time-to-live, kept as a log of put and remove operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, REMOVE = "put", "remove"

# Keys per block of the value index; a block never holds more.
INDEX_BLOCK_KEYS = 65_536

# Requested keys, eight bytes each, that may be broadcast to narrow the log.


def expiry_of(ts: Column, ttl_seconds: Column) -> Column:
    """Time of the operation plus its ttl; a negative ttl has expired already."""
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, ttl_seconds.cast("decimal(18,6)"))


def expired(expiry: Column, as_of: Column) -> Column:
    """Strictly before the reference time; an entry expiring right then is live."""
    return expiry < as_of


def last_operations(log: DataFrame) -> DataFrame:
    """The latest operation per key: (key, op, value, expiry).

    One shuffle by key. Each partition first reduces to one row per key, so a key that fills a
    third of the log costs no more than any other.
    """
    expiry = F.when(F.col("op") == PUT, expiry_of(F.col("ts"), F.col("ttl_s")))
    payload = F.struct("op", "value", expiry.alias("expiry"))
    latest = log.groupBy("key").agg(F.max_by(payload, F.col("seq")).alias("last"))
    return latest.select("key", "last.op", "last.value", "last.expiry")


def kv_state(log: DataFrame) -> DataFrame:
    """Current entries, expired ones included: (key, value, expiry)."""
    return last_operations(log).where(F.col("op") == PUT).drop("op")


def removed_keys(log: DataFrame) -> DataFrame:
    """Keys whose latest operation is a removal."""
    return last_operations(log).where(F.col("op") == REMOVE).select("key")


def live_state(state: DataFrame, as_of: Column) -> DataFrame:
    return state.where(~expired(F.col("expiry"), as_of))


def expired_state(state: DataFrame, as_of: Column) -> DataFrame:
    return state.where(expired(F.col("expiry"), as_of))


def kv_get(
    log: DataFrame, requests: DataFrame, as_of: Column, include_expired: bool = False
) -> DataFrame:
    """(key, value, times): one answer per requested key, NULL if missing, removed or expired.

    `times` says how often the key was asked for, so a request that repeats one key very often
    is still looked up once. The requested keys narrow the log before its state is built; whether
    they are broadcast is left to the optimiser, which knows their size.
    """
    asked = requests.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    state = kv_state(log.join(asked.select("key"), "key", "left_semi"))
    if not include_expired:
        state = live_state(state, as_of)
    answers = asked.join(state.select("key", "value"), "key", "left")
    return answers.select("key", "value", "times")


def value_index(state: DataFrame, block_keys: int = INDEX_BLOCK_KEYS) -> DataFrame:
    """(value, block, keys): the ascending keys of each value, in blocks of the key range.

    Keys are unique in the state, so a block holds at most `block_keys` of them, however many
    keys share a value. Reading the blocks in order gives the whole list.
    """
    block = F.floor(F.col("key") / block_keys).cast("long")
    return (
        state.groupBy("value", block.alias("block"))
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))
    )


def compaction(state: DataFrame, as_of: Column) -> DataFrame:
    """Every entry with `keep`: false for the expired ones that compaction deletes."""
    return state.withColumn("keep", ~expired(F.col("expiry"), as_of))


def write_state(state: DataFrame, path: str) -> None:
    """Write the state partitioned by expiry date, so that expired days can be skipped.

    Ranges of (day, key) give each day as many writers as its share of the rows asks for.
    """
    dated = state.withColumn("expiry_date", F.to_date("expiry"))
    dated.repartitionByRange("expiry_date", "key").write.mode("overwrite").partitionBy(
        "expiry_date"
    ).parquet(path)


def read_live(stored: DataFrame, as_of: Column) -> DataFrame:
    """Live entries of a stored state; the date bound prunes whole expired partitions."""
    return live_state(
        stored.where(F.col("expiry_date") >= F.to_date(as_of)), as_of
    ).drop("expiry_date")
