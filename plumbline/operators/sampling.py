"""Row samples: the capped statistical sample and the micro-sample."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import hash32, hash_sampled

# A micro-sample is cut out of a thin random sample of this many times its size.
OVERSAMPLING = 8


def sample_fraction(total_rows: int, cap: int) -> float:
    """Share of rows to draw so that about `cap` rows come back; 1.0 for small tables."""
    return 1.0 if total_rows <= cap else cap / total_rows


def draw_sample(
    df: DataFrame,
    total_rows: int,
    cap: int,
    sampler: str = "random",
    key: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """About `cap` rows of the table, or the table itself if it has no more than that.

    The random sampler decides per row and so is untouched by skew. The hash sampler is
    repeatable across engines and needs a key that is unique per row.
    """
    fraction = sample_fraction(total_rows, cap)
    if fraction >= 1.0:
        return df
    if sampler == "hash":
        if key is None:
            raise ValueError("the hash sampler needs a unique row key")
        return df.where(hash_sampled(key, fraction))
    return df.sample(fraction=fraction, seed=seed)


def store_sample(sample: DataFrame) -> DataFrame:
    """Write a drawn sample once to the shared checkpoint folder and read it back.

    Several consumers then share one pass over the source, and a lost executor costs a re-read
    of the small sample. Only called on samples of bounded size. Without a configured folder
    the sample stays lazy; its seed makes every consumer draw the same rows.
    """
    spark = sample.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        return sample
    path = f"{folder.rstrip('/')}/samples/{uuid.uuid4().hex}"
    sample.write.parquet(path)
    return spark.read.schema(sample.schema).parquet(path)


def micro_sample(
    df: DataFrame,
    columns: list[str],
    rows: int,
    total_rows: int,
    key: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """`rows` rows of the given columns.

    A limit alone would send up to `rows` rows from every partition to one task, and they would
    be the first ones. Thinning by a fraction bounds what reaches it to about OVERSAMPLING * rows
    however many partitions there are; the rows with the smallest key hashes, or without a unique
    key the smallest random numbers, are taken from all of the table.
    """
    fraction = sample_fraction(total_rows, OVERSAMPLING * rows)
    if key is None:
        thin = df if fraction >= 1.0 else df.sample(fraction=fraction, seed=seed)
        drawn = thin.select(*columns, F.rand(seed).alias("_random"))
        return drawn.orderBy("_random").limit(rows).drop("_random")
    thin = df.where(hash_sampled(key, fraction))
    return (
        thin.select(*columns, hash32(key).alias("_hash"), key.alias("_key"))
        .orderBy("_hash", "_key")
        .limit(rows)
        .select(*columns)
    )
