"""Hash-based selection and value digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 2**32


def hash32(key: Column) -> Column:
    """First 32 bits of the MD5 of a key, as a non-negative long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def hash_sampled(key: Column, fraction: float) -> Column:
    """True for a repeatable share of rows, chosen by the hash of a unique row key."""
    if fraction >= 1.0:
        return F.lit(True)
    return hash32(key) < F.lit(int(fraction * HASH_SPACE))


def trailing_zero_bits(h: Column) -> Column:
    """Number of zero bits at the low end of a long; 64 for zero."""
    return F.bit_count(h.bitwiseAND(-h) - 1)


def bounded_key(value: Column) -> Column:
    """The value itself up to 64 characters, a marked SHA-256 of the whole text beyond that.

    Keeps grouping keys short when whole documents are compared. The two forms differ in
    length, so a short value can never equal a digest.
    """
    return F.when(
        F.length(value) <= 64, value
    ).otherwise(F.concat(F.lit("#"), F.sha2(value, 256)))
