"""Reproducible pseudo-random numbers: the md5 text of a seed and a key."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(key: Column, seed: int | str) -> Column:
    """32 hex digits that depend on the key and the seed only, not on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hex_to_long(text: Column, start: int = 1, digits: int = 8) -> Column:
    """Whole number from up to 15 hex digits."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def hash_bucket(key: Column, buckets: int, seed: int | str) -> Column:
    return F.pmod(hex_to_long(seeded_hash(key, seed), 1, 15), F.lit(buckets))
