"""Randomness that is a function of the row and a seed.

Keys are MD5 digests, so a sample does not depend on partitioning or retries, and SQL engines
other than Spark give the same one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *parts: Column) -> Column:
    """A string to sort by for a random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def number(seed: int | str, *parts: Column) -> Column:
    """A whole number from 0 to 2^32 - 1."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *parts: Column) -> Column:
    """A number in (0, 1)."""
    return (number(seed, *parts) + 0.5) / float(1 << 32)


def pick(options: Column, n: Column) -> Column:
    """The element of a non-empty array that number ``n`` chooses; null for an empty one."""
    return F.when(F.size(options) > 0, F.get(options, F.pmod(n, F.greatest(F.size(options), F.lit(1))).cast("int")))


def shuffled(options: Column, seed: int | str, *parts: Column) -> Column:
    """The array in a seeded order; equal elements keep their number."""
    keyed = F.transform(options, lambda x, i: F.struct(order_key(seed, *parts, i).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])
