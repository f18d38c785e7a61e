"""Reproducible randomness and hashes as Column expressions.

Every random choice is a hash of its keys, so it is the same whatever the
partitioning, and another engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 32-bit FNV-1: offset basis and prime (fixed values).
FNV_BASIS = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295


def _digest(seed: int, keys: tuple[Column | str, ...]) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.md5(text.cast("binary"))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1) from the first 32 bits of the keys' digest."""
    return F.conv(uniform_digits(seed, *keys), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_digits(seed: int, *keys: Column | str) -> Column:
    """The eight hexadecimal digits that uniform() reads; their order is its own."""
    return F.substring(_digest(seed, keys), 1, 8)


def hash60(seed: int, *keys: Column | str) -> Column:
    """A bigint in [0, 2^60) from the keys' digest."""
    return F.conv(F.substring(_digest(seed, keys), 1, 15), 16, 10).cast("bigint")


def fnv1_32(hexed: Column) -> Column:
    """FNV-1 of the bytes given in hexadecimal, as a bigint."""
    at = F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int"))
    byte = lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    step = lambda a, i: ((a * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK_32))).bitwiseXOR(byte(i))
    return F.when(F.length(hexed) > 0, F.aggregate(at, F.lit(FNV_BASIS).cast("bigint"), step)).otherwise(F.lit(FNV_BASIS).cast("bigint"))
