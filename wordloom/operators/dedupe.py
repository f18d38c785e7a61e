"""Choosing the row that counts among deliveries of one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _base() -> Column:
    return F.lit(str(10**19)).cast("decimal(20,0)")


def version_rank(when: Column, value: Column) -> Column:
    """One number that orders (when, value) pairs: the later time first, then
    the larger value.  A null time is earlier than any other.

    A decimal lives in the fixed-width aggregation buffer, so max() over it
    stays in the hash aggregate; max() over a struct would sort all rows.
    """
    micros = F.coalesce(F.unix_micros(when), F.lit(-(10**18)))
    return (micros.cast("decimal(19,0)") * _base()).cast("decimal(38,0)") + value.cast("decimal(19,0)")


def version_value(rank: Column) -> Column:
    """The value that went into version_rank (values are not negative)."""
    return F.pmod(rank, _base()).cast("bigint")


def latest_count(df: DataFrame, keys: list[str], value: str, when: str) -> DataFrame:
    """Per key the value of its latest row: one shuffle, combined map-side.

    Rows whose value is null or not above 0 do not count.  Of rows with the
    same key and time the largest value counts, so the result does not depend
    on the order of arrival.  Null keys form a key of their own.
    """
    usable = df.where(F.col(value) > 0)
    ranked = usable.groupBy(*keys).agg(F.max(version_rank(F.col(when), F.col(value))).alias("__rank"))
    return ranked.select(*keys, version_value(F.col("__rank")).alias(value))


def latest_row(df: DataFrame, keys: list[str], when: str, columns: list[str]) -> DataFrame:
    """Per key the named columns of its latest row, whatever they hold.

    Ties in time go to the largest columns in the order given.
    """
    best = F.max(F.struct(F.col(when), *[F.col(c) for c in columns])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])
