"""Most frequent values of a column with too many distinct ones to keep.

Exact spillable aggregation: the group-by combines map-side, its hash
partitions spill to disk when they outgrow memory, each partition keeps its
own top k, and one ordered limit merges those lists.  No task and no driver
holds more than its hash partition or k rows, and the sums are exact, so the
promised approximation has an error of zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_sums(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Sum of weight per value; null values and null weights do not count."""
    return (
        df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
        .groupBy(value)
        .agg(F.sum(weight).alias(weight))
    )


def most_frequent(df: DataFrame, value: str, weight: str, k: int) -> DataFrame:
    """The k values with the largest sums, ties by the value's bytes.

    An empty table gives no row; fewer than k distinct values give them all.
    """
    return value_sums(df, value, weight).orderBy(F.desc(weight), F.asc(value)).limit(k)


def values_above_share(df: DataFrame, value: str, weight: str, per: int) -> DataFrame:
    """Values whose sum is at least 1/per of the sum over all values.

    At most `per` values can reach that share, so they all are among the
    most_frequent with k = per.
    """
    total = value_sums(df, value, weight).agg(F.sum(weight))
    return most_frequent(df, value, weight, per).where(F.col(weight) * per >= total.scalar())
