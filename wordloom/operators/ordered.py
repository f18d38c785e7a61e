"""Global ranks and running totals without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.runtime import cut_lineage, shuffle_partitions

_ROWS = 1 << 33


def ranked(df: DataFrame, order: list[Column], rank: str, total: str | None = None, running: str = "running") -> DataFrame:
    """df with its rank (from 0) in the given order and, for a column `total`,
    its sum up to and including the row.

    Rows are range-partitioned and sorted; a partition adds what the
    partitions before it hold.  Only one row per partition is ever brought
    together.  The order has to be total for the result to be unique.
    """
    return _counted(df.repartitionByRange(*order).sortWithinPartitions(*order), rank, total, running)


def ranked_by_share(df: DataFrame, share: Column, order: list[Column], rank: str) -> DataFrame:
    """df with its rank (from 0) by share, then by the given order.

    share is spread evenly over [0, 1) and so names the partition itself; df is
    not computed a first time to find bounds.  Neither share nor bounds are kept.
    """
    parts = 4 * shuffle_partitions(df.sparkSession)
    spread = df.withColumn("__share", share).repartitionById(parts, F.floor(F.col("__share") * parts).cast("int"))
    return _counted(spread.sortWithinPartitions("__share", *order).drop("__share"), rank)


def _counted(placed: DataFrame, rank: str, total: str | None = None, running: str = "running") -> DataFrame:
    """Ranks of rows that lie in order over the partitions and in each."""
    placed = cut_lineage(placed.withColumn("__at", F.monotonically_increasing_id()))
    part = F.floor(F.col("__at") / F.lit(_ROWS)).cast("bigint")
    placed = placed.withColumn("__part", part)
    sums = [F.count(F.lit(1)).alias("__n")] + ([F.sum(total).alias("__sum")] if total else [])
    parts = placed.groupBy("__part").agg(*sums)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")]
    if total:
        held.append(F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__below"))
    parts = parts.select(F.col("__part"), *held)
    out = placed.join(F.broadcast(parts), "__part").withColumn(rank, F.col("__before") + F.col("__at") % F.lit(_ROWS))
    if total:
        upto = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(running, F.col("__below") + F.sum(total).over(upto))
    return out.drop("__at", "__part", "__before", "__below")
