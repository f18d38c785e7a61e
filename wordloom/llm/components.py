"""Connected components of a distributed set of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.runtime import cut_lineage, forget


def _print(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


#: Links that one task joins; more take rounds of stars.
FEW_LINKS = 2_000_000


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars (a, b): b is the smallest id that a
    reaches within the partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["a", "b"])


def components(links: DataFrame, max_rounds: int = 60, few_links: int = FEW_LINKS) -> DataFrame:
    """(id, root) of every id that has a link; root is the smallest id.

    links has bigint columns a and b.  Each partition first turns its links
    into stars.  Up to few_links of those are joined in one task, whose memory
    that bounds.  More take rounds of alternating large and small stars: every
    id's neighbours are hung on the smallest of them until nothing changes,
    which takes a number of rounds that grows with the logarithm of the longest
    chain.  Minima are combined map-side, no list of neighbours is ever built,
    each round is stored and the one before it deleted.
    """
    links = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")
    )
    links = cut_lineage(links.mapInArrow(_trees, "a bigint, b bigint"))
    seen = _print(links)
    if seen[0] <= few_links:
        return _rooted(cut_lineage(links.coalesce(1).mapInArrow(_trees, "a bigint, b bigint")))
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(down, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            down.select("a", F.col("m").alias("b"))
        )
        before, links = links, cut_lineage(small.where(F.col("a") != F.col("b")).distinct())
        forget(before)
        now = _print(links)
        if now == seen:
            return _rooted(links)
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _rooted(links: DataFrame) -> DataFrame:
    roots = links.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
