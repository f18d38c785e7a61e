"""Filling containers of fixed capacity with items of varying length.

Large-item matching on the histogram of lengths: items above a third of the
capacity are matched greedily, at most two to a container, and the others are
put, longest first, where they leave the least room.  Items of one length are
interchangeable, so the plan is made for lengths, not items: it has at most
some rows per length, whatever the number of items, and a distributed rank
within the length tells each item its container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.runtime import cut_lineage, shuffle_partitions

#: Longest capacity whose histogram is planned on the driver.
MAX_CAPACITY = 1_000_000


@dataclass
class Group:
    """Containers filled alike: `count` of them, each with k items of a length."""

    fill: list[tuple[int, int]]
    count: int
    gap: int


def packed_lengths(lengths: dict[int, int], capacity: int) -> list[Group]:
    """Groups of containers that hold exactly the given numbers of lengths."""
    left = {s: n for s, n in lengths.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    groups: list[Group] = []
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, min(capacity - a, a) + 1) - 1
        while at >= 0 and left[large[at]] < (2 if large[at] == a else 1):
            if large[at] != a:
                del large[at]
            at -= 1
        if at < 0:
            groups.append(Group([(a, 1)], left[a], capacity - a))
            left[a] = 0
            continue
        b = large[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        groups.append(Group([(a, 2)] if a == b else [(a, 1), (b, 1)], n, capacity - a - b))
        left[a] -= n
        left[b] -= n

    by_gap: dict[int, list[Group]] = {}
    gaps: list[int] = []

    def keep(g: Group) -> None:
        if g.gap not in by_gap:
            by_gap[g.gap] = []
            insort(gaps, g.gap)
        by_gap[g.gap].append(g)

    for g in groups:
        keep(g)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        at = bisect_left(gaps, s)
        while n and at < len(gaps):
            gap = gaps[at]
            rest: list[Group] = []
            for g in by_gap[gap]:
                k = gap // s
                full = min(g.count, n // k)
                if full:
                    keep(Group([*g.fill, (s, k)], full, gap - k * s))
                    n -= full * k
                    g.count -= full
                if g.count and 0 < n < k:
                    keep(Group([*g.fill, (s, n)], 1, gap - n * s))
                    g.count -= 1
                    n = 0
                if g.count:
                    rest.append(g)
            if rest:
                by_gap[gap] = rest
            # Smaller gaps may have been added before this one.
            at = bisect_left(gaps, gap) + 1
            if not rest:
                del by_gap[gap]
                gaps.pop(at - 1)
                at -= 1
        if n:
            k = capacity // s
            if n >= k:
                keep(Group([(s, k)], n // k, capacity - k * s))
            if n % k:
                keep(Group([(s, n % k)], 1, capacity - (n % k) * s))
    return [g for gs in by_gap.values() for g in gs]


@dataclass
class Plan:
    """Where the items of (spec, length) go, by rank: sorted keys of
    (spec, length, first rank), with first container and items each."""

    keys: np.ndarray
    first: np.ndarray
    container: np.ndarray
    each: np.ndarray

    SHIFT = 1 << 40

    @classmethod
    def of(cls, lengths: dict[int, dict[int, int]], capacity: dict[int, int], code: dict[int, int]) -> Plan:
        rows = []
        for spec, hist in lengths.items():
            taken: dict[int, int] = {}
            container = 0
            for g in packed_lengths(hist, capacity[spec]):
                for s, k in g.fill:
                    rank = taken.get(s, 0)
                    rows.append((code[spec] * (MAX_CAPACITY + 1) + s, rank, container, k))
                    taken[s] = rank + g.count * k
                container += g.count
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 4)
        return cls(a[:, 0] * cls.SHIFT + a[:, 1], a[:, 1], a[:, 2], a[:, 3])

    def containers(self, code: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        key = (code * (MAX_CAPACITY + 1) + length) * self.SHIFT + rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        return self.container[at] + (rank - self.first[at]) // self.each[at]


def packed_items(items: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container, doc_id, piece, n_tokens): every item of items
    (doc_id, n_tokens) in a container of every spec (spec_id, capacity).

    Containers are numbered from 0 per spec.  An item longer than the capacity
    is cut into full pieces and a rest, numbered from 0; no other item is cut.
    Items without length or of length below 1 and specs without capacity are
    left out; a spec id that comes twice counts with its smallest capacity.
    specs is a list of settings, read by the driver; the driver also gets the
    histogram, which has at most as many rows as the capacities allow lengths.
    """
    spark = items.sparkSession
    items = cut_lineage(items.where(F.col("n_tokens") >= 1).select("doc_id", F.col("n_tokens").cast("bigint")))
    capacity = {
        r.spec_id: r.capacity
        for r in specs.where("spec_id is not null and capacity >= 1").groupBy("spec_id").agg(F.min("capacity").alias("capacity")).collect()
    }
    if any(c > MAX_CAPACITY for c in capacity.values()):
        raise ValueError(f"capacities above {MAX_CAPACITY} are not planned on the driver")
    out = "spec_id bigint, container bigint, doc_id bigint, piece bigint, n_tokens bigint"
    if not capacity:
        return spark.createDataFrame([], out)
    code = {spec: k for k, spec in enumerate(sorted(capacity))}
    settings = F.array(
        *[F.struct(F.lit(s).cast("bigint").alias("spec_id"), F.lit(k).cast("bigint").alias("code"), F.lit(capacity[s]).cast("bigint").alias("capacity")) for s, k in code.items()]
    )
    each = items.select("doc_id", "n_tokens", F.explode(settings).alias("s"))
    cap, n = F.col("s.capacity"), F.col("n_tokens")
    last = F.floor((n - 1) / cap).cast("bigint")
    pieces = each.select(
        "doc_id", F.col("s.spec_id").alias("spec_id"), F.col("s.code").alias("code"), cap.alias("capacity"), "n_tokens",
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"),
    ).withColumn("length", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")))
    pieces = pieces.withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shuffle_partitions(spark))).cast("int")
    ).select("spec_id", "code", "length", "bucket", "doc_id", "piece")

    # Ranks within a length: places within a bucket after the buckets before it.
    counts = pieces.groupBy("code", "length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("code", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("code", "length", "bucket").orderBy("doc_id", "piece"))
    ranked = pieces.join(counts, ["code", "length", "bucket"]).withColumn("rank", F.col("before") + place - 1)

    names = {k: spec for spec, k in code.items()}
    hist: dict[int, dict[int, int]] = {spec: {} for spec in capacity}
    for r in pieces.groupBy("code", "length").count().collect():
        hist[names[r.code]][r.length] = r["count"]
    plan = spark.sparkContext.broadcast(Plan.of(hist, capacity, code))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = [b.column(c).to_numpy(zero_copy_only=False) for c in ("code", "length", "rank")]
            yield pa.RecordBatch.from_arrays(
                [b.column("spec_id"), pa.array(plan.value.containers(*numbers)), b.column("doc_id"), b.column("piece"), b.column("length")],
                names=["spec_id", "container", "doc_id", "piece", "n_tokens"],
            )

    return ranked.select("spec_id", "code", "length", "rank", "doc_id", "piece").mapInArrow(fill, out)
