"""Clusters of mutually similar vectors.

Density clustering of the unit vectors: a point is dense (a core point) when
min_points vectors, itself included, lie within the radius, and a cluster is
what chains of such points reach.  With two, the default, every point with a
neighbour is one.  The
vectors are reduced by principal components, space is divided into the cells
of a bounded number of pivots, and each cell also takes the points of its
overlapping margin.  Cells are clustered on their own with exact cosines,
and local clusters are merged through the dense points they share.

Cells settle most links but not all: in this many dimensions no margin short
of nearly all cells is sure to.  So every pair of points that the cells left in
different clusters is then compared, a broadcast block against all others,
and the result is exact at a cost that grows with the square of the points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.components import components
from wordloom.llm.vectors import DIM, bounded_sample, by_group, copies_collapsed, matrix, packed, unpacked
from wordloom.runtime import cut_lineage


@dataclass(frozen=True)
class CellParams:
    #: Vectors on the driver to fit axes and pivots.
    sample_rows: int = 16_384
    #: Reduced dimensions.
    reduced: int = 32
    #: Points wanted in a cell, and the most cells.
    cell_rows: int = 100
    max_cells: int = 4_096
    #: A point also belongs to cells whose pivot is at most this much farther
    #: than its nearest pivot.
    margin: float = 0.06
    #: Cells expected to be larger are worked on in pairs of blocks.
    block_rows: int = 2_048
    #: Points of a broadcast block of the exact comparison, and the most
    #: cosines a task holds at once.
    exact_rows: int = 32_768
    exact_cosines: int = 4_194_304


class Cells:
    """Axes, pivots and expected sizes, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, total: int, p: CellParams, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.p = p
        _, axes = np.linalg.eigh(sample.T @ sample)
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, : p.reduced], np.float32)
        low = sample @ self.axes
        k = int(min(p.max_cells, max(1, total // p.cell_rows), len(low)))
        pivots = low[rng.choice(len(low), k, replace=False)]
        for _ in range(4):
            near = self._near(low, pivots)
            size = np.bincount(near, minlength=k)
            sums = np.zeros_like(pivots)
            np.add.at(sums, near, low)
            pivots = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], pivots).astype(np.float32)
        self.pivots = pivots
        rows, cells = self._members(low)
        grown = np.bincount(cells, minlength=k) * (total / max(len(low), 1))
        self.blocks = np.maximum(1, np.ceil(grown / p.block_rows)).astype(np.int64)

    @staticmethod
    def _dist(low: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        sq = (low**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (low @ pivots.T)
        return np.sqrt(np.maximum(sq, 0))

    def _near(self, low: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return np.concatenate([self._dist(low[i : i + 4096], pivots).argmin(1) for i in range(0, len(low), 4096)])

    def _members(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._dist(low, self.pivots)
        return np.nonzero(d <= d.min(1)[:, None] + self.p.margin)

    def place(self, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row numbers, cells and block pairs that a batch of points goes to."""
        rows, cells = self._members(unit.astype(np.float32) @ self.axes)
        n = self.blocks[cells]
        # A point of block x meets every block y of its cell in the pair (min, max).
        rows, cells, n = (np.repeat(v, n) for v in (rows, cells, n))
        first = np.r_[True, (rows[1:] != rows[:-1]) | (cells[1:] != cells[:-1])] if len(rows) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0)) if len(rows) else rows
        other = np.arange(len(rows)) - begin
        own = ids[rows] * np.int64(2654435761) % 2**31 % n
        return rows, cells, np.minimum(own, other), np.maximum(own, other)


def _labels(similar: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row of a boolean matrix."""
    i, j = np.nonzero(similar)
    label = np.arange(len(similar))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def similarity_links(reps: DataFrame, min_cos: float, p: CellParams) -> DataFrame:
    """Links (a, b) whose components are the clusters of reps (idx, unit)."""
    spark = reps.sparkSession
    total = reps.count()
    schema = "cell bigint, x bigint, y bigint, idx bigint, unit binary"
    if not total:
        return spark.createDataFrame([], "a bigint, b bigint")
    cells = spark.sparkContext.broadcast(Cells(bounded_sample(reps, p.sample_rows, total), total, p))

    def place(batches):
        for batch in batches:
            ids = batch.column("idx").to_numpy(zero_copy_only=False)
            unit = matrix(batch.column("unit"))
            for i in range(0, len(ids), 2048):
                at, u = ids[i : i + 2048], unit[i : i + 2048]
                rows, cell, x, y = cells.value.place(at, u)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(x), pa.array(y), pa.array(at[rows]), packed(u[rows])],
                    names=["cell", "x", "y", "idx", "unit"],
                )

    def cluster(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("idx").to_numpy()
        unit = unpacked(rows.column("unit"), DIM)
        order = np.argsort(ids, kind="stable")
        ids, unit = ids[order], unit[order]
        label = _labels(unit @ unit.T >= np.float32(min_cos))
        moved = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])

    return by_group(reps.mapInArrow(place, schema), ["cell", "x", "y"], cluster, "a bigint, b bigint")


def _joined(links: Iterator[tuple[int, int]], parent: dict[int, int]) -> Iterator[tuple[int, int]]:
    """The links that join two trees of parent, which they change."""

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def _blocks_against(rows: DataFrame, held: DataFrame, work, schema: str, p: CellParams, once: bool = False) -> DataFrame:
    """work(block, batches) of a broadcast block of held against all rows, for
    each block; blocks have about exact_rows rows.  With `once`, rows and held
    are one table and a pair of rows is met in one order only, the table being
    read up to the block's own number."""
    context = rows.sparkSession.sparkContext
    blocks = max(1, -(-held.count() // p.exact_rows))
    number = F.pmod(F.xxhash64("idx"), F.lit(blocks))
    found = None
    for k in range(blocks):
        block = held.where(number == k).toArrow()
        shared = context.broadcast(block)
        part = rows.where(number <= k) if once else rows
        run = lambda batches, shared=shared: work(shared.value, batches)
        out = cut_lineage(part.mapInArrow(run, schema))
        found = out if found is None else found.unionByName(out)
        shared.destroy()
    return found


def links_between(parted: DataFrame, min_cos: float, p: CellParams) -> DataFrame:
    """Links (a, b) of parts that hold two similar points, of all pairs of
    parted (idx, part, unit), which is read once for each block of it."""

    def compare(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs, other = block.column("part").to_numpy(), matrix(block.column("unit"))
        step = max(1, p.exact_cosines // max(1, len(other)))
        parent: dict[int, int] = {}
        for batch in batches:
            own, unit = batch.column(1).to_numpy(), matrix(batch.column(2))
            for i in range(0, len(own), step):
                i, j = np.nonzero((unit[i : i + step] @ other.T) >= np.float32(min_cos)) + np.array([[i], [0]])
                apart = own[i] != theirs[j]
                pairs = np.unique(np.stack([own[i[apart]], theirs[j[apart]]], 1), axis=0)
                new = list(_joined(pairs.tolist(), parent))
                if new:
                    a, b = zip(*new)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = parted.select("idx", "part", "unit")
    return _blocks_against(rows, rows, compare, "a bigint, b bigint", p, once=True)


def core_points(reps: DataFrame, held: DataFrame, min_cos: float, min_points: int, p: CellParams) -> DataFrame:
    """Of reps (idx, unit), those with min_points vectors within the radius;
    held (idx, rep) says how many vectors each stands for."""
    weighed = cut_lineage(reps.join(held.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), F.col("idx") == F.col("rep")).select("idx", "n", "unit"))

    def count(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, other = block.column("n").to_numpy().astype(np.float64), matrix(block.column("unit"))
        step = max(1, p.exact_cosines // max(1, len(other)))
        for batch in batches:
            unit = matrix(batch.column(2))
            near = [((unit[i : i + step] @ other.T) >= np.float32(min_cos)) @ n for i in range(0, len(unit), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(near).astype(np.int64))], names=["idx", "near"])

    rows = weighed.select("idx", "n", "unit")
    near = _blocks_against(rows, rows, count, "idx bigint, near bigint", p)
    core = near.groupBy("idx").agg(F.sum("near").alias("near")).where(F.col("near") >= min_points).select("idx")
    return cut_lineage(reps.join(core, "idx", "left_semi"))


def nearest_core(others: DataFrame, core: DataFrame, min_cos: float, p: CellParams) -> DataFrame:
    """(idx, core) of others (idx, unit) with a core point within the radius:
    the most similar one, ties by the smaller idx."""

    def best(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, other = block.column("idx").to_numpy(), matrix(block.column("unit"))
        order = np.argsort(ids)
        ids, other = ids[order], other[order]
        step = max(1, p.exact_cosines // max(1, len(ids)))
        for batch in batches:
            own, unit = batch.column(0).to_numpy(), matrix(batch.column(1))
            for i in range(0, len(own) if len(ids) else 0, step):
                cos = unit[i : i + step] @ other.T
                top = cos.argmax(1)
                value = cos[np.arange(len(top)), top]
                keep = value >= np.float32(min_cos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[i : i + step][keep]), pa.array(ids[top[keep]]), pa.array(value[keep].astype(np.float64))], names=["idx", "core", "cos"]
                )

    found = _blocks_against(others.select("idx", "unit"), core.select("idx", "unit"), best, "idx bigint, core bigint, cos double", p)
    place = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("cos"), "core"))
    return found.withColumn("place", place).where("place = 1").select("idx", "core")


def cluster_members(vectors: DataFrame, min_cos: float, p: CellParams = CellParams(), min_points: int = 2) -> DataFrame:
    """(idx, cluster) of every row of vectors (idx, unit); the cluster is named
    by its smallest core idx, and a vector of no cluster is its own.

    Two vectors are neighbours if their cosine is at least min_cos; a core
    point has min_points vectors within that, itself and its copies included.
    Chains of core points make a cluster, and a point that is not dense joins
    the cluster of its most similar core neighbour.  Exact copies are one
    point.  All pairs are compared, those that share no cell by links_between,
    so no link is missed.  No vectors give no rows.  vectors should be a
    stored table with idx unique.
    """
    reps, held = copies_collapsed(vectors)
    core = reps if min_points <= 2 else core_points(reps, held, min_cos, min_points, p)
    parts = components(similarity_links(core, min_cos, p)).withColumnRenamed("id", "idx")
    parted = cut_lineage(core.join(parts, "idx", "left").select("idx", F.coalesce("root", "idx").alias("part"), "unit"))
    whole = components(links_between(parted, min_cos, p)).withColumnRenamed("id", "part")
    roots = parted.select(F.col("idx").alias("rep"), "part").join(whole, "part", "left")
    roots = roots.select("rep", F.coalesce("root", "part").alias("cluster"))
    if min_points > 2:
        roots = cut_lineage(roots)
        others = cut_lineage(reps.join(core.select("idx"), "idx", "left_anti"))
        near = nearest_core(others, core, min_cos, p).join(roots.withColumnRenamed("rep", "core"), "core")
        rest = others.select(F.col("idx").alias("rep")).join(near.select(F.col("idx").alias("rep"), "cluster"), "rep", "left")
        roots = roots.unionByName(rest.select("rep", F.coalesce("cluster", "rep").alias("cluster")))
    return held.join(roots, "rep").select("idx", "cluster")


#: Members of a cluster that one task pairs with all others of it.
PAIRED_ROWS = 1_024


def cluster_pairs(members: DataFrame) -> DataFrame:
    """(idx_a, idx_b), idx_a < idx_b: every pair of one cluster.

    A cluster of n has n * (n - 1) / 2 pairs, see cluster_members() for the
    short form.  Members are dealt over parts of about PAIRED_ROWS, and each
    part meets the whole cluster on its own, so a large one is spread over
    many tasks.
    """
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / PAIRED_ROWS).cast("int")
    dealt = members.join(size, "cluster").withColumn("parts", parts)
    a = dealt.select("cluster", F.col("idx").alias("idx_a"), F.pmod(F.xxhash64("idx"), "parts").cast("int").alias("part"))
    b = dealt.select("cluster", F.col("idx").alias("idx_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["cluster", "part"]).where(F.col("idx_a") < F.col("idx_b")).select("idx_a", "idx_b")


def described_clusters(vectors: DataFrame, members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, place, idx, w, typicality): of each cluster its size and
    the members nearest to its centre, ties by idx.

    Centres are summed map-side component by component; only the best members
    of each task reach the ranking of a cluster.
    """
    rows = vectors.join(members, "idx")
    parts = [F.sum(F.col("unit")[i]).alias(f"c{i}") for i in range(DIM)]
    centres = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *parts)
    centres = centres.select("cluster", "size", F.array(*[f"c{i}" for i in range(DIM)]).alias("centre"))
    dot = F.aggregate(F.zip_with("unit", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    near = rows.join(centres, "cluster").withColumn("typicality", F.round(F.try_divide(dot, norm), 9))
    ranked = near.withColumn(
        "place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("typicality"), "idx"))
    )
    return ranked.where(F.col("place") <= typical).select("cluster", "size", "place", "idx", "w", "typicality")
