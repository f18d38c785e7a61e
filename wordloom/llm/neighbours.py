"""The k most similar vectors of every vector.

A forest of random-projection trees is fitted on a bounded sample and every
vector is filed in one leaf of each tree.  A search pops the most promising
branch from one priority queue shared by all trees until it has visited
enough leaves; the vectors in those leaves are compared exactly, and what a
search meets learns of it too.

Leaves are large and visits few, as each visit moves the vector once.  Trees
find what is close; a vector without close ones has neighbours in no
particular direction, so such searches can be repeated against all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.vectors import DIM, bounded_sample, by_group, copies_collapsed, matrix, packed, unpacked
from wordloom.runtime import cut_lineage


@dataclass(frozen=True)
class ForestParams:
    trees: int = 4
    #: Leaves visited by a search, in all trees together.
    visits: int = 6
    #: Vectors on the driver to fit the splits of a tree.
    sample_rows: int = 65_536
    #: Vectors wanted in a leaf, and sampled vectors it takes at least; beyond
    #: leaf_rows / leaf_least * sample_rows vectors the leaves grow with them.
    leaf_rows: int = 12_288
    leaf_least: int = 8
    #: Leaves expected to be larger are worked on in blocks.
    block_rows: int = 32_768
    #: Cosines a task holds at once, and searches of a broadcast block of the
    #: repeated search.
    cosines: int = 4_194_304
    exact_rows: int = 32_768
    #: A search that found k vectors of at least this cosine is settled.
    settled: float = 0.75


class Forest:
    """All trees in one set of arrays: node -> normal, offset, children, leaf."""

    def __init__(self, sample: np.ndarray, total: int, p: ForestParams, seed: int = 3) -> None:
        self.p = p
        self.rng = np.random.default_rng(seed)
        self.normal: list[np.ndarray] = []
        self.offset: list[float] = []
        self.child: list[list[int]] = []
        self.leaf: list[int] = []
        self.size: list[int] = []
        self.leaf_sample = max(p.leaf_least, round(p.leaf_rows * len(sample) / max(total, 1)))
        self.roots = [self._grow(sample) for _ in range(p.trees)]
        self.normal = np.array(self.normal, np.float32)
        self.offset = np.array(self.offset, np.float32)
        self.child = np.array(self.child, np.int64)
        self.leaf = np.array(self.leaf, np.int64)
        grown = np.array(self.size) * (total / max(len(sample), 1))
        self.blocks = np.maximum(1, np.ceil(grown / p.block_rows)).astype(np.int64)
        del self.rng

    def _grow(self, rows: np.ndarray) -> int:
        """Splits until the leaves are small; returns the root's number."""
        root = len(self.leaf)
        todo = [(rows, -1, 0)]
        while todo:
            part, parent, side = todo.pop()
            at = len(self.leaf)
            if parent >= 0:
                self.child[parent][side] = at
            cut = self._cut(part) if len(part) > self.leaf_sample else None
            self.child.append([-1, -1])
            if cut is None:
                self.normal.append(np.zeros(part.shape[1], np.float32))
                self.offset.append(0.0)
                self.leaf.append(len(self.size))
                self.size.append(len(part))
                continue
            normal, offset, right = cut
            self.normal.append(normal)
            self.offset.append(offset)
            self.leaf.append(-1)
            todo += [(part[~right], at, 0), (part[right], at, 1)]
        return root

    def _cut(self, part: np.ndarray):
        """A plane between two random members, moved towards the means of
        either side; None where the members do not separate."""
        for _ in range(3):
            i, j = self.rng.choice(len(part), 2, replace=False)
            a, b = part[i], part[j]
            for _ in range(4):
                right = part @ (a - b) > (a @ a - b @ b) / 2
                if right.all() or not right.any():
                    break
                a, b = part[right].mean(0), part[~right].mean(0)
            length = np.linalg.norm(a - b)
            if not length:
                continue
            normal = ((a - b) / length).astype(np.float32)
            offset = float(normal @ (a + b) / 2)
            right = part @ normal > offset
            if right.any() and not right.all():
                return normal, offset, right
        return None

    def visits(self, unit: np.ndarray) -> np.ndarray:
        """Leaves that the search for each row visits.  All roots have the
        same first priority, so the first `trees` visits are the home leaves."""
        n, trees, visits = len(unit), self.p.trees, self.p.visits
        depth = 4 + int(np.ceil(2 * np.log2(max(2, len(self.size)))))
        room = trees + visits * depth
        queue = np.full((n, room), -np.inf, np.float32)
        waiting = np.zeros((n, room), np.int64)
        used = np.full(n, trees)
        queue[:, :trees] = np.inf
        waiting[:, :trees] = self.roots
        every = np.arange(n)
        out = np.full((n, visits), -1, np.int64)
        for v in range(visits):
            best = queue.argmax(1)
            priority, node = queue[every, best], waiting[every, best]
            queue[every, best] = -np.inf
            node = np.where(np.isneginf(priority), -1, node)
            while True:
                inner = np.flatnonzero((node >= 0) & (self.leaf[node] < 0))
                if not len(inner):
                    break
                x = node[inner]
                gap = np.einsum("ij,ij->i", unit[inner], self.normal[x]) - self.offset[x]
                right = (gap > 0).astype(np.int64)
                slot = used[inner]
                free = slot < room
                queue[inner[free], slot[free]] = np.minimum(priority[inner], -np.abs(gap))[free]
                waiting[inner[free], slot[free]] = self.child[x, 1 - right][free]
                used[inner] += free
                node[inner] = self.child[x, right]
            out[:, v] = np.where(node >= 0, self.leaf[node], -1)
        return out


#: Single precision may order cosines otherwise than double within this many.
SPARE = 4


class _Best:
    """The `size` largest cosines met so far of each of n rows."""

    def __init__(self, n: int, size: int, floor: np.ndarray | float) -> None:
        self.value = np.full((n, size), -np.inf, np.float32)
        self.other = np.full((n, size), -1, np.int64)
        self.floor = np.broadcast_to(np.float32(floor), n).copy()
        self.least = self.floor.copy()

    def add(self, row: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        size = self.value.shape[1]
        touched = np.unique(row)
        every = np.repeat(touched, size)
        r = np.r_[every, row]
        o = np.r_[self.other[touched].ravel(), other]
        v = np.r_[self.value[touched].ravel(), value]
        order = np.lexsort((o, -v, r))
        r, o, v = r[order], o[order], v[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < size
        self.value[touched] = v[keep].reshape(-1, size)
        self.other[touched] = o[keep].reshape(-1, size)
        self.least[touched] = np.maximum(self.value[touched, -1], self.floor[touched])

    def meet(self, cos: np.ndarray, first: int) -> None:
        """cos[i, j] is the cosine of row i and the vector number first + j."""
        size = self.value.shape[1]
        if np.isneginf(self.least).any() and cos.shape[1] > size:
            # Nothing to beat yet: the best of this stretch.
            col = np.argpartition(-cos, size - 1, axis=1)[:, :size]
            row = np.repeat(np.arange(len(cos)), size)
            col = col.ravel()
            better = cos[row, col] > self.least[row]
            row, col = row[better], col[better]
        else:
            row, col = np.nonzero(cos > self.least[:, None])
        if len(row):
            self.add(row, first + col, cos[row, col])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.other >= 0)
        return row, self.other[row, place]


def _double(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows; unlike a matrix product, of the same value
    wherever and in whichever order two rows meet."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d].astype(np.float64) * b[:, d]
    return out


def _pair_batch(who: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of each who."""
    order = np.lexsort((other, -cos, who))
    who, other, cos = who[order], other[order], cos[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return pa.RecordBatch.from_arrays(
        [pa.array(who[keep], pa.int64()), pa.array(other[keep], pa.int64()), pa.array(cos[keep], pa.float64())], names=["idx", "other", "cos"]
    )


PAIR = "idx bigint, other bigint, cos double"


def _rep_neighbours(reps: DataFrame, k: int, min_cos: float, p: ForestParams) -> DataFrame:
    """(idx, other, cos): others of each representative, the k best of each
    leaf or more."""
    spark = reps.sparkSession
    total = reps.count()
    if not total:
        return spark.createDataFrame([], PAIR)
    forest = spark.sparkContext.broadcast(Forest(bounded_sample(reps, p.sample_rows, total), total, p))

    def file(batches):
        f = forest.value
        for batch in batches:
            all_ids = batch.column("idx").to_numpy(zero_copy_only=False)
            all_unit = matrix(batch.column("unit"))
            for i in range(0, len(all_ids), 1024):
                ids, unit = all_ids[i : i + 1024], all_unit[i : i + 1024]
                leaf = f.visits(unit)
                rows, at = np.nonzero(leaf >= 0)
                leaf = leaf[rows, at]
                filed = at < f.p.trees  # home leaves hold the vector, others only search
                n = f.blocks[leaf]
                own = ids[rows] * np.int64(2654435761) % 2**31 % n
                # Block (q, x) compares searches of block q with vectors of block x.
                out_rows, out_leaf, out_q, out_x, out_role = [], [], [], [], []
                for step in range(int(n.max(initial=1))):
                    more = step < n
                    for role in (0, 1):
                        m = more & (filed | (role == 0))
                        out_rows.append(rows[m])
                        out_leaf.append(leaf[m])
                        out_q.append(own[m] if role == 0 else np.full(m.sum(), step))
                        out_x.append(np.full(m.sum(), step) if role == 0 else own[m])
                        out_role.append(np.full(m.sum(), role))
                r, lf, q, x, role = (np.concatenate(v) for v in (out_rows, out_leaf, out_q, out_x, out_role))
                # A vector that searches and is filed in one block is one row with role 2.
                key = np.lexsort((role, x, q, lf, r))
                r, lf, q, x, role = r[key], lf[key], q[key], x[key], role[key]
                twice = np.r_[(r[1:] == r[:-1]) & (lf[1:] == lf[:-1]) & (q[1:] == q[:-1]) & (x[1:] == x[:-1]), False]
                role = np.where(twice, 2, role)
                keep = ~np.r_[False, twice[:-1]]
                r, lf, q, x, role = r[keep], lf[keep], q[keep], x[keep], role[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lf), pa.array(q), pa.array(x), pa.array(role.astype(np.int64)), pa.array(ids[r]), packed(unit[r])],
                    names=["leaf", "q", "x", "role", "idx", "unit"],
                )

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        role = rows.column("role").to_numpy()
        ids = rows.column("idx").to_numpy()
        unit = unpacked(rows.column("unit"), DIM)
        # Those that only search come first, so theirs are the first rows.
        seek, held = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        seek = seek[np.argsort(role[seek], kind="stable")]
        if not len(seek) or not len(held):
            return None
        a, b = ids[seek], ids[held]
        unit_a, unit_b = unit[seek], unit[held]
        guests = int((role[seek] == 0).sum())
        size, floor = k + SPARE, min_cos - 1e-6 if min_cos > -1 else -np.inf
        found = _Best(len(a), size, floor)
        back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(64, p.cosines // len(a))
        for i in range(0, len(b), step):
            s = unit_a @ unit_b[i : i + step].T
            s[a[:, None] == b[None, i : i + step]] = -np.inf
            found.meet(s, i)
            if guests:
                # What a guest meets has met it: the way back is not searched.
                met = _Best(s.shape[1], size, floor)
                met.meet(np.ascontiguousarray(s[:guests].T), 0)
                row, col = np.nonzero(met.other >= 0)
                back.append((i + row, met.other[row, col], met.value[row, col]))
        row, col = found.pairs()
        who, other = [a[row]], [b[col]]
        cos = [_double(unit_a[row], unit_b[col])]
        if back:
            row, col, value = (np.concatenate(v) for v in zip(*back))
            # Only what is nearer than what the vector's own search met here.
            order = np.argsort(a, kind="stable")
            at = np.minimum(np.searchsorted(a[order], b[row]), len(a) - 1)
            own = np.where(a[order[at]] == b[row], found.value[order[at], k - 1], -np.inf)
            row, col = row[value >= own - 1e-6], col[value >= own - 1e-6]
            who.append(b[row])
            other.append(a[col])
            cos.append(_double(unit_b[row], unit_a[col]))
        return _pair_batch(np.concatenate(who), np.concatenate(other), np.concatenate(cos), k)

    filed = reps.mapInArrow(file, "leaf bigint, q bigint, x bigint, role bigint, idx bigint, unit binary")
    found = by_group(filed, ["leaf", "q", "x"], compare, PAIR)
    return _best(found.where(F.col("cos") >= min_cos).groupBy("idx", "other").agg(F.max("cos").alias("cos")), k)


def _searched_again(reps: DataFrame, near: DataFrame, k: int, min_cos: float, p: ForestParams) -> DataFrame:
    """(idx, other, cos) of searches that near leaves unsettled, against all
    rows: each has the k nearest or more.

    Searches are broadcast in blocks of exact_rows; a task reports at most k
    for each, of what is nearer than the k-th that near has.
    """
    context = reps.sparkSession.sparkContext
    close = F.count(F.when(F.col("cos") >= p.settled, 1)).alias("close")
    have = near.groupBy("idx").agg(close, F.count(F.lit(1)).alias("n"), F.min("cos").alias("least"))
    floor = F.when(F.col("n") >= k, F.col("least")).otherwise(min_cos)
    asked = reps.join(have, "idx", "left").where(F.coalesce("close", F.lit(0)) < k)
    asked = cut_lineage(asked.select("idx", "unit", F.coalesce(floor, F.lit(float(min_cos))).alias("floor")))
    blocks = -(-asked.count() // p.exact_rows)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("idx"), F.lit(max(1, blocks))))

    def search(shared):
        def run(batches):
            ids, unit, floor = shared.value
            found = _Best(len(ids), k + SPARE, floor)
            own, mine = [], []
            step, seen = max(64, p.cosines // max(1, len(ids))), 0
            for batch in batches:
                other, theirs = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                own.append(other)
                mine.append(theirs)
                for i in range(0, len(other), step):
                    s = unit @ theirs[i : i + step].T
                    s[ids[:, None] == other[None, i : i + step]] = -np.inf
                    found.meet(s, seen + i)
                seen += len(other)
            row, col = found.pairs()
            if len(row):
                at, other = np.unique(col), np.concatenate(own)
                theirs = np.concatenate(mine)[at][np.searchsorted(at, col)]
                yield _pair_batch(ids[row], other[col], _double(unit[row], theirs), k)

        return run

    found = near.where("false")
    for b in range(blocks):
        held = asked.where(F.col("block") == b).select("idx", "unit", "floor").toArrow()
        floor = np.where(held.column("floor").to_numpy() <= -1, -np.inf, held.column("floor").to_numpy() - 1e-6).astype(np.float32)
        shared = context.broadcast((held.column("idx").to_numpy(), matrix(held.column("unit")), floor))
        found = found.unionByName(cut_lineage(reps.select("idx", "unit").mapInArrow(search(shared), PAIR)))
        shared.destroy()
    return found.where(F.col("cos") >= min_cos)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("cos"), "other"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def nearest_vectors(vectors: DataFrame, k: int, min_cos: float = -1.0, p: ForestParams = ForestParams(), exact: bool = False) -> DataFrame:
    """(idx, other, cos): for each row of vectors (idx, unit) up to k others with
    the largest cosines of at least min_cos, ties by the smaller idx.

    Exact copies are searched once: a member of a group of copies has its
    fellow members as neighbours at cosine 1, then the neighbours of its
    representative, each standing for its first members.  Recall is below 1
    by the forest's design; README gives the measured value.  With `exact`,
    searches that found fewer than k vectors of cosine p.settled are repeated
    against all rows, at a cost of their number times the rows.
    vectors should be a stored table with idx unique.
    """
    reps, held = copies_collapsed(vectors)
    place = F.row_number().over(Window.partitionBy("rep").orderBy("idx"))
    first = held.withColumn("place", place).where(F.col("place") <= k + 1).select("rep", F.col("idx").alias("other"))
    near = _rep_neighbours(reps, k, min_cos, p)
    if exact:
        near = cut_lineage(near)
        more = near.unionByName(_searched_again(reps, near, k, min_cos, p))
        near = _best(more.groupBy("idx", "other").agg(F.max("cos").alias("cos")), k)
    near = near.select("idx", F.col("other").alias("rep"), "cos")
    from_near = (
        near.join(first, "rep")
        .select(F.col("idx").alias("rep"), "other", "cos")
        .join(held, "rep")
        .select("idx", "other", "cos")
    )
    crowd = held.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("rep")
    from_copies = (
        held.join(crowd, "rep", "left_semi")
        .join(first, "rep")
        .where(F.col("idx") != F.col("other"))
        .select("idx", "other", F.lit(1.0).alias("cos"))
    )
    return _best(from_near.unionByName(from_copies), k)
