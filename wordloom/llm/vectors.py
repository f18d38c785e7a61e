"""Usable word vectors, and batches of them in Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.runtime import cut_lineage

DIM = 64


def usable_vectors(df: DataFrame, dim: int = DIM) -> DataFrame:
    """(idx, w, unit): per idx its latest usable vector, scaled to length 1 and
    kept in single precision.

    Usable is a vector of dim finite components that are not all zero.  Ties
    in trained_at go to the later iteration, then to the larger w and unit.
    Null idx name no word and are left out; other columns are ignored.
    """
    v = F.col("m_vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = df.where(
        F.col("idx").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)
    )
    # Divisors go through array_repeat: named inside the lambda, they would be
    # computed again for every component.
    over = lambda v, by: F.zip_with(v, F.array_repeat(by, dim), lambda x, y: x / y)
    big = F.array_max(F.transform("m_vec", lambda x: F.abs(x)))
    scaled = usable.select("idx", "w", "trained_at", "iteration", over("m_vec", big).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    # Scaled before the shuffle, which then moves half the bytes.
    units = scaled.select("idx", F.struct("trained_at", "iteration", "w", over("vec", norm).cast("array<float>").alias("unit")).alias("row"))
    return units.groupBy("idx").agg(F.max("row").alias("row")).select("idx", "row.w", "row.unit")


def single(vectors: DataFrame) -> DataFrame:
    """(idx, unit) in single precision."""
    return vectors.select("idx", F.col("unit").cast("array<float>").alias("unit"))


def copies_collapsed(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (idx, unit) of exact copies, and (idx, rep) of all rows.

    A vector held by any share of the rows is one representative, so later
    steps never meet a group of copies.  Copies are told by two 64-bit hashes,
    so no vector is shuffled to find them.  vectors (idx, unit) should be
    stored, with idx unique; so is what comes back.
    """
    hashed = vectors.select("idx", F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(7), "unit").alias("h2"))
    least = hashed.groupBy("h1", "h2").agg(F.min("idx").alias("rep"))
    held = cut_lineage(hashed.join(least, ["h1", "h2"]).select("idx", "rep"))
    copies = held.where(F.col("idx") != F.col("rep")).select("idx")
    return cut_lineage(single(vectors).join(copies, "idx", "left_anti")), held


def bounded_sample(vectors: DataFrame, rows: int, total: int, seed: int = 11) -> np.ndarray:
    """At most about `rows` unit vectors, on the driver, to fit an index."""
    picked = vectors.select("unit")
    if total > rows:
        picked = picked.sample(False, rows / total, seed).limit(rows + rows // 4)
    got = picked.toArrow().column("unit").combine_chunks()
    return matrix(got).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column with lists of one length as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, DIM))


def packed(m: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as fixed-length binary values."""
    m = np.ascontiguousarray(m, np.float32)
    width = m.shape[1] * 4
    offsets = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def unpacked(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """The matrix that packed() made a column of."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.float32).reshape(len(column), dim) if data.flags.aligned else np.frombuffer(data.tobytes(), np.float32).reshape(len(column), dim)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work() on the rows of each key, a table at a time.

    One shuffle on the keys; groups follow each other in a sorted partition
    and cross over in whole Arrow batches.  The caller keeps groups small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def done() -> pa.RecordBatch | None:
            return work(pa.Table.from_batches(held)) if held else None

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
            cut = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, len(ids)]
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                now = tuple(ids[i].tolist())
                if now != name:
                    out = done()
                    if out is not None and out.num_rows:
                        yield out
                    held, name = [], now
                held.append(batch.slice(i, j - i))
        out = done()
        if out is not None and out.num_rows:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
