"""Factorising the association matrix by stochastic gradient descent.

Words and contexts are dealt into as many blocks as there are workers.  An
epoch is a round of strata: in each, worker i owns word block i and one block
of contexts, passes the examples of the two in random order and in batches,
and hands both blocks back, so no two workers ever change one row.  Over the
strata, whose order is drawn for each epoch, every word block meets every
context block.  With one worker this is the sequential algorithm.

Parameters are a table with a row per vector; a task holds its two blocks and
nothing else, so a model may be as large as all workers' memory together.
Hashed subwords are shared by words of all blocks: each worker gets those of
its words, and what the workers make of one in a stratum is averaged by how
often each used it.
"""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.hashing import uniform_digits
from wordloom.operators.vectors import grouped_sum, initial_vectors
from wordloom.params import Params
from wordloom.runtime import cut_lineage, forget

log = logging.getLogger("wordloom.train")

#: Kinds of parameters: rows of words, of hashed subwords, of contexts.
WORD, BUCKET, CONTEXT = 0, 1, 2
#: What a task gets beside them: which bucket rows a word has, and examples.
MEMBER, EXAMPLE = 3, 4


def learning_rate(progress: float, alpha: float) -> float:
    """Falls linearly with progress in [0, 1], to a floor of alpha / 10000."""
    return max(alpha * (1 - progress), 1e-4 * alpha)


def learning_rate_column(progress, alpha: float):
    return F.greatest(F.lit(float(alpha)) * (1 - progress), F.lit(1e-4 * alpha))


@dataclass
class Subwords:
    """Rows of each word in one flat array: those of word i are
    rows[begin[i]:begin[i + 1]]."""

    begin: np.ndarray
    rows: np.ndarray

    @classmethod
    def own_rows(cls, n: int) -> Subwords:
        return cls(np.arange(n + 1, dtype=np.int64), np.arange(n, dtype=np.int64))

    @classmethod
    def of(cls, n: int, word: np.ndarray, row: np.ndarray) -> Subwords:
        """n words with a row of their own each, row i of word i, and others."""
        word, row = np.r_[np.arange(n), word], np.r_[np.arange(n), row]
        order = np.argsort(word, kind="stable")
        return cls(np.r_[0, np.cumsum(np.bincount(word, minlength=n))].astype(np.int64), row[order].astype(np.int64))

    def flat(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a batch of words, whose they are, and how many each has."""
        n = self.begin[words + 1] - self.begin[words]
        owner = np.repeat(np.arange(len(words)), n)
        first = np.repeat(self.begin[words] - np.r_[0, np.cumsum(n)[:-1]], n)
        return self.rows[first + np.arange(len(owner))], owner, n


def _add_rows(m: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """m[rows] += change, where rows repeat."""
    order = np.argsort(rows, kind="stable")
    held = rows[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    m[held[first]] += np.add.reduceat(change[order], first, axis=0)


def batch_step(m: np.ndarray, c: np.ndarray, sub: Subwords, w: np.ndarray, k: np.ndarray, y: np.ndarray, rate: float) -> float:
    """One step on examples (w, k, y) in place; returns the sum of losses.

    A word's vector is the mean of its rows; the loss is half the squared
    error.  Updates of a batch are computed from its start and added up.
    """
    rows, owner, n = sub.flat(w)
    plain = len(rows) == len(w)
    z = m[rows] if plain else np.add.reduceat(m[rows], np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None]
    old = c[k]
    g = np.einsum("ij,ij->i", z, old) - y
    step = (rate * g)[:, None]
    _add_rows(c, k, -step * z)
    change = -step * old
    _add_rows(m, rows, change if plain else (change / n[:, None])[owner])
    return float(0.5 * (g * g).sum())


def plain_steps(m: np.ndarray, c: np.ndarray, w: np.ndarray, k: np.ndarray, y: np.ndarray, batch: int, rates: list[float]) -> float:
    """batch_step() on batch after batch, where word i has row i alone.

    Both matrices are contiguous.  The places of all components are made for
    many batches at once, and added to one by one in a flat array: for short
    batches the number of calls decides."""
    dim = m.shape[1]
    flat_m, flat_c, at = m.reshape(-1), c.reshape(-1), np.arange(dim)
    piece = max(1, 4096 // batch) * batch
    errors = np.empty(len(w))
    for begin in range(0, len(w), piece):
        end = min(begin + piece, len(w))
        in_m, in_c = ((x[begin:end, None] * dim + at).reshape(-1) for x in (w, k))
        for i in range(begin, end, batch):
            j = min(i + batch, end)
            z, old = m.take(w[i:j], 0), c.take(k[i:j], 0)
            g = np.einsum("ij,ij->i", z, old)
            g -= y[i:j]
            errors[i:j] = g
            g *= -rates[i // batch]
            step = g[:, None]
            z *= step
            old *= step
            part = slice((i - begin) * dim, (j - begin) * dim)
            np.add.at(flat_c, in_c[part], z.reshape(-1))
            np.add.at(flat_m, in_m[part], old.reshape(-1))
    return float(0.5 * (errors @ errors))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _vectors(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


_OUT = "kind int, row bigint, weight double, v array<double>, loss double, n bigint"


class _Task:
    """The blocks of one worker in a stratum."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.rows: dict[int, list[np.ndarray]] = {k: [] for k in (WORD, BUCKET, CONTEXT)}
        self.vectors: dict[int, list[np.ndarray]] = {k: [] for k in (WORD, BUCKET, CONTEXT)}
        self.members: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, batch: pa.RecordBatch) -> None:
        """Rows of any kind but examples, in the order of kind and row."""
        kind = batch.column("kind").to_numpy()
        row = batch.column("row").to_numpy()
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            part = batch.slice(at[0], len(at))
            if k == MEMBER:
                self.members.append((row[at], part.column("other").to_numpy()))
            else:
                self.rows[k].append(row[at])
                self.vectors[k].append(_matrix(part.column("v"), self.dim))

    def ready(self) -> None:
        none, empty = np.zeros(0, np.int64), np.zeros((0, self.dim))
        self.ids = {k: np.concatenate(v) if v else none for k, v in self.rows.items()}
        held = {k: np.concatenate(v) if v else empty for k, v in self.vectors.items()}
        self.m = np.concatenate([held[WORD], held[BUCKET]])
        self.c = held[CONTEXT].copy()
        n = len(self.ids[WORD])
        word, bucket = (np.concatenate(x) for x in zip(*self.members)) if self.members else (none, none)
        word, bucket = np.searchsorted(self.ids[WORD], word), n + np.searchsorted(self.ids[BUCKET], bucket)
        self.sub = Subwords.of(n, word, bucket) if len(word) else Subwords.own_rows(n)
        self.used = np.zeros(len(self.m))

    def steps(self, w: np.ndarray, k: np.ndarray, y: np.ndarray, batch: int, rates: list[float]) -> float:
        w, k = np.searchsorted(self.ids[WORD], w), np.searchsorted(self.ids[CONTEXT], k)
        if not self.members:
            return plain_steps(self.m, self.c, w, k, y, batch, rates)
        loss = 0.0
        for i, rate in zip(range(0, len(w), batch), rates):
            part = slice(i, i + batch)
            if len(self.ids[BUCKET]):
                np.add.at(self.used, self.sub.flat(w[part])[0], 1)
            loss += batch_step(self.m, self.c, self.sub, w[part], k[part], y[part], rate)
        return loss

    def result(self, loss: float, n: int) -> Iterator[pa.RecordBatch]:
        words = len(self.ids[WORD])
        # A bucket row that was not used here weighs next to nothing.
        parts = ((WORD, self.m[:words], None), (BUCKET, self.m[words:], self.used[words:] + 1e-9), (CONTEXT, self.c, None))
        names = ["kind", "row", "weight", "v", "loss", "n"]
        for kind, m, weight in parts:
            for i in range(0, len(m), 4096):
                v, size = m[i : i + 4096], len(m[i : i + 4096])
                w = np.ones(size) if weight is None else weight[i : i + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, kind, np.int32)), pa.array(self.ids[kind][i : i + 4096]), pa.array(w), _vectors(v), pa.nulls(size, pa.float64()), pa.nulls(size, pa.int64())],
                    names=names,
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.list_(pa.float64())), pa.array([loss]), pa.array([n], pa.int64())],
            names=names,
        )


def _stratum(parameters: DataFrame, members: DataFrame | None, examples: DataFrame, p: Params, blocks: int, it: int, s: int, turn: int, share: int) -> DataFrame:
    """Stratum s, the turn-th of its epoch: parameters (kind, row, v) as they
    come out of it, with a row of kind -1 per task that has its loss and number
    of examples."""
    mod = lambda x: F.pmod(x, F.lit(blocks)).cast("int")
    null = lambda kind: F.lit(None).cast(kind)
    row, kind = F.col("row"), F.col("kind")
    # Many null arrays cost several times as much on their way to Python.
    no_vector = F.array().cast("array<double>")
    one = F.lit(1).cast("bigint")

    def given(df: DataFrame, task, what) -> DataFrame:
        return df.select(task.alias("task"), what.alias("kind"), "row", null("bigint").alias("other"), one.alias("first"), one.alias("last"), null("double").alias("y"), "v")

    own = F.when(kind == WORD, mod(row)).otherwise(mod(row - s))
    parts = given(parameters.where(kind != BUCKET), own, kind)
    if members is not None:
        asked = members.select(mod("w_idx").alias("task"), F.col("row").alias("wanted")).distinct()
        shared = parameters.where(kind == BUCKET).join(asked, row == F.col("wanted"))
        parts = parts.unionByName(given(shared, F.col("task"), kind)).unionByName(
            members.select(
                mod("w_idx").alias("task"), F.lit(MEMBER).alias("kind"), F.col("w_idx").alias("row"), F.col("row").alias("other"),
                one.alias("first"), one.alias("last"), null("double").alias("y"), no_vector.alias("v"),
            )
        )
    first, last = (one, F.col("sampled")) if "sampled" in examples.columns else (F.col("copy"), F.col("copy"))
    lines = examples.where(mod(F.col("c_idx") - F.col("w_idx")) == s).select(
        mod("w_idx").alias("task"), F.lit(EXAMPLE).alias("kind"), F.col("w_idx").alias("row"), F.col("c_idx").alias("other"),
        first.alias("first"), last.alias("last"), "y", no_vector.alias("v"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, started = _Task(p.dim), False
        # As often as in a batch of all words, one of a block meets a row again.
        batch = max(1, p.batch // blocks)
        loss, done = 0.0, 0
        held: list[pa.RecordBatch] = []

        def passed(rows: pa.Table, last: bool) -> int:
            """Steps over whole batches of rows, and the rest if it is the last."""
            nonlocal loss, done
            w, k, y = (rows.column(x).to_numpy() for x in ("row", "other", "y"))
            upto = len(w) if last else len(w) // batch * batch
            rates = [learning_rate((it + (turn + min(1.0, (done + i) / share)) / blocks) / p.iterations, p.alpha) for i in range(0, upto, batch)]
            loss += task.steps(w[:upto], k[:upto], y[:upto], batch, rates)
            done += upto
            return upto

        for given in batches:
            cut = int(np.searchsorted(given.column("kind").to_numpy(), EXAMPLE))
            if cut:
                task.take(given.slice(0, cut))
            if cut < given.num_rows:
                if not started:
                    task.ready()
                    started = True
                rows = pa.Table.from_batches([*held, given.slice(cut)])
                held = rows.slice(passed(rows, False)).to_batches()
        if not started:
            task.ready()
        if held:
            passed(pa.Table.from_batches(held), True)
        yield from task.result(loss, done)

    # Lines are dealt as they are, and copied where they arrive.  The text of the
    # key puts parameters first, and decides nearly all comparisons by itself.
    dealt = parts.unionByName(lines).repartitionById(blocks, F.col("task"))
    each = dealt.withColumn("copy", F.explode(F.sequence("first", "last")))
    key = F.when(kind == EXAMPLE, uniform_digits(p.seed + it, "row", "other", "copy")).otherwise(F.concat(F.lit("!"), kind.cast("string")))
    ordered = each.withColumn("key", key).sortWithinPartitions("key", "row", "other", "copy")
    return ordered.select("kind", "row", "other", "y", "v").mapInArrow(run, _OUT)


def _merged(out: DataFrame, dim: int, hashed: bool) -> DataFrame:
    """(kind, row, v) of what the tasks gave back; shared rows are averaged."""
    kept = out.where(F.col("kind").isin(WORD, CONTEXT)).select("kind", "row", "v")
    if not hashed:
        return kept
    shared = out.where(F.col("kind") == BUCKET)
    weighed = shared.select("row", F.transform("v", lambda x: x * F.col("weight")).alias("v"), "weight")
    sums = grouped_sum(weighed.withColumn("v", F.concat("v", F.array("weight"))), "row", "v", dim + 1)
    mean = F.transform(F.slice("v", 1, dim), lambda x: x / F.element_at("v", dim + 1))
    return kept.unionByName(sums.select(F.lit(BUCKET).alias("kind"), "row", mean.alias("v")))


@dataclass
class Trained:
    """Parameters (kind, row, v), stored, and the mean loss of each epoch."""

    parameters: DataFrame
    losses: list[float]
    dim: int

    def rows(self, *kinds: int) -> DataFrame:
        """(row, v) of some kinds; rows of words and buckets make one matrix."""
        return self.parameters.where(F.col("kind").isin(*kinds)).select("row", "v")

    def _array(self, *kinds: int) -> np.ndarray:
        """On the driver, for small models and the binary model file."""
        got = self.rows(*kinds).orderBy("row").toArrow()
        return _matrix(got.column("v").combine_chunks(), self.dim) if len(got) else np.zeros((0, self.dim))

    @property
    def words(self) -> np.ndarray:
        return self._array(WORD, BUCKET)

    @property
    def contexts(self) -> np.ndarray:
        return self._array(CONTEXT)


def started(spark: SparkSession, n_words: int, n_rows: int, n_contexts: int, p: Params) -> DataFrame:
    """(kind, row, v) before any training, uniform in (-0.5, 0.5) / dim by hash."""
    kind = F.when(F.col("id") < n_words, WORD).otherwise(BUCKET)
    words = spark.range(n_rows).select(kind.alias("kind"), F.col("id").alias("row"))
    contexts = spark.range(n_contexts).select(F.lit(CONTEXT).alias("kind"), F.col("id").alias("row"))
    return initial_vectors(words, p.dim, p.seed).unionByName(initial_vectors(contexts, p.dim, p.seed + 1))


def blocks_for(total: int, p: Params) -> int:
    """Workers of an epoch: as many as asked, where each has block_examples at
    least in a stratum."""
    return max(1, min(p.workers, math.isqrt(total // p.block_examples)))


def train(examples, n_words: int, n_contexts: int, p: Params, members: DataFrame | None = None, n_rows: int | None = None) -> Trained:
    """Vectors from examples (w_idx, c_idx, y, copy), or from lines (w_idx, c_idx,
    y, sampled) that stand for copies 1 to sampled, or from a function of the
    iteration that returns such a table (fresh draws each epoch).

    members (w_idx, row) names the rows that a word has beside its own, in
    0..n_rows - 1 behind the words; a word's vector is the mean of its rows.
    losses has the mean half squared error of each epoch.  A loss that is no
    number ends the training with an error; no examples leave the start.
    """
    first = examples(0) if callable(examples) else examples
    spark = first.sparkSession
    parameters = stored = cut_lineage(started(spark, n_words, n_rows or n_words, n_contexts, p))
    idle = None
    if members is not None:
        members = cut_lineage(members.select("w_idx", "row"))
        idle = parameters.where(F.col("kind") == BUCKET).join(members.select("row").distinct(), "row", "left_anti").select("kind", "row", "v")
        idle = cut_lineage(idle)
    losses = []
    for it in range(p.iterations):
        began = time.time()
        table = first if it == 0 else examples(it) if callable(examples) else examples
        total = table.agg(F.coalesce(F.sum("sampled"), F.lit(0))).first()[0] if "sampled" in table.columns else table.count()
        blocks = blocks_for(total, p)
        lost, n = 0.0, 0
        # In one order every epoch, blocks would always meet fresh from the same
        # others, and training would converge more slowly.
        order = np.random.default_rng((p.seed, it)).permutation(blocks).tolist() if total else []
        for turn, s in enumerate(order):
            out = cut_lineage(_stratum(parameters, members, table, p, blocks, it, s, turn, max(1, total // blocks**2)))
            got = out.where("kind = -1").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
            forget(stored)
            parameters, stored = _merged(out, p.dim, members is not None), out
            lost, n = lost + got["loss"], n + got["n"]
            if not np.isfinite(lost):
                raise ArithmeticError(f"loss is no number in iteration {it}; use a smaller alpha or batch")
            rate = learning_rate((it + (turn + 1) / blocks) / p.iterations, p.alpha)
            log.info("iteration %d of %d: %d of %d examples, %.0f a second, loss %.6f, rate %.6f", it + 1, p.iterations, n, total, n / max(time.time() - began, 1e-9), lost / max(n, 1), rate)
        losses.append(lost / n if n else 0.0)
        if callable(examples) and hasattr(table, "_stored_at"):
            forget(table)
    if idle is not None:
        parameters = parameters.where(F.col("kind") != BUCKET).unionByName(parameters.where(F.col("kind") == BUCKET).join(idle.select("row"), "row", "left_anti").select("kind", "row", "v")).unionByName(idle)
    return Trained(cut_lineage(parameters.select("kind", "row", "v")), losses, p.dim)
