"""Frequency of every n-gram, and in how many records it occurs.

Suffix-sorted counting: each position of a record emits one truncated suffix
(at most max_len terms), suffixes are routed by their first term, sorted in
reverse lexicographic order, and a stack of the open prefixes adds up the
count and the set of records of all of them in one pass.  A term is an
n-gram of length 1.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.skew import dealt, heavy_keys, heavy_share

#: Separates the terms of a suffix; lower than any escaped character.
SEP = "\x01"


def _escaped(term):
    """Free of SEP and still ordered and unique."""
    return F.replace(F.replace(term, F.lit("\x02"), F.lit("\x02\x04")), F.lit(SEP), F.lit("\x02\x03"))


def _unescaped(gram):
    return F.replace(F.replace(gram, F.lit("\x02\x03"), F.lit(SEP)), F.lit("\x02\x04"), F.lit("\x02"))


class _Open:
    """An open prefix: its count, the number of its records, and the run in
    which it was opened."""

    __slots__ = ("count", "records", "since")

    def __init__(self, since: int) -> None:
        self.count = self.records = 0
        self.since = since


class _Stack:
    """Open prefixes of the suffixes seen so far, innermost last.

    Records are numbers that add up, not sets: a record that comes again is
    taken off at the deepest prefix that was open when it came last, and thus
    from all shorter ones.  Where there are longer prefixes than one term, the
    run in which a record came last is kept for the records of the first term
    at hand; else records of a term come sorted and only the last is kept.
    """

    def __init__(self, nested: bool) -> None:
        self.terms: list[str] = []
        self.open: list[_Open] = []
        self.grams: list[str] = []
        self.counts: list[int] = []
        self.records: list[int] = []
        self.run = 0
        self.nested = nested
        self.seen: dict[int, int] = {}
        self.last: int | None = None

    def close(self, depth: int) -> None:
        """Emit the prefixes longer than depth and hand them to their parents."""
        while len(self.terms) > depth:
            top = self.open.pop()
            self.grams.append(SEP.join(self.terms))
            self.counts.append(top.count)
            self.records.append(top.records)
            self.terms.pop()
            if self.open:
                self.open[-1].count += top.count
                self.open[-1].records += top.records

    def push(self, suffix: str, count: int, records: np.ndarray) -> None:
        """A suffix, how often it occurs and its sorted records; may come in
        several pushes."""
        terms = suffix.split(SEP)
        depth = 0
        for a, b in zip(self.terms, terms):
            if a != b:
                break
            depth += 1
        self.close(depth)
        self.run += 1
        if not depth:
            self.seen.clear()
            self.last = None
        for t in terms[depth:]:
            self.terms.append(t)
            self.open.append(_Open(self.run))
        top = self.open[-1]
        top.count += count
        top.records += len(records)
        if not self.nested:
            top.records -= int(self.last == records[0])
            self.last = records[-1]
            return
        since = [o.since for o in self.open]
        for r in records.tolist():
            before = self.seen.get(r)
            if before is not None:
                self.open[bisect_right(since, before) - 1].records -= 1
            self.seen[r] = self.run

    def drain(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(self.grams, pa.string()), pa.array(self.counts, pa.int64()), pa.array(self.records, pa.int64())],
            names=["gram", "freq", "n_records"],
        )
        self.grams, self.counts, self.records = [], [], []
        return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """Equal neighbours of a (suffix, record, weight) batch as one run each:
    the suffix, its weight and its distinct records."""
    coded = batch.column(0).dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    record = batch.column(1).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    sums = np.add.reduceat(batch.column(2).to_numpy(zero_copy_only=False), begin)
    new = np.r_[True, (codes[1:] != codes[:-1]) | (record[1:] != record[:-1])]
    kept = record[new]
    cut = np.r_[np.cumsum(new)[begin] - 1, len(kept)]
    for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        yield names[codes[begin[k]]], int(sums[k]), kept[i:j]


def _terms_counted(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
    """_runs() of single terms as (gram, freq, n_records); the last run is kept
    in held (term, freq, n_records, last record) for the next batch."""
    codes = batch.column(0).dictionary_encode()
    at, record, weight = codes.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    freq = np.add.reduceat(weight, begin)
    new = np.r_[True, (at[1:] != at[:-1]) | (record[1:] != record[:-1])]
    n = np.add.reduceat(new.astype(np.int64), begin)
    names = codes.dictionary.take(pa.array(at[begin])).to_pylist()
    if held and held[0] == names[0]:
        freq[0] += held[1]
        n[0] += held[2] - int(held[3] == record[0])
    elif held:
        names, freq, n = [held[0], *names], np.r_[held[1], freq], np.r_[held[2], n]
    held[:] = [names[-1], int(freq[-1]), int(n[-1]), record[-1]]
    return pa.RecordBatch.from_arrays([pa.array(names[:-1], pa.string()), pa.array(freq[:-1]), pa.array(n[:-1])], names=["gram", "freq", "n_records"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stack where no prefix is longer than a term: it holds one at most."""
    held: list = []
    for batch in batches:
        if batch.num_rows:
            yield _terms_counted(batch, held)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held[:1]), pa.array(held[1:2]), pa.array(held[2:3])], names=["gram", "freq", "n_records"])


def _count_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack = _Stack(nested=True)
    for batch in batches:
        if not batch.num_rows:
            continue
        for suffix, count, records in _runs(batch):
            stack.push(suffix, count, records)
            if len(stack.grams) >= 10_000:
                yield stack.drain()
    stack.close(0)
    yield stack.drain()


def ngram_counts(
    df: DataFrame,
    record: str,
    terms: str,
    max_len: int = 1,
    weight: str | None = None,
    share: float | None = None,
    first_terms: DataFrame | None = None,
) -> DataFrame:
    """(gram, freq, n_records) of all n-grams of up to max_len terms.

    record is a bigint id, terms an array of strings; a record may come in
    several rows.  Each occurrence counts `weight` (1 by default).  Terms of
    a longer gram are joined by SEP.  Null terms end nothing and begin
    nothing: they are removed before suffixes are formed.  Rows without
    record id, terms or weight are left out; an empty table gives no row.

    First terms that hold `share` of the rows or more (found on a sample, by
    default a 32nd of what a shuffle partition holds) are routed by term and
    record, in parts of about that share.  A record is in one part only, so the
    parts' counts and record counts add up exactly, and no task gets more than
    its part of a hot term.  Where df is costly to compute, first_terms may name
    a cheaper one-column table with about the same mix of first terms to find
    the hot ones in.
    """
    counted = F.col(weight) if weight else F.lit(1)
    rows = df.select(
        F.col(record).cast("bigint").alias("record"),
        F.transform(F.filter(terms, lambda t: t.isNotNull()), _escaped).alias("terms"),
        counted.cast("bigint").alias("weight"),
    ).where(F.col("record").isNotNull() & (F.size("terms") > 0) & F.col("weight").isNotNull())
    if max_len > 1:
        at = F.sequence(F.lit(1), F.size("terms"))
        cut = F.transform(at, lambda i: F.array_join(F.slice("terms", i, max_len), SEP))
        rows = rows.select("record", F.explode(cut).alias("suffix"), "weight")
        rows = rows.withColumn("first", F.substring_index("suffix", SEP, 1))
    else:
        rows = rows.select("record", F.explode("terms").alias("suffix"), "weight").withColumn("first", F.col("suffix"))
    seen = rows.select("first") if first_terms is None else first_terms.toDF("term").select(_escaped(F.col("term")).alias("first"))
    hot = heavy_keys(seen, "first", share or heavy_share(df.sparkSession))
    routed = (
        dealt(rows, "first", hot, ["record"])
        .repartition("first", "__part")
        .sortWithinPartitions(F.desc("suffix"), "__part", "record")
        .select("suffix", "record", "weight")
    )
    partial = routed.mapInArrow(_count_terms if max_len == 1 else _count_sorted, "gram string, freq bigint, n_records bigint")
    return (
        partial.groupBy("gram")
        .agg(F.sum("freq").alias("freq"), F.sum("n_records").alias("n_records"))
        .withColumn("gram", _unescaped(F.col("gram")))
    )


def marked(counts: DataFrame, n_records, rare_below: int, common_share: tuple[int, int]) -> DataFrame:
    """counts with mark: 'rare' for grams in fewer than rare_below records,
    'common' for grams in at least common_share of all, null for the rest.
    A gram that is both is rare."""
    num, den = common_share
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") * den >= n_records * num, "common")
    return counts.withColumn("mark", mark)
