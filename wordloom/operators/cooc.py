"""Co-occurrence cells, marginals and the external-memory form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import uniform
from wordloom.operators.ordered import ranked_by_share
from wordloom.params import Params


def cooc_cells(pairs: DataFrame) -> DataFrame:
    """(w, c, cooc): pair events counted per cell, combined map-side."""
    return pairs.groupBy("w", "c").agg(F.count(F.lit(1)).alias("cooc"))


def row_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("w").agg(F.sum("cooc").alias("total"))


def col_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("c").agg(F.sum("cooc").alias("total"))


def smoothed_total(columns: DataFrame, cds: float) -> DataFrame:
    """(cds_total): the sum of total^cds over the contexts."""
    return columns.agg(F.sum(F.pow(F.col("total").cast("double"), F.lit(cds))).alias("cds_total"))


def cells_or_zero(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """pairs (w, c, ...) with cooc, 0 where the cell is empty."""
    return pairs.join(cells, ["w", "c"], "left").withColumn("cooc", F.coalesce("cooc", F.lit(0)))


def indexed_cells(cells: DataFrame, vocab: DataFrame, contexts: DataFrame) -> DataFrame:
    """(w_idx, c_idx, cooc) of cells whose word and context are known."""
    rows = vocab.select("w", F.col("idx").alias("w_idx"))
    cols = contexts.select("c", F.col("idx").alias("c_idx"))
    return cells.join(rows, "w").join(cols, "c").select("w_idx", "c_idx", "cooc")


def spooled(pairs: DataFrame, noise: DataFrame) -> DataFrame:
    """(w, c, cooc, sampled): positives count for cooc and both kinds for
    sampled; a cell that only noise drew has cooc 0."""
    both = pairs.select("w", "c", F.lit(1).alias("hit")).unionByName(noise.select("w", "c", F.lit(0).alias("hit")))
    return both.groupBy("w", "c").agg(F.sum("hit").alias("cooc"), F.count(F.lit(1)).alias("sampled"))


def replicated(spool: DataFrame) -> DataFrame:
    """Each line `sampled` times (k from 1), every copy with the whole cooc."""
    return spool.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("sampled"))))


def shuffled(lines: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """lines in a reproducible random order, place from 0."""
    return ranked_by_share(lines, uniform(seed, *keys), [F.asc(k) for k in keys], "place")


def spool_estimate(total: int, p: Params) -> dict[str, float]:
    """Lines and bytes that a spool of `total` pairs takes on disk."""
    lines = total + p.negative * total / (2 * p.window)
    return {"lines": lines, "peak_bytes": lines * (16 + 12), "final_bytes": lines * 12}
