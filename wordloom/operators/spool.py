"""Cells and marginals of a spilled co-occurrence run.

A spool is a table (corpus_id, run_no, w_idx, c_idx, cooc).  Lines with the
same (corpus_id, run_no, w_idx, c_idx) are deliveries of one line and count
once, with the largest cooc among them.  Lines without context (null c_idx)
and noise draws (cooc 0 or null) are no co-occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spool_cells(lines: DataFrame) -> DataFrame:
    """(corpus_id, w_idx, c_idx, n): cooc summed over the runs.

    Both aggregations combine map-side and are keyed finer than any word, so
    a word that holds a large part of all lines is spread over all tasks.
    """
    once = (
        lines.where(F.col("w_idx").isNotNull() & F.col("c_idx").isNotNull() & (F.col("cooc") > 0))
        .groupBy("corpus_id", "run_no", "w_idx", "c_idx")
        .agg(F.max("cooc").alias("cooc"))
    )
    return once.groupBy("corpus_id", "w_idx", "c_idx").agg(F.sum("cooc").alias("n"))
