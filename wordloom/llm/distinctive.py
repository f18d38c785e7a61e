"""How characteristic a context is of a target word.

Divergence from randomness: the information content of the context's
frequency under a geometric model of the collection, times the Laplace
after-effect, with the frequency normalised by the target's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.dedupe import version_rank, version_value
from wordloom.operators.spool import spool_cells


def context_scores(lines: DataFrame, length_weight: float = 1.0) -> DataFrame:
    """Per (corpus_id, w_idx, c_idx) with a cell n above 0:

    t          sum of the target's cells (the record's length)
    n_targets  targets of the corpus with any cell
    df, f      targets that have the context; its cells summed over them
    score      gain * information, with
               tfn = n * log2(1 + length_weight * mean(t) / t),
               lambda = f / n_targets,
               information = log2(1 + lambda) + tfn * log2((1 + lambda) / lambda),
               gain = 1 / (1 + tfn)

    Contexts and targets have a row per word and corpus in the joins; a hot
    target is spread by the finer keys while counting, and split at run time
    where the joins shuffle.
    """
    cells = spool_cells(lines)
    # Counted on n and t (always above 0), so that every reading of the cells
    # asks for the same columns and they share one scan and shuffle, also where
    # the score is not wanted.
    target = cells.groupBy("corpus_id", "w_idx").agg(F.sum("n").alias("t"))
    context = cells.groupBy("corpus_id", "c_idx").agg(F.count(F.when(F.col("n") > 0, 1)).alias("df"), F.sum("n").alias("f"))
    corpus = target.groupBy("corpus_id").agg(
        F.count(F.when(F.col("t") > 0, 1)).alias("n_targets"), F.avg(F.col("t").cast("double")).alias("mean_t")
    )
    target = target.select(F.col("corpus_id").alias("corpus_w"), F.col("w_idx").alias("target"), "t")
    context = context.select(F.col("corpus_id").alias("corpus_c"), F.col("c_idx").alias("context"), "df", "f")
    corpus = corpus.withColumnRenamed("corpus_id", "corpus_n")
    joined = (
        cells.join(target, cells.corpus_id.eqNullSafe(target.corpus_w) & (cells.w_idx == target.target))
        .join(context, cells.corpus_id.eqNullSafe(context.corpus_c) & (cells.c_idx == context.context))
        .join(corpus, cells.corpus_id.eqNullSafe(corpus.corpus_n))
    )
    mean = F.col("f") / F.col("n_targets")
    tfn = F.col("n") * F.log2(1 + length_weight * F.col("mean_t") / F.col("t"))
    scored = joined.withColumn("tfn", tfn).withColumn("mean", mean)
    information = F.log2(1 + F.col("mean")) + F.col("tfn") * F.log2((1 + F.col("mean")) / F.col("mean"))
    return scored.select(
        "corpus_id", "w_idx", "c_idx", "n", "t", "n_targets", "df", "f", (information / (1 + F.col("tfn"))).alias("score")
    )


def frequent_targets(words: DataFrame, corpora: DataFrame) -> DataFrame:
    """(corpus_id, w_idx) whose latest freq reaches the corpus's minfreq.

    words is a vocabulary (corpus_id, idx, freq, counted_at); of rows with
    the same key and time the one with the largest freq counts.
    """
    # One number, so that the newest is found in the hash aggregate; a null freq
    # is that of its time, and below any other.
    rank = version_rank(F.col("counted_at"), F.greatest(F.coalesce("freq", F.lit(-1)), F.lit(-1)) + 1)
    last = words.groupBy("corpus_id", "idx").agg(F.max(rank).alias("last"))
    least = corpora.groupBy(F.col("corpus_id").alias("corpus")).agg(F.max("minfreq").alias("minfreq"))
    return (
        last.join(least, F.col("corpus_id") == F.col("corpus"))
        .where(version_value(F.col("last")) - 1 >= F.col("minfreq"))
        .select("corpus_id", F.col("idx").alias("w_idx"))
    )
