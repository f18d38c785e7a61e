"""Per-key results when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.runtime import shuffle_partitions

SAMPLE_ROWS = 200_000
#: Rows sampled of a key at the bound, at least.
SEEN = 40


def heavy_share(spark: SparkSession) -> float:
    """The share of all rows from which a key is split: a 32nd of what a shuffle
    partition holds, so that no few keys of one partition make it much longer
    than the others."""
    return 1 / (32 * shuffle_partitions(spark))


def heavy_keys(df: DataFrame, key: str, share: float, sample_rows: int = SAMPLE_ROWS, total: int | None = None) -> DataFrame:
    """(key, parts): keys that seem to hold at least `share` of the rows of df,
    most frequent first, and into how many parts of that share each falls.

    Found on a Bernoulli sample of about sample_rows rows, or of SEEN rows for
    a share if that is more.  They only decide which way a key's rows take; no
    result depends on the sample.  At most 1/share keys come out, which bounds
    what is broadcast.  total is the number of rows, where it is known.
    """
    total = df.count() if total is None else total
    wanted = max(sample_rows, SEEN / share) if sample_rows >= SAMPLE_ROWS else sample_rows
    fraction = min(1.0, wanted / max(total, 1))
    picked = df.select(key).where(F.col(key).isNotNull())
    if fraction < 1.0:
        picked = picked.sample(False, fraction, seed=7)
    rows = share * min(total, wanted)
    return (
        picked.groupBy(key)
        .agg(F.count(F.lit(1)).alias("__seen"))
        .where(F.col("__seen") >= max(2.0, rows))
        .orderBy(F.desc("__seen"), key)
        .limit(max(1, int(1 / share)))
        .select(key, F.ceil(F.col("__seen") / F.lit(max(rows, 1.0))).cast("int").alias("parts"))
    )


def dealt(df: DataFrame, key: str, heavy: DataFrame, by: list[str]) -> DataFrame:
    """df with __part: 0, or for a heavy key (key, parts) one of its parts, the
    same for rows that agree in `by`.

    The heavy keys, a bounded number, are met in a broadcast join, so df is
    read once, and a shuffle on key and part gives no task more than one part
    of a heavy key.
    """
    known = F.broadcast(heavy.select(F.col(key).alias("__key"), F.col("parts").alias("__parts")))
    tagged = df.join(known, F.col(key) == F.col("__key"), "left")
    part = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*by), "__parts")).otherwise(0).cast("int")
    return tagged.withColumn("__part", part).drop("__key", "__parts")


def word_line_totals(lines: DataFrame, share: float | None = None, sample_rows: int = SAMPLE_ROWS, total: int | None = None) -> DataFrame:
    """Per w_idx: rows as delivered, cooc summed over distinct lines, and the
    number of distinct contexts with a co-occurrence.

    Heavy words (of `share` of the rows, by default heavy_share) are detected
    on a sample.  Their rows meet the heavy words in a broadcast join that
    deals them over parts by context; with the other rows, each word of which
    is one part, they go through one shuffle, after which lines and contexts
    are folded in place.  What parts give is united per word.

    Lines with null w_idx belong to no word and are left out; an empty table
    gives an empty result.
    """
    key, line = "w_idx", ["corpus_id", "run_no", "c_idx"]
    lines = lines.select(key, *line, "cooc").where(F.col(key).isNotNull())
    heavy = heavy_keys(lines, key, share or heavy_share(lines.sparkSession), sample_rows, total)
    # A context is in one part; lines without any are dealt by their run.
    by = [F.coalesce("c_idx", F.lit(-1)), F.when(F.col("c_idx").isNull(), F.struct("corpus_id", "run_no"))]
    spread = dealt(lines, key, heavy, by).repartition(key, "__part")
    once = spread.groupBy(key, "__part", *line).agg(F.count(F.lit(1)).alias("__rows"), F.max("cooc").alias("__cooc"))
    per_context = once.groupBy(key, "__part", "c_idx").agg(
        F.sum("__rows").alias("__rows"), F.coalesce(F.sum("__cooc"), F.lit(0)).alias("__cooc")
    )
    seen = F.col("c_idx").isNotNull() & (F.col("__cooc") > 0)
    in_part = per_context.groupBy(key, "__part").agg(
        F.sum("__rows").alias("n_rows"),
        F.sum(F.when(F.col("c_idx").isNotNull(), F.col("__cooc")).otherwise(0)).alias("sum_cooc"),
        F.count(F.when(seen, 1)).alias("n_contexts"),
    )
    return in_part.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n_rows", "sum_cooc", "n_contexts")])
