"""How often items occur together, and how much more often than chance.

A basket is one run of a corpus, given as lines (run, word, context, count).
Items are deduplicated per basket (deliveries of a line count once), both
orders of a pair meet in one ordered pair, counts are combined map-side, and
lift and pointwise mutual information follow from the marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_pairs(lines: DataFrame) -> DataFrame:
    """(corpus_id, idx_a, idx_b, n_ab, n_ba, n_self), idx_a <= idx_b.

    n_ab is the cell (idx_a, idx_b), n_ba its mirror, n_self the cell of a
    word with itself.  Lines without context and noise draws drop out; of
    deliveries of one line the largest cooc counts.  Keys are pairs, so a hot
    word is spread over all tasks.
    """
    w, c, n = F.col("w_idx"), F.col("c_idx"), F.col("cooc")
    directed = lines.where(w.isNotNull() & c.isNotNull() & (n > 0)).select(
        "corpus_id",
        "run_no",
        F.least(w, c).alias("idx_a"),
        F.greatest(w, c).alias("idx_b"),
        F.when(w < c, n).alias("ab"),
        F.when(w > c, n).alias("ba"),
        F.when(w == c, n).alias("same"),
    )
    # True of every row; said here, the planner need not add it to one reading.
    directed = directed.where(F.col("idx_a").isNotNull() & F.col("idx_b").isNotNull())
    once = directed.groupBy("corpus_id", "run_no", "idx_a", "idx_b").agg(
        F.max("ab").alias("ab"), F.max("ba").alias("ba"), F.max("same").alias("same")
    )
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return once.groupBy("corpus_id", "idx_a", "idx_b").agg(
        total("ab").alias("n_ab"), total("ba").alias("n_ba"), total("same").alias("n_self")
    )


def marginals(pairs: DataFrame) -> DataFrame:
    """(corpus_id, idx, t): the sum of the cells with this word as target."""
    sides = F.array(
        F.struct(F.col("idx_a").alias("idx"), (F.col("n_ab") + F.col("n_self")).alias("n")),
        F.struct(F.col("idx_b").alias("idx"), F.col("n_ba").alias("n")),
    )
    return (
        pairs.select("corpus_id", F.explode(sides).alias("s"))
        .where(F.col("s.n") > 0)
        .groupBy("corpus_id", F.col("s.idx").alias("idx"))
        .agg(F.sum("s.n").alias("t"))
    )


def pair_association(lines: DataFrame, min_count: int = 1) -> DataFrame:
    """(corpus_id, idx_a, idx_b, n, t_a, t_b, total, lift, pmi) of every pair
    idx_a < idx_b whose cell n is at least min_count.

    All figures are sums over the lines.  The marginals have a row per word
    and corpus; where they are small enough at run time the joins broadcast
    them, else both sides are shuffled and hot words split at run time.
    """
    pairs = ordered_pairs(lines)
    margin = marginals(pairs)
    total = margin.groupBy("corpus_id").agg(F.sum("t").alias("total"))
    # Naming every column keeps both readings of pairs one and the same shuffle.
    whole = (F.col("n_ba") >= 0) & (F.col("n_self") >= 0)
    kept = pairs.where((F.col("n_ab") >= max(1, min_count)) & whole).select(
        "corpus_id", "idx_a", "idx_b", F.col("n_ab").alias("n")
    )
    same = lambda x: F.col(x)
    a = margin.select(same("corpus_id").alias("corpus_a"), same("idx").alias("word_a"), same("t").alias("t_a"))
    b = margin.select(same("corpus_id").alias("corpus_b"), same("idx").alias("word_b"), same("t").alias("t_b"))
    joined = (
        kept.join(a, kept.corpus_id.eqNullSafe(a.corpus_a) & (kept.idx_a == a.word_a))
        .join(b, kept.corpus_id.eqNullSafe(b.corpus_b) & (kept.idx_b == b.word_b), "left")
        .join(total.withColumnRenamed("corpus_id", "corpus_t"), F.col("corpus_id").eqNullSafe(F.col("corpus_t")))
        .withColumn("t_b", F.coalesce("t_b", F.lit(0)))
    )
    lift = F.try_divide(
        F.col("n").cast("double") * F.col("total"), F.col("t_a").cast("double") * F.col("t_b")
    )
    return joined.select(
        "corpus_id", "idx_a", "idx_b", "n", "t_a", "t_b", "total", lift.alias("lift"), F.ln(lift).alias("pmi")
    )


def pairs_above_chance(lines: DataFrame, min_count: int, min_lift: int) -> DataFrame:
    """Pairs with n >= min_count and n*total >= min_lift*t_a*t_b, in integers."""
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    return pair_association(lines, min_count).where(
        wide("n") * wide("total") >= (wide("t_a") * wide("t_b")) * F.lit(min_lift).cast("decimal(4,0)")
    )
