"""Subsampling of frequent words and noise draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.hashing import hash60, uniform
from wordloom.functions.text import CONTEXT_BREAK
from wordloom.operators.ordered import ranked
from wordloom.params import Params
from wordloom.runtime import BROADCAST_ROWS, cut_lineage


def subsample_p(freq: Column, corpus_size: Column, t: float) -> Column:
    """Probability that an occurrence is dropped: max(0, 1 - sqrt(t / share))."""
    if t == 0:
        return F.lit(0.0)
    share = freq.cast("double") / corpus_size.cast("double")
    return F.when(freq > 0, F.greatest(F.lit(0.0), 1 - F.sqrt(F.lit(t) / share))).otherwise(F.lit(0.0))


def keep_p(freq: Column, corpus_size: Column, t: float) -> Column:
    return 1 - subsample_p(freq, corpus_size, t)


def known_tokens(tokens: DataFrame, vocab: DataFrame, rows: int | None = None) -> DataFrame:
    """tokens (doc_id, pos, w) of the vocabulary (w, freq), with freq.

    A vocabulary of at most `rows` words (by default BROADCAST_ROWS) is
    broadcast.  Of a larger one the most frequent are, and only the tokens of
    the long tail are shuffled, so no frequent word makes a task of its own.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    words = vocab.select("w", "freq")
    if words.limit(rows + 1).count() <= rows:
        return tokens.join(F.broadcast(words), "w")
    hot = cut_lineage(words.orderBy(F.desc("freq"), "w").limit(rows))
    cold = words.join(F.broadcast(hot.select("w")), "w", "left_anti")
    near = tokens.join(F.broadcast(hot), "w")
    far = tokens.join(F.broadcast(hot.select("w")), "w", "left_anti").join(cold.hint("merge"), "w")
    return near.unionByName(far)


def subsampled(tokens: DataFrame, vocab: DataFrame, size: int, p: Params, rows: int | None = None) -> DataFrame:
    """tokens (doc_id, pos, w) of the vocabulary that survive subsampling.

    Words outside the vocabulary go first, then each occurrence is dropped
    with its word's probability; breaks always stay.  Both happen before
    windows are formed, so survivors move closer together.  The vocabulary
    should be a stored table; see known_tokens() for how it is met.
    """
    return surviving(known_tokens(tokens, vocab, rows), size, p)


def surviving(known: DataFrame, size: int, p: Params) -> DataFrame:
    """The same of what known_tokens() returns."""
    if p.subsample > 0:
        drop = subsample_p(F.col("freq"), F.lit(size), p.subsample)
        known = known.where((F.col("w") == CONTEXT_BREAK) | (uniform(p.seed, "doc_id", "pos") > drop))
    return known.select("doc_id", "pos", "w")


def noise_table(contexts: DataFrame, p: Params) -> DataFrame:
    """(c, idx, q, cum_q) of contexts (c, idx, freq): the share of a context in
    the noise is q over the sum of all q, and cum_q runs in the order of idx.

    Weights freq^power are integers (six decimals), so that draws are exact.
    Contexts that never occur have weight 0 and are left out.
    """
    q = F.round(F.pow(F.col("freq").cast("double"), F.lit(p.unigram_power)) * 1e6).cast("bigint")
    weighted = contexts.select("c", "idx", q.alias("q")).where(F.col("q") > 0)
    return ranked(weighted, [F.asc("idx")], "place", "q", "cum_q").select("c", "idx", "q", "cum_q")


def drawn(events: DataFrame, noise: DataFrame, keys: list[str], p: Params, seed: int | None = None) -> DataFrame:
    """events with `negative` draws each: columns k (from 1) and c.

    Any context may be drawn, the target's own too, unless exclude_target
    drops the draws that hit the event's word w.

    A draw is a point on the line of cumulated weights.  The line is cut into
    equal sections, about one per context; a draw meets the contexts of its
    section in an equi-join, so the look-up is hashed and, as draws are
    uniform, evenly spread.  There are at most twice as many rows as contexts
    (or 1,024 more), which decides whether they are broadcast.
    """
    bounds = noise.agg(F.max("cum_q").alias("total"), F.count(F.lit(1)).alias("n")).first()
    spark = events.sparkSession
    if not bounds["total"]:
        return spark.createDataFrame([], T.StructType([*events.schema.fields, T.StructField("k", T.LongType()), T.StructField("c", T.StringType())]))
    sections = max(1024, bounds["n"])
    total, width = bounds["total"], max(1, -(-bounds["total"] // sections))
    section = lambda x: F.floor(x / F.lit(width)).cast("bigint")
    low = F.col("cum_q") - F.col("q")
    spans = noise.select(
        "c", low.alias("__low"), F.col("cum_q").alias("__high"),
        F.explode(F.sequence(section(low), section(F.col("cum_q") - 1))).alias("__section"),
    )
    spans = F.broadcast(spans) if bounds["n"] + sections <= BROADCAST_ROWS else spans.hint("merge")
    draws = events.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(p.negative).cast("bigint"))))
    # Never null by their form: tests for null before the join would each hash again.
    sure = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    at = sure(hash60(p.seed if seed is None else seed, *keys, "k") % F.lit(total))
    draws = draws.withColumn("__at", at).withColumn("__section", sure(section(F.col("__at"))))
    hit = draws.join(spans, "__section").where((F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__high")))
    if p.exclude_target:
        own = F.regexp_replace("c", "_[^_]*$", "") if p.positional else F.col("c")
        hit = hit.where(own != F.col("w"))
    return hit.drop("__section", "__at", "__low", "__high")


#: Ways to draw `negative` contexts for each event, by name: functions of
#: events, the noise table, the keys of an event and the settings that add the
#: columns k (from 1) and c.  Others may be added.
SAMPLERS = {"noise": drawn}
