"""Vocabularies of words and of contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import CONTEXT_BREAK
from wordloom.operators.ordered import ranked
from wordloom.params import Params

#: Words up to which a cut merges the tasks' own lists in one task; beyond,
#: words are ranked in range partitions.
TOP_ROWS = 100_000


def word_counts(tokens: DataFrame) -> DataFrame:
    """(w, freq) over all tokens, breaks included."""
    return tokens.groupBy("w").agg(F.count(F.lit(1)).alias("freq"))


def cut_counts(counts: DataFrame, p: Params) -> DataFrame:
    """(w, freq) of the words that make the vocabulary: freq at least minfreq,
    at most maxvocab of them (most frequent first, ties by the word's bytes),
    and the break in any case, with freq 0 if it did not make it."""
    kept = counts.where(F.col("freq") >= p.minfreq)
    if 0 < p.maxvocab <= TOP_ROWS:
        kept = kept.orderBy(F.desc("freq"), "w").limit(p.maxvocab)
    elif p.maxvocab:
        kept = ranked(kept, [F.desc("freq"), F.asc("w")], "rank").where(F.col("rank") < p.maxvocab).select("w", "freq")
    # The break competes like any word; a row with freq 0 stands by.
    spark = counts.sparkSession
    spare = spark.createDataFrame([(CONTEXT_BREAK, 0)], "w string, freq bigint")
    return kept.unionByName(spare).groupBy("w").agg(F.max("freq").alias("freq"))


def build_vocab(counts: DataFrame, p: Params) -> DataFrame:
    """(w, idx, freq), idx the rank by freq from 0; a break that was cut is last."""
    return ranked_vocab(cut_counts(counts, p))


def ranked_vocab(cut: DataFrame) -> DataFrame:
    return ranked(cut, [F.desc("freq"), F.asc("w")], "idx").select("w", "idx", "freq")


def corpus_size(counts: DataFrame, p: Params, scope: str = "stored") -> DataFrame:
    """(corpus_size) over the words above minfreq: before the maxvocab cut
    ('build') or over the vocabulary as stored ('stored')."""
    if scope not in ("build", "stored"):
        raise ValueError("scope is build or stored")
    held = counts.where(F.col("freq") >= p.minfreq) if scope == "build" else cut_counts(counts, p)
    return held.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("corpus_size"))


def context_slots(vocab: DataFrame, p: Params) -> DataFrame:
    """(c, base_w, pos): every context that can occur, each word at each offset
    of the window, or each word once where positions do not count (pos 0)."""
    if not p.positional:
        return vocab.select(F.col("w").alias("c"), F.col("w").alias("base_w"), F.lit(0).cast("bigint").alias("pos"))
    offsets = F.array(*[F.lit(k).cast("bigint") for k in range(-p.window, p.window + 1) if k])
    return vocab.select(F.col("w").alias("base_w"), F.explode(offsets).alias("pos")).select(
        context_name(F.col("base_w"), F.col("pos")).alias("c"), "base_w", "pos"
    )


def context_name(word, pos):
    """The context's name: the word and its signed offset."""
    return F.concat_ws("_", word, pos.cast("string"))


def context_counts(slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(c, base_w, pos, freq): windowed counts, 0 for slots never seen.

    pairs has (c) per event; contexts outside the slots are an error in the
    data and are left out here (see unknown_contexts)."""
    return with_counts(slots, pairs.groupBy("c").agg(F.count(F.lit(1)).alias("freq")))


def with_counts(slots: DataFrame, seen: DataFrame) -> DataFrame:
    return slots.join(seen, "c", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def context_vocab(slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """context_counts with idx, the rank by freq (ties by name)."""
    return ranked_contexts(context_counts(slots, pairs))


def ranked_contexts(counts: DataFrame) -> DataFrame:
    return ranked(counts, [F.desc("freq"), F.asc("c")], "idx").select("c", "base_w", "pos", "idx", "freq")


def unknown_contexts(slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contexts of pairs that are no slot; empty for consistent inputs."""
    return pairs.select("c").distinct().join(slots, "c", "left_anti")
