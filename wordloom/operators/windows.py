"""Sentences, chunks and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.hashing import uniform
from wordloom.functions.text import CONTEXT_BREAK
from wordloom.operators.vocab import context_name
from wordloom.params import Params


def sentences(tokens: DataFrame, p: Params) -> DataFrame:
    """(doc_id, sent, chunk, rn, pos, w) of the words between breaks.

    sent counts the breaks before a word, rn its place among the words of its
    sentence, and a chunk holds max_sentence of them; windows end at either.
    All three windows share one shuffle on doc_id.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    by_sent = Window.partitionBy("doc_id", "sent").orderBy("pos")
    is_break = F.col("w") == CONTEXT_BREAK
    numbered = tokens.withColumn("sent", F.sum(F.when(is_break, 1).otherwise(0)).over(by_doc)).where(~is_break)
    rn = F.row_number().over(by_sent).cast("bigint") - 1
    return numbered.withColumn("rn", rn).select(
        "doc_id", "sent", F.floor(F.col("rn") / p.max_sentence).cast("bigint").alias("chunk"), "rn", "pos", "w"
    )


def window_of(p: Params):
    """The half-width at a target: fixed, or uniform in 1..window."""
    if not p.weight_window:
        return F.lit(p.window)
    return 1 + F.floor(uniform(p.seed + 1, "doc_id", "pos") * p.window)


def window_pairs(words: DataFrame, p: Params) -> DataFrame:
    """(doc_id, sent, chunk, rn, w, base_w, pos, c): one row per context.

    Neighbours come from lead and lag within the chunk, one pair of
    expressions per offset, so no self-join is needed.  pos is the signed
    distance; c names the context, with the distance where positions count.
    """
    chunk = Window.partitionBy("doc_id", "sent", "chunk").orderBy("rn")
    near = []
    for k in range(-p.window, p.window + 1):
        if k:
            other = F.lag("w", -k).over(chunk) if k < 0 else F.lead("w", k).over(chunk)
            near.append(F.struct(F.lit(k).cast("bigint").alias("pos"), other.alias("base_w")))
    spread = words.withColumn("reach", window_of(p)).withColumn("near", F.array(*near))
    out = spread.select("doc_id", "sent", "chunk", "rn", "w", "reach", F.explode("near").alias("n")).select(
        "doc_id", "sent", "chunk", "rn", "w", "reach", "n.base_w", "n.pos"
    )
    out = out.where(F.col("base_w").isNotNull() & (F.abs("pos") <= F.col("reach"))).drop("reach")
    name = context_name(F.col("base_w"), F.col("pos")) if p.positional else F.col("base_w")
    return out.withColumn("c", name)


def target_events(words: DataFrame) -> DataFrame:
    """(doc_id, sent, chunk, rn, w): one event per word of a sentence, also of
    one-word sentences; it has no context and drives the noise draws."""
    return words.select("doc_id", "sent", "chunk", "rn", "w")
