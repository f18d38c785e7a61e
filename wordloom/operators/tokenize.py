"""From documents to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import CONTEXT_BREAK, tokens_of
from wordloom.params import Params


def tokenize(documents: DataFrame, p: Params = Params(), terminated: bool = True) -> DataFrame:
    """(doc_id, pos, w): one row per token, positions from 0.

    A document is a line: a break is appended to each unless terminated is
    False.  Null texts have no tokens.
    """
    found = tokens_of(F.col("text"), p.period_is_whitespace)
    if terminated:
        found = F.concat(found, F.array(F.lit(CONTEXT_BREAK)))
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(found).alias("pos", "w"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "w")


def drop_unterminated(tokens: DataFrame) -> DataFrame:
    """tokens without what follows the last break of each document."""
    last = tokens.where(F.col("w") == CONTEXT_BREAK).groupBy("doc_id").agg(F.max("pos").alias("last"))
    return tokens.join(last, "doc_id").where(F.col("pos") <= F.col("last")).select("doc_id", "pos", "w")
