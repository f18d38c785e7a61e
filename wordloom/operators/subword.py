"""Hashed or listed subwords of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import fnv1_32
from wordloom.params import Params


def _hexed(word: Column) -> Column:
    return F.hex(F.encode(F.concat(F.lit("<"), word, F.lit(">")), "UTF-8"))


def ngrams_hex(word: Column, minn: int, maxn: int) -> Column:
    """Byte n-grams of <word> in hexadecimal, by start and then length.

    The wrapped word itself is no n-gram of itself; repeats are kept."""
    h = _hexed(word)
    n = (F.length(h) / 2).cast("int")
    starts = F.sequence(F.lit(0), n - 1)
    sizes = F.array(*[F.lit(k) for k in range(minn, maxn + 1)])
    at = F.flatten(
        F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda k: (k < n) & (i + k <= n)), lambda k: F.struct(i.alias("i"), k.alias("k"))))
    )
    return F.transform(at, lambda x: F.substr(h, x["i"] * 2 + 1, x["k"] * 2))


def ngrams_char(word: Column, minn: int, maxn: int) -> Column:
    """The same over characters instead of bytes, as strings."""
    s = F.concat(F.lit("<"), word, F.lit(">"))
    n = F.length(s)
    starts = F.sequence(F.lit(0), n - 1)
    sizes = F.array(*[F.lit(k) for k in range(minn, maxn + 1)])
    at = F.flatten(
        F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda k: (k < n) & (i + k <= n)), lambda k: F.struct(i.alias("i"), k.alias("k"))))
    )
    return F.transform(at, lambda x: F.substr(s, x["i"] + 1, x["k"]))


def word_ngrams(words: DataFrame, p: Params) -> DataFrame:
    """words with (ord, gram): gram in hexadecimal bytes, ord from 1.

    No rows where minn is below 1: subwords are off."""
    if p.minn < 1:
        return words.withColumn("ord", F.lit(None).cast("bigint")).withColumn("gram", F.lit(None).cast("string")).where(F.lit(False))
    if p.ngram_unit == "char":
        grams = F.transform(ngrams_char(F.col("w"), p.minn, p.maxn), lambda g: F.hex(F.encode(g, "UTF-8")))
    else:
        grams = ngrams_hex(F.col("w"), p.minn, p.maxn)
    out = words.select("*", F.posexplode(grams).alias("ord", "gram"))
    return out.withColumn("ord", F.col("ord").cast("bigint") + 1)


def subword_row(gram_hex: Column, vocab_size: int, buckets: int) -> Column:
    """The matrix row of a subword: behind the words, by hash."""
    return F.lit(vocab_size) + fnv1_32(gram_hex) % F.lit(buckets)


def word_subwords(vocab: DataFrame, vocab_size: int, p: Params, listed: DataFrame | None = None) -> DataFrame:
    """(w_idx, ord, sw_idx): the rows that make up a word's vector.

    Order 0 is the word's own row, followed by its hashed n-grams, or, where
    n-grams are off, by the subwords that `listed` (w, subwords) gives it; a
    listed subword that is the wrapped word itself is skipped, and so are
    words that the vocabulary lacks.  n-grams take precedence over a list.
    """
    own = vocab.select(F.col("idx").alias("w_idx"), F.lit(0).cast("bigint").alias("ord"), F.col("idx").alias("sw_idx"))
    if p.minn >= 1:
        more = word_ngrams(vocab.select("w", "idx"), p).select(
            F.col("idx").alias("w_idx"), "ord", subword_row(F.col("gram"), vocab_size, p.buckets).alias("sw_idx")
        )
    elif listed is not None:
        given = listed_subwords(vocab, listed)
        more = given.select("w_idx", "ord", subword_row(F.hex(F.encode("sw", "UTF-8")), vocab_size, p.buckets).alias("sw_idx"))
    else:
        return own
    return own.unionByName(more)


def parsed_subword_lines(lines: DataFrame) -> DataFrame:
    """(w, subwords) of lines `word sw1 sw2 ...` in a column `value`.

    A line needs a word and at least one subword; others are dropped (see
    malformed_subword_lines)."""
    parts = F.split("value", " ", -1)
    return lines.where(F.size(parts) >= 2).select(parts[0].alias("w"), F.slice(parts, 2, F.size(parts)).alias("subwords"))


def malformed_subword_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.size(F.split("value", " ", -1)) < 2)


def listed_subwords(vocab: DataFrame, listed: DataFrame) -> DataFrame:
    """(w_idx, ord, sw) of listed words in the vocabulary, ord from 1."""
    known = listed.join(vocab.select("w", F.col("idx").alias("w_idx")), "w")
    kept = F.filter("subwords", lambda s: s != F.concat(F.lit("<"), F.col("w"), F.lit(">")))
    out = known.select("w_idx", F.posexplode(kept).alias("ord", "sw"))
    return out.select("w_idx", (F.col("ord").cast("bigint") + 1).alias("ord"), "sw")


def unlisted_words(vocab: DataFrame, listed: DataFrame) -> DataFrame:
    """Words of the vocabulary that the list lacks; empty for a complete list."""
    return vocab.join(listed.select("w").distinct(), "w", "left_anti")
