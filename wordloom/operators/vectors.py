"""Composing, merging and looking up vectors.

Vectors are arrays of doubles.  Sums over groups go through one row per
component, which combine map-side, so no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.subword import subword_row, word_ngrams
from wordloom.params import Params


def components_of(rows: DataFrame, key: str | list[str], vector: str) -> DataFrame:
    """(key, d, x): one row per component."""
    keys = [key] if isinstance(key, str) else key
    out = rows.select(*keys, F.posexplode(vector).alias("d", "x"))
    return out.select(*keys, F.col("d").cast("bigint").alias("d"), F.col("x").cast("double").alias("x"))


def grouped_sum(rows: DataFrame, key: str, vector: str, dim: int, mean: bool = False) -> DataFrame:
    """(key, vector): the component-wise sum or mean per key."""
    agg = F.avg if mean else F.sum
    parts = [agg(F.col(vector)[i].cast("double")).alias(f"__{i}") for i in range(dim)]
    return rows.groupBy(key).agg(*parts).select(key, F.array(*[f"__{i}" for i in range(dim)]).alias(vector))


def composed(word_rows: DataFrame, matrix: DataFrame, dim: int) -> DataFrame:
    """(w_idx, v): the mean of a word's rows, repeats counting as often as they
    come.  word_rows is (w_idx, ord, sw_idx), matrix (row, v)."""
    joined = word_rows.join(matrix.withColumnRenamed("row", "sw_idx"), "sw_idx")
    return grouped_sum(joined, "w_idx", "v", dim, mean=True)


def base_word(c):
    """The word of a positional context name: up to the last underscore."""
    return F.regexp_replace(c, "_[^_]*$", "")


def merged_contexts(words: DataFrame, contexts: DataFrame, dim: int, positional: bool) -> DataFrame:
    """(w, v): word vectors plus the sum of the vectors of the word's contexts.

    Words without context vectors keep their own; see unmerged_words."""
    named = contexts.withColumn("w", base_word(F.col("c")) if positional else F.col("c"))
    sums = grouped_sum(named.select("w", "v"), "w", "v", dim).withColumnRenamed("v", "more")
    both = words.join(sums, "w", "left")
    added = F.when(F.col("more").isNull(), F.col("v")).otherwise(F.zip_with("v", "more", lambda a, b: a + b))
    return both.select("w", added.alias("v"))


def unmerged_words(words: DataFrame, contexts: DataFrame, positional: bool) -> DataFrame:
    named = contexts.select((base_word(F.col("c")) if positional else F.col("c")).alias("w")).distinct()
    return words.join(named, "w", "left_anti")


def embedded(words: DataFrame, vocab: DataFrame, matrix: DataFrame, vocab_size: int, dim: int, p: Params) -> DataFrame:
    """(w, v): a vector for any word, known or not.

    words has w and, optionally, subwords (array), which override generated
    n-grams.  A known word's own row joins its subwords' rows; the vector is
    their mean, and zero where nothing is known.  Null words are left out;
    each distinct (w, subwords) gives one row.
    """
    has_list = "subwords" in words.columns
    asked = words.where(F.col("w").isNotNull()).select("w", *(["subwords"] if has_list else [])).distinct()
    asked = asked.withColumn("__id", F.xxhash64(F.hex(F.encode("w", "UTF-8")), *([F.to_json(F.struct("subwords"))] if has_list else [])))
    own = asked.select("__id", "w").join(vocab.select("w", F.col("idx").alias("row")), "w").select("__id", "row")
    generated = asked.where(F.col("subwords").isNull()) if has_list else asked
    rows = own
    if p.minn >= 1:
        grams = word_ngrams(generated.select("__id", "w"), p)
        rows = rows.unionByName(grams.select("__id", subword_row(F.col("gram"), vocab_size, p.buckets).alias("row")))
    if has_list:
        given = asked.where(F.col("subwords").isNotNull()).select("__id", F.explode("subwords").alias("sw"))
        rows = rows.unionByName(given.select("__id", subword_row(F.hex(F.encode("sw", "UTF-8")), vocab_size, p.buckets).alias("row")))
    means = grouped_sum(rows.join(matrix, "row"), "__id", "v", dim, mean=True)
    zero = F.array(*[F.lit(0.0)] * dim)
    return asked.join(means, "__id", "left").select("w", *(["subwords"] if has_list else []), F.coalesce("v", zero).alias("v"))


def initial_vectors(keys: DataFrame, dim: int, seed: int) -> DataFrame:
    """keys (row) with v uniform in (-0.5, 0.5) / dim, by hash."""
    from wordloom.functions.hashing import uniform

    parts = [(uniform(seed, F.col("row"), F.lit(k)) - 0.5) / F.lit(float(dim)) for k in range(dim)]
    return keys.withColumn("v", F.array(*parts))


def batch_gradient(examples: DataFrame, words: DataFrame, contexts: DataFrame) -> DataFrame:
    """(w_idx, d, grad): the gradient of the sum of half squared errors of
    examples (w_idx, c_idx, y) in the word vectors, all examples at once."""
    joined = examples.join(words.withColumnRenamed("v", "wv"), "w_idx").join(contexts.withColumnRenamed("v", "cv"), "c_idx")
    dot = F.aggregate(F.zip_with("wv", "cv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    errors = joined.withColumn("g", dot - F.col("y"))
    parts = errors.select("w_idx", "g", F.posexplode("cv").alias("d", "x"))
    return parts.groupBy("w_idx", F.col("d").cast("bigint").alias("d")).agg(F.sum(F.col("g") * F.col("x").cast("double")).alias("grad"))
