"""From a corpus to vectors: the stages in order, and the two ways to train.

The vocabulary and the cells are stored (checkpointed) when they are made,
as they are read several times; everything else is one lazy plan.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.text import CONTEXT_BREAK
from wordloom.operators import association as assoc
from wordloom.operators import cooc, sampling, subword, train, vectors, vocab, windows
from wordloom.operators.tokenize import tokenize
from wordloom.params import Params
from wordloom.runtime import cut_lineage, forget
from wordloom.sources.formats import write_model_rows, write_vectors


class Corpus:
    """The stages of a corpus (doc_id, text) under one set of parameters."""

    def __init__(self, documents: DataFrame, p: Params, cut: DataFrame | None = None) -> None:
        """cut is a vocabulary (w, freq) made before; else the corpus is counted."""
        self.documents = documents.select("doc_id", "text")
        self.p = p
        if cut is not None:
            if not cut.where(F.col("w") == CONTEXT_BREAK).limit(1).count():
                raise ValueError(f"the vocabulary lacks the context break {CONTEXT_BREAK}")
            self.cut = cut_lineage(cut.select("w", "freq"))

    def under(self, **changes) -> Corpus:
        """The same corpus under other parameters; the vocabulary is kept where
        no parameter that shapes it changes."""
        other = Corpus(self.documents, replace(self.p, **changes))
        if not changes.keys() & {"minfreq", "maxvocab", "period_is_whitespace"}:
            other.cut = self.cut
            if "known" in self.__dict__:
                other.known = self.known
        return other

    @cached_property
    def tokens(self) -> DataFrame:
        return tokenize(self.documents, self.p)

    @cached_property
    def counts(self) -> DataFrame:
        return vocab.word_counts(self.tokens)

    @cached_property
    def cut(self) -> DataFrame:
        """(w, freq) of the vocabulary, stored."""
        return cut_lineage(vocab.cut_counts(self.counts, self.p))

    @cached_property
    def size(self) -> int:
        return self.cut.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]

    @cached_property
    def vocab(self) -> DataFrame:
        """(w, idx, freq), stored."""
        return cut_lineage(vocab.ranked_vocab(self.cut))

    @cached_property
    def known(self) -> DataFrame:
        """(doc_id, pos, w, freq) of the tokens of the vocabulary."""
        return sampling.known_tokens(self.tokens, self.cut)

    @cached_property
    def kept(self) -> DataFrame:
        return sampling.surviving(self.known, self.size if self.p.subsample > 0 else 0, self.p)

    @cached_property
    def words(self) -> DataFrame:
        return windows.sentences(self.kept, self.p)

    def kept_once(self) -> Corpus:
        """This corpus with its kept words stored, for plans that read them more
        than once: pairs, events and counts then start from them."""
        self.words = cut_lineage(self.words)
        return self

    @cached_property
    def pairs(self) -> DataFrame:
        return windows.window_pairs(self.words, self.p)

    @cached_property
    def events(self) -> DataFrame:
        return windows.target_events(self.words)

    @cached_property
    def cells(self) -> DataFrame:
        """(w, c, cooc), stored."""
        return cut_lineage(cooc.cooc_cells(self.pairs))

    @cached_property
    def slots(self) -> DataFrame:
        return vocab.context_slots(self.cut, self.p)

    @cached_property
    def contexts(self) -> DataFrame:
        """(c, base_w, pos, idx, freq), stored; freq is the column total.  Pairs
        are counted for it where the cells have not been made."""
        if "cells" in self.__dict__:
            seen = cooc.col_totals(self.cells).withColumnRenamed("total", "freq")
            return cut_lineage(vocab.ranked_contexts(vocab.with_counts(self.slots, seen)))
        return cut_lineage(vocab.context_vocab(self.slots, self.pairs))

    @cached_property
    def noise(self) -> DataFrame:
        """(c, idx, q, cum_q), stored."""
        return cut_lineage(sampling.noise_table(self.contexts, self.p))

    @cached_property
    def draws(self) -> DataFrame:
        return sampling.SAMPLERS[self.p.sampler](self.events, self.noise, ["doc_id", "sent", "rn"], self.p)

    def scored(self, pairs: DataFrame | None = None, measure: str | None = None) -> DataFrame:
        """Cells, or pairs (w, c, cooc), with their association y."""
        return assoc.association(self.cells if pairs is None else pairs, self.cells, self.p, measure)

    def examples(self, scored: DataFrame) -> DataFrame:
        """(w_idx, c_idx, y, sampled) of what the process filter lets through."""
        rows = self.vocab.select("w", F.col("idx").alias("w_idx"))
        cols = self.contexts.select("c", F.col("idx").alias("c_idx"))
        kept = assoc.processed(scored, self.p).join(rows, "w").join(cols, "c")
        return kept.select("w_idx", "c_idx", "y", "sampled")

    def word_rows(self, listed: DataFrame | None = None) -> DataFrame:
        """(w_idx, ord, sw_idx): the matrix rows of every word."""
        return subword.word_subwords(self.vocab, self.n_words, self.p, listed)

    @cached_property
    def n_words(self) -> int:
        return self.vocab.count()

    def trained(self, examples, listed: DataFrame | None = None) -> train.Trained:
        hashed = self.p.minn >= 1 or listed is not None
        members = self.word_rows(listed).where("ord > 0").select("w_idx", F.col("sw_idx").alias("row")) if hashed else None
        n_rows = self.n_words + (self.p.buckets if hashed else 0)
        return train.train(examples, self.n_words, self.contexts.count(), self.p, members, n_rows)


def trained_em(c: Corpus, listed: DataFrame | None = None) -> train.Trained:
    """Noise is drawn once and spooled with the cells; every epoch passes the
    same lines in another order."""
    c.kept_once()
    lines = cut_lineage(c.examples(c.scored(cut_lineage(spool_of(c)))))
    return c.trained(lines, listed)


def spool_of(c: Corpus) -> DataFrame:
    """(w, c, cooc, sampled) of the corpus and its noise."""
    return cooc.spooled(c.pairs, c.draws)


def trained_on_spool(c: Corpus, spool: DataFrame, rows: DataFrame, cols: DataFrame, listed: DataFrame | None = None) -> train.Trained:
    """Vectors from a spool and totals made before; the corpus is not read.

    A word or context that the totals name and the vocabulary lacks is an
    error: the files then belong to different corpora."""
    strange = rows.join(c.cut, "w", "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"the totals name a word that the vocabulary lacks: {strange[0].w!r}")
    unknown = cols.join(c.slots, "c", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"the totals name a context that the vocabulary lacks: {unknown[0].c!r}")
    seen = cols.withColumnRenamed("total", "freq")
    c.contexts = cut_lineage(vocab.ranked_contexts(vocab.with_counts(c.slots, seen)))
    y = assoc.MEASURES[c.p.matrix](c.p)
    lines = cut_lineage(c.examples(assoc.with_given_totals(spool, rows, cols, c.p).withColumn("y", y)))
    return c.trained(lines, listed)


def trained_im(c: Corpus, listed: DataFrame | None = None) -> train.Trained:
    """Every epoch subsamples the corpus and draws noise anew; a pair that the
    stored cells lack counts as empty."""

    if c.p.subsample > 0:
        c.known = cut_lineage(c.known)
    c.kept_once()

    def epoch(it: int) -> DataFrame:
        again = c.under(seed=c.p.seed + 100 * (it + 1))
        if c.p.subsample > 0:
            again.kept_once()
        else:
            # Nothing is dropped, whatever the seed.
            again.words = c.words
        draws = sampling.SAMPLERS[again.p.sampler](again.events, c.noise, ["doc_id", "sent", "rn"], again.p)
        both = again.pairs.select("w", "c").unionByName(draws.select("w", "c"))
        counted = both.groupBy("w", "c").agg(F.count(F.lit(1)).alias("sampled"))
        scored = c.scored(cooc.cells_or_zero(counted, c.cells))
        table = cut_lineage(c.examples(scored))
        if again.words is not c.words:
            forget(again.words)
        return table

    return c.trained(epoch, listed)


def save(c: Corpus, result: train.Trained, path: str, binary: str | None = None, listed: DataFrame | None = None) -> None:
    """Tables of words, contexts and vectors under path.

    The binary model holds the rows as trained.  A word's vector is the mean
    of its rows; with model 2 its contexts' vectors are added; with model 0
    the contexts' vectors are written beside it.
    """
    spark = c.documents.sparkSession
    p = c.p
    words = c.vocab.select("w", "idx")
    if binary:
        names = (r.w for r in words.orderBy("idx").toLocalIterator())
        rows = result.rows(train.WORD, train.BUCKET)
        write_model_rows(binary, names, c.n_words, (r.v for r in rows.orderBy("row").toLocalIterator()), rows.count(), p)
    final = vectors.composed(c.word_rows(listed), result.rows(train.WORD, train.BUCKET), p.dim)
    word_vectors = words.join(final, words.idx == final.w_idx).select("w", "idx", "v")
    made = result.rows(train.CONTEXT)
    context_vectors = c.contexts.select("c", "idx").join(made, F.col("idx") == F.col("row")).select("c", "idx", "v")
    if p.model == 2:
        merged = vectors.merged_contexts(word_vectors.select("w", "v"), context_vectors.select("c", "v"), p.dim, p.positional)
        word_vectors = merged.join(words, "w").select("w", "idx", "v")
    c.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    c.contexts.write.mode("overwrite").parquet(f"{path}/contexts")
    word_vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    write_vectors(spark.read.parquet(f"{path}/vectors"), f"{path}/vectors.txt")
    if p.model == 0:
        context_vectors.write.mode("overwrite").parquet(f"{path}/context_vectors")
        write_vectors(spark.read.parquet(f"{path}/context_vectors"), f"{path}/vectors.txt.context", "c")


def run_im(documents: DataFrame, p: Params, path: str, binary: str | None = None, listed: DataFrame | None = None) -> train.Trained:
    c = Corpus(documents, p)
    result = trained_im(c, listed)
    save(c, result, path, binary, listed)
    return result


def run_em(documents: DataFrame, p: Params, path: str, binary: str | None = None, listed: DataFrame | None = None) -> train.Trained:
    c = Corpus(documents, p)
    result = trained_em(c, listed)
    save(c, result, path, binary, listed)
    return result


def demo(spark: SparkSession, documents: DataFrame, p: Params, path: str, words: int = 10, k: int = 5) -> DataFrame:
    """(w, place, other, cos): what lies nearest to the most frequent words, after
    training in memory on documents and writing everything under path."""
    run_im(documents, p, path)
    vocab_, made = spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = made.select("w", F.transform("v", lambda x: x / norm).alias("u"))
    asked = vocab_.where(F.col("w") != CONTEXT_BREAK).orderBy("idx").limit(words).select("w")
    # The words asked for are a handful; each vector meets all of them.
    first = unit.join(F.broadcast(asked), "w", "left_semi").select("w", F.col("u").alias("a"))
    cos = F.aggregate(F.zip_with("a", "u", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = unit.withColumnRenamed("w", "other").join(F.broadcast(first), F.col("w") != F.col("other")).withColumn("cos", cos)
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("cos"), "other"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("w", "place", "other", "cos").orderBy("w", "place")
