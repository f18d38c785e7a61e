"""Named queries over the core operators; their SQL is in plans.oracle."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.hashing import fnv1_32
from wordloom.operators import association as assoc
from wordloom.operators import cooc, sampling, subword, train, vectors, vocab, windows
from wordloom.operators.skew import word_line_totals
from wordloom.operators.tokenize import drop_unterminated, tokenize
from wordloom.params import Params
from wordloom.plans.oracle import ORACLE  # noqa: F401  (named by the entry)
from wordloom.plans.pipeline import Corpus, run_em, trained_em, trained_im
from wordloom.runtime import ensure_checkpoint_dir, read_table
from wordloom.sources import formats
from wordloom.sources.formats import vector_lines
from wordloom.streaming.embed import embed_stream

FLAGSHIP = "assoc_cpmi"

#: Settings of the queries: exact variants do not subsample.
P = Params(minfreq=5, window=2, subsample=0.0, negative=5, buckets=10_000, dim=64, seed=1)
HASHED = replace(P, subsample=1e-4)
PLAIN = replace(P, positional=False)
DIM = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text")


def _corpus(spark: SparkSession, d: str, p: Params = P) -> Corpus:
    return Corpus(_documents(spark, d), p)


# Tokens and sentences.


@query
def tokenize_default(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).tokens


@query
def tokenize_period_ws(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d, replace(P, period_is_whitespace=True)).tokens


@query
def tokenize_unterminated(spark: SparkSession, d: str) -> DataFrame:
    return drop_unterminated(tokenize(_documents(spark, d), P, terminated=False))


@query
def sentence_lengths(spark: SparkSession, d: str) -> DataFrame:
    words = windows.sentences(_corpus(spark, d).tokens, P)
    return words.groupBy("doc_id", "sent").agg(F.count(F.lit(1)).alias("n_words"))


@query
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    words = _corpus(spark, d, replace(P, max_sentence=20)).words
    return words.groupBy("doc_id", "sent", "chunk").agg(F.count(F.lit(1)).alias("n_words"), F.min("pos").alias("first_pos"))


# Vocabularies.


@query
def vocab_counts(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).counts


@query
def raw_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).tokens.agg(F.count(F.lit(1)).alias("n_tokens"))


@query
def vocab_minfreq(spark: SparkSession, d: str) -> DataFrame:
    return vocab.build_vocab(_corpus(spark, d).counts, P)


@query
def vocab_maxvocab(spark: SparkSession, d: str) -> DataFrame:
    return vocab.build_vocab(_corpus(spark, d).counts, replace(P, maxvocab=500))


@query
def vocab_ctxbreak_readded(spark: SparkSession, d: str) -> DataFrame:
    """Words that cut the break away: it comes back with freq 0, last."""
    counts = _corpus(spark, d).counts.where(F.col("w") != "</s>")
    return vocab.build_vocab(counts, replace(P, maxvocab=50))


@query
def corpus_size_build(spark: SparkSession, d: str) -> DataFrame:
    return vocab.corpus_size(_corpus(spark, d).counts, replace(P, maxvocab=500), "build")


@query
def corpus_size_stored(spark: SparkSession, d: str) -> DataFrame:
    return vocab.corpus_size(_corpus(spark, d).counts, replace(P, maxvocab=500), "stored")


@query
def oov_filter(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).kept


@query
def ctx_slots(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).slots


@query
def ctx_vocab_positional(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return vocab.context_vocab(c.slots, c.pairs)


@query
def ctx_vocab_plain(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d, PLAIN)
    return vocab.context_vocab(c.slots, c.pairs).drop("base_w", "pos")


@query
def ctx_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Contexts that the vocabulary lacks; none, as both come from one corpus."""
    c = _corpus(spark, d)
    return vocab.unknown_contexts(c.slots, c.pairs)


# Windows.


@query
def window_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).pairs.groupBy("doc_id", "sent", "w", "c").agg(F.count(F.lit(1)).alias("n"))


@query
def window_pairs_plain(spark: SparkSession, d: str) -> DataFrame:
    pairs = _corpus(spark, d, PLAIN).pairs
    return pairs.select("doc_id", "sent", "rn", "w", "c", "pos")


@query
def window_weighted(spark: SparkSession, d: str) -> DataFrame:
    pairs = _corpus(spark, d, replace(P, weight_window=True)).pairs
    return pairs.select("doc_id", "sent", "rn", "w", "c")


@query
def target_only_events(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).events.groupBy("w").agg(F.count(F.lit(1)).alias("n_events"))


# Co-occurrence.


def _cells(spark: SparkSession, d: str, p: Params = P) -> DataFrame:
    """Not stored: these queries read the cells once."""
    return cooc.cooc_cells(_corpus(spark, d, p).pairs)


@query
def cooc_positional(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query
def cooc_plain(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, PLAIN)


@query
def row_totals(spark: SparkSession, d: str) -> DataFrame:
    return cooc.row_totals(_cells(spark, d))


@query
def col_totals(spark: SparkSession, d: str) -> DataFrame:
    return cooc.col_totals(_cells(spark, d))


@query
def cds_total(spark: SparkSession, d: str) -> DataFrame:
    total = cooc.smoothed_total(cooc.col_totals(_cells(spark, d)), P.cds)
    return total.select(F.round("cds_total", 2).alias("cds_total"))


@query
def marginal_logs(spark: SparkSession, d: str) -> DataFrame:
    cols = cooc.col_totals(_cells(spark, d))
    log = F.ln(F.pow(F.col("total").cast("double"), F.lit(P.cds)))
    return cols.select("c", "total", F.round(log, 6).alias("log_total"))


def _other_draw(c: Corpus) -> DataFrame:
    """(w, c, cooc): the pairs of another draw of the corpus, looked up."""
    return cooc.cells_or_zero(c.under(seed=2).pairs.select("w", "c").distinct(), c.cells)


@query
def cooc_lookup_default0(spark: SparkSession, d: str) -> DataFrame:
    return _other_draw(_corpus(spark, d, HASHED))


@query
def cooc_sorted_index(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d, PLAIN)
    return cooc.indexed_cells(c.cells, c.vocab, c.contexts).orderBy("w_idx", "c_idx")


@query
def spool_estimate(spark: SparkSession, d: str) -> DataFrame:
    lines = F.col("total") * (1 + F.lit(P.negative / (2 * P.window)))
    total = _cells(spark, d).agg(F.sum("cooc").alias("total"))
    return total.select(
        "total", F.round(lines, 3).alias("lines"), F.round(lines * 28, 3).alias("peak_bytes"), F.round(lines * 12, 3).alias("final_bytes")
    )


# Association.


def _scored(spark: SparkSession, d: str, measure: str, p: Params = P) -> DataFrame:
    return _corpus(spark, d, p).scored(measure=measure)


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.select("w", "c", "cooc", (F.round("y", 6) + 0.0).alias("y"))


@query
def assoc_pmi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d, "pmi"))


@query
def assoc_cpmi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d, "cpmi"))


@query
def assoc_npmi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d, "npmi"))


@query
def assoc_nnegpmi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d, "nnegpmi"))


@query
def assoc_unseen(spark: SparkSession, d: str) -> DataFrame:
    """All measures on cells that may be empty: clip, -1 and -1 there."""
    c = _corpus(spark, d, HASHED)
    totals = assoc.with_totals(_other_draw(c), c.cells, HASHED)
    clipped = replace(HASHED, clip=-0.5)
    return totals.select(
        "w", "c", "cooc",
        *[(F.round(assoc.MEASURES[m](clipped), 6) + 0.0).alias(m) for m in ("cpmi", "npmi", "nnegpmi")],
    )


@query
def process_all(spark: SparkSession, d: str) -> DataFrame:
    return assoc.processed(_scored(spark, d, "npmi"), P).groupBy("w").agg(F.count(F.lit(1)).alias("n_cells"))


@query
def process_gt(spark: SparkSession, d: str) -> DataFrame:
    p = replace(P, process="gt", process_threshold=0.2500001)
    return assoc.processed(_scored(spark, d, "npmi"), p).groupBy("w").agg(F.count(F.lit(1)).alias("n_cells"))


@query
def process_leq(spark: SparkSession, d: str) -> DataFrame:
    p = replace(P, process="leq", process_threshold=0.2500001)
    return assoc.processed(_scored(spark, d, "npmi"), p).groupBy("w").agg(F.count(F.lit(1)).alias("n_cells"))


# Sampling.


def _sampling(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return c.cut.withColumn("corpus_size", F.lit(c.size))


@query
def subsample_prob(spark: SparkSession, d: str) -> DataFrame:
    p = sampling.subsample_p(F.col("freq"), F.col("corpus_size"), HASHED.subsample)
    return _sampling(spark, d).select("w", "freq", (F.round(p, 6) + 0.0).alias("p_drop"))


@query
def keep_prob(spark: SparkSession, d: str) -> DataFrame:
    p = sampling.keep_p(F.col("freq"), F.col("corpus_size"), HASHED.subsample)
    return _sampling(spark, d).select("w", (F.round(p, 6) + 0.0).alias("p_keep"))


@query
def subsampled_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d, HASHED).kept


@query
def noise_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d, PLAIN).noise


@query
def noise_draws(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d, PLAIN).kept_once().draws.select("doc_id", "sent", "rn", "k", "c")


@query
def negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d, PLAIN).kept_once().draws.groupBy("w", "c").agg(F.count(F.lit(1)).alias("n_draws"))


def _spool(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d, PLAIN).kept_once()
    return cooc.spooled(c.pairs, c.draws)


@query
def cooc_em_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _spool(spark, d)


@query
def cooc_em_replicate(spark: SparkSession, d: str) -> DataFrame:
    return cooc.replicated(_spool(spark, d)).groupBy("w").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("cooc").alias("sum_cooc"))


@query
def cooc_em_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return cooc.shuffled(cooc.replicated(_spool(spark, d)), ["w", "c", "k"], 9).select("place", "w", "c", "k", "cooc")


@query
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The rate at each tenth of a training of P.iterations epochs."""
    steps = spark.range(0, 10 * P.iterations + 1).select(F.col("id").alias("step"))
    rate = train.learning_rate_column(F.col("step") / (10.0 * P.iterations), P.alpha)
    return steps.select("step", F.round(rate, 9).alias("rate"))


# Subwords.


@query
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    words = _corpus(spark, d).cut.select("w")
    return subword.word_ngrams(words, P)


@query
def ngrams_codepoint(spark: SparkSession, d: str) -> DataFrame:
    words = _corpus(spark, d).cut.select("w")
    return subword.word_ngrams(words, replace(P, ngram_unit="char"))


@query
def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    words = _corpus(spark, d).cut.select("w")
    return words.select("w", fnv1_32(F.hex(F.encode("w", "UTF-8"))).alias("h"))


@query
def word_subwords(spark: SparkSession, d: str) -> DataFrame:
    words = _corpus(spark, d).vocab
    return subword.word_subwords(words, words.count(), P)


def _listed(words: DataFrame) -> DataFrame:
    """Lines as a subword file has them, here each word cut in two."""
    half = F.ceil(F.length("w") / 2).cast("int")
    line = F.concat_ws(" ", "w", F.substr("w", F.lit(1), half), F.substr("w", half + 1), F.concat(F.lit("<"), "w", F.lit(">")))
    return words.select(line.alias("value"))


@query
def subword_file(spark: SparkSession, d: str) -> DataFrame:
    words = _corpus(spark, d).cut.where(~F.col("w").contains(" "))
    indexed = words.select("w", F.xxhash64("w").alias("idx"))
    listed = subword.parsed_subword_lines(_listed(words))
    return subword.listed_subwords(indexed, listed).join(indexed.select(F.col("idx").alias("w_idx"), "w"), "w_idx").select("w", "ord", "sw")


# Vectors: rows of `embeddings` serve as matrix rows.


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("v"))


def _long(rows: DataFrame, key: str) -> DataFrame:
    out = vectors.components_of(rows, key, "v")
    return out.select(key, "d", (F.round("x", 6) + 0.0).alias("x"))


@query
def compose_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the rows of each label, as if they were a word's subwords."""
    rows = read_table(spark, d, "embeddings")
    parts = rows.select(F.col("label").cast("bigint").alias("w_idx"), F.lit(0).cast("bigint").alias("ord"), F.col("vec_id").alias("sw_idx"))
    return _long(vectors.composed(parts, _matrix(spark, d), DIM), "w_idx")


@query
def merge_context_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every row is a word's vector, and the vector of a context of the word
    whose number follows its own."""
    rows = _matrix(spark, d)
    n = rows.count()
    name = lambda x: F.concat(F.lit("word"), x.cast("string"))
    words = rows.select(name(F.col("row")).alias("w"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    position = F.when(F.col("row") % 2 == 1, "-1").otherwise("1")
    contexts = rows.select(F.concat_ws("_", name((F.col("row") + 1) % n), position).alias("c"), "v")
    return _long(vectors.merged_contexts(words, contexts, DIM, True), "w")


@query
def embed_words(spark: SparkSession, d: str) -> DataFrame:
    """Vectors for the benchmark's words: known rows and hashed subwords of a
    model whose words are the labels and whose rows are the embeddings."""
    matrix = _matrix(spark, d)
    labels = read_table(spark, d, "embeddings").select("label").distinct()
    words = labels.select(F.concat(F.lit("word"), F.col("label").cast("string")).alias("w"), F.col("label").cast("bigint").alias("idx"))
    asked = tokenize(read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), P).select("w")
    size = matrix.count()
    n = words.count()
    asked = asked.unionByName(words.select("w"))
    out = vectors.embedded(asked, words, matrix, n, DIM, replace(P, buckets=size - n))
    return _long(out, "w")


@query
def sgd_batch_gradient(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    words = rows.select(F.col("vec_id").alias("w_idx"), "v")
    contexts = rows.select(F.col("vec_id").alias("c_idx"), "v")
    examples = rows.select(
        F.col("vec_id").alias("w_idx"), F.explode(F.array(*[(F.col("vec_id") * k + 1) % rows.count() for k in (3, 7, 11)])).alias("c_idx")
    ).withColumn("y", (F.col("w_idx") % 5).cast("double"))
    grad = vectors.batch_gradient(examples, words, contexts)
    return grad.select("w_idx", "d", (F.round("grad", 6) + 0.0).alias("grad"))


@query
def vectors_text(spark: SparkSession, d: str) -> DataFrame:
    named = read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("idx"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("w"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )
    return vector_lines(named, "w")


@query
def init_vectors(spark: SparkSession, d: str) -> DataFrame:
    keys = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row"))
    return _long(vectors.initial_vectors(keys, 8, 4), "row")


# Training.

TRAIN = Params(minfreq=20, window=2, subsample=0.0, negative=2, minn=0, dim=16, iterations=2, positional=False)


def _losses(spark: SparkSession, result: train.Trained) -> DataFrame:
    rows = [(i, float(x)) for i, x in enumerate(result.losses)]
    return spark.createDataFrame(rows, "iteration bigint, half_sq_loss double")


@query
def train_im(spark: SparkSession, d: str) -> DataFrame:
    return _losses(spark, trained_im(_corpus(spark, d, TRAIN)))


@query
def train_em(spark: SparkSession, d: str) -> DataFrame:
    return _losses(spark, trained_em(_corpus(spark, d, TRAIN)))


def _tiny_examples(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    rows = read_table(spark, d, "embeddings")
    n = rows.count()
    word, context = F.col("vec_id"), (F.col("vec_id") * 7 + 1) % n
    y = F.col("embedding")[0].cast("double") * 4
    return rows.select(word.alias("w_idx"), context.alias("c_idx"), y.alias("y"), F.lit(1).cast("bigint").alias("copy")), n


@query
def train_full_batch(spark: SparkSession, d: str) -> DataFrame:
    """Losses of two epochs of the training itself where a batch holds all
    examples: before any step, and after one of the whole gradient."""
    examples, n = _tiny_examples(spark, d)
    p = Params(dim=4, iterations=2, batch=1 << 30, alpha=0.5, minn=0, workers=1)
    losses = train.train(examples, n, n, p).losses
    return spark.createDataFrame([(i, round(x, 9)) for i, x in enumerate(losses)], "iteration bigint, half_sq_loss double")


@query
def train_full_batch_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Word vectors after one such epoch."""
    examples, n = _tiny_examples(spark, d)
    p = Params(dim=4, iterations=1, batch=1 << 30, alpha=0.5, minn=0, workers=1)
    return _long(train.train(examples, n, n, p).rows(train.WORD), "row")


# Files: written to the shared folder, read back.


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query
def file_vocab(spark: SparkSession, d: str) -> DataFrame:
    path, words = _folder(spark), _corpus(spark, d).vocab
    formats.write_counts(words, path, "w", "freq", [F.col("idx")])
    return formats.read_counts(spark, path)


@query
def file_totals(spark: SparkSession, d: str) -> DataFrame:
    path, totals = _folder(spark), cooc.row_totals(_cells(spark, d))
    formats.write_counts(totals, path, "w", "total", [F.desc("total"), F.col("w")])
    return formats.read_counts(spark, path).withColumnRenamed("freq", "total")


@query
def file_spool(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the stored runs as binary records and back."""
    path = _folder(spark)
    lines = read_table(spark, d, "cooc_line").where("w_idx is not null and c_idx is not null and cooc > 0")
    formats.write_spool(lines.select("w_idx", "c_idx", "cooc"), path)
    return formats.read_spool(spark, path).groupBy("w_idx", "c_idx").agg(F.sum("cooc").alias("cooc"), F.count(F.lit(1)).alias("n_lines"))


@query
def file_vectors(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _folder(spark), _matrix(spark, d)
    named = rows.select(F.col("row").alias("idx"), F.concat(F.lit("w"), F.col("row").cast("string")).alias("w"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    formats.write_vectors(named, path)
    return _long(formats.read_vectors(spark, path), "w")


@query
def file_merge(spark: SparkSession, d: str) -> DataFrame:
    """Text vectors of words and of twice as many contexts, merged as files."""
    path, rows = _folder(spark), _matrix(spark, d)
    wide = F.transform("v", lambda x: x.cast("double"))
    named = rows.select(F.col("row").alias("idx"), F.concat(F.lit("w"), F.col("row").cast("string")).alias("w"), wide.alias("v"))
    both = named.crossJoin(spark.createDataFrame([("-1",), ("1",)], "k string"))
    formats.write_vectors(named, f"{path}/w")
    formats.write_vectors(both.select("idx", F.concat_ws("_", "w", "k").alias("c"), "v"), f"{path}/c", "c")
    formats.merge_vector_files(spark, f"{path}/w", f"{path}/c", f"{path}/out")
    return _long(formats.read_vectors(spark, f"{path}/out"), "w")


@query
def file_selected_output(spark: SparkSession, d: str) -> DataFrame:
    """Which files each output model writes: 0 words and contexts apart, 1 words
    only, 2 their sum; and the values in the sum."""
    rows = []
    nothing = spark.createDataFrame([(1, "a b a b a b")], "doc_id bigint, text string")
    for model in (0, 1, 2):
        path = _folder(spark)
        p = Params(minfreq=1, subsample=0.0, negative=1, minn=0, dim=2, iterations=1, model=model, positional=False)
        run_em(nothing, p, path)
        for name in ("vectors.txt", "vectors.txt.context"):
            try:
                n = spark.read.text(f"{path}/{name}").count()
            except AnalysisException:
                n = 0
            rows.append((model, name, n))
    return spark.createDataFrame(rows, "model bigint, name string, n_lines bigint")


def _model_file(spark: SparkSession, d: str, words: int) -> str:
    """A binary model of the first rows as words and the others as buckets, in
    a folder that all workers reach."""
    rows = read_table(spark, d, "embeddings").select("vec_id", "embedding").orderBy("vec_id")
    folder = _folder(spark)
    path = folder.removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    p = replace(P, minn=3, maxn=6)
    formats.write_model_rows(f"{path}/model.bin", (f"word{k}" for k in range(words)), words, (r.embedding for r in rows.toLocalIterator()), rows.count(), p)
    return f"{path}/model.bin"


@query
def file_model(spark: SparkSession, d: str) -> DataFrame:
    """A binary model written and read back."""
    m = formats.read_model(_model_file(spark, d, 10))
    names = [*m.words, *[None] * m.buckets]
    rows = [(k, w, [float(x) for x in v]) for k, (w, v) in enumerate(zip(names, m.matrix))]
    return _long(spark.createDataFrame(rows, "row bigint, w string, v array<double>"), "row")


@query
def embed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's words by a model file: a known word, and words of hashed
    n-grams, as lines of a stream have them."""
    asked = tokenize(read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), P).select("w").distinct()
    lines = asked.unionByName(spark.range(10).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("w")))
    return _long(embed_stream(lines.select(F.col("w").alias("value")), _model_file(spark, d, 10)), "w")


@query
def embed_listed(spark: SparkSession, d: str) -> DataFrame:
    """Words with subwords of their own, which take the place of n-grams."""
    asked = tokenize(read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), P).select("w").distinct()
    given = asked.where(F.length("w") > 1).select("w", F.array(F.substring("w", 1, 1), F.expr("substr(w, 2)")).alias("subwords"))
    words = spark.range(10).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("w"), F.col("id").alias("idx"))
    matrix = _matrix(spark, d)
    return _long(vectors.embedded(given, words, matrix, 10, DIM, replace(P, buckets=matrix.count() - 10)).drop("subwords"), "w")


@query
def subword_list_check(spark: SparkSession, d: str) -> DataFrame:
    """Words of the vocabulary that a subword list lacks, and its bad lines."""
    words = _corpus(spark, d).vocab
    lines = words.select(F.when(F.length("w") > 3, F.concat_ws(" ", "w", F.substring("w", 1, 2))).otherwise(F.col("w")).alias("value"))
    lacking = subword.unlisted_words(words, subword.parsed_subword_lines(lines)).select("w", F.lit("unlisted").alias("fault"))
    return lacking.unionByName(subword.malformed_subword_lines(lines).select(F.col("value").alias("w"), F.lit("malformed").alias("fault")))


# Stored runs.


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "cooc_line")
    rows = lines.count()
    return word_line_totals(lines, total=rows).where(F.col("n_rows") * 100 >= rows).select("w_idx")


@query
def p6_word_totals(spark: SparkSession, d: str) -> DataFrame:
    return word_line_totals(read_table(spark, d, "cooc_line"))
