"""Command line: the stages of the pipeline, one by one or in a row.

    python -m wordloom vocab   --corpus TEXT --vocab DIR [settings]
    python -m wordloom train   --corpus TEXT --vocab DIR --output DIR [settings]
    python -m wordloom cooc    --corpus TEXT --vocab DIR --cooc DIR [settings]
    python -m wordloom trainem --vocab DIR --cooc DIR --output DIR [settings]
    python -m wordloom im|em   --corpus TEXT --output DIR [settings]
    python -m wordloom embed   --model FILE --words TEXT --output DIR
    python -m wordloom demo    --corpus TEXT --output DIR [settings]
    python -m wordloom merge   --vectors PATH --contexts PATH --output PATH

Settings are the fields of Params, written --like-this.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import cooc
from wordloom.operators.subword import parsed_subword_lines, unlisted_words
from wordloom.params import Params
from wordloom.plans import pipeline
from wordloom.sources import formats
from wordloom.streaming.embed import before_blank, embed_stream

log = logging.getLogger("wordloom")
STAGES = ("vocab", "train", "cooc", "trainem", "im", "em", "embed", "merge", "demo")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="wordloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("stage", choices=STAGES)
    for name in ("corpus", "vocab", "cooc", "output", "binary", "subword", "model-file", "words", "vectors", "contexts"):
        out.add_argument(f"--{name}", default="")
    out.add_argument("--until-blank", action="store_true", help="embed: stop at the first empty line")
    out.add_argument("--verbose", type=int, default=1, choices=(0, 1, 2), help="errors, progress, details")
    for f in fields(Params):
        kind = type(f.default)
        flag = f"--{f.name.replace('_', '-')}"
        if kind is bool:
            out.add_argument(flag, type=lambda x: x.lower() in ("1", "true", "yes"), default=f.default)
        else:
            out.add_argument(flag, type=kind, default=f.default)
    return out


def need(args: argparse.Namespace, *names: str) -> list[str]:
    missing = [n for n in names if not getattr(args, n)]
    if missing:
        raise SystemExit("needed: " + ", ".join(f"--{n.replace('_', '-')}" for n in missing))
    return [getattr(args, n) for n in names]


def listed_subwords(spark: SparkSession, args: argparse.Namespace, vocab: DataFrame) -> DataFrame | None:
    """The subword file; n-grams take precedence over it."""
    if not args.subword or args.minn >= 1:
        return None
    listed = parsed_subword_lines(spark.read.text(args.subword))
    lacking = unlisted_words(vocab, listed).limit(1).collect()
    if lacking:
        raise SystemExit(f"the subword file lacks a word: {lacking[0].w!r}")
    return listed


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    p = Params(**{f.name: getattr(args, f.name) for f in fields(Params)})
    if args.stage == "embed":
        model, words, output = need(args, "model_file", "words", "output")
        lines = spark.read.text(words)
        found = embed_stream(before_blank(lines) if args.until_blank else lines, model, p.ngram_unit)
        text = F.array_join(F.transform("v", lambda x: F.format_string("%.6f", x)), " ")
        found.select(F.concat_ws(" ", "w", text).alias("value")).write.mode("overwrite").text(output)
        return
    if args.stage == "demo":
        corpus, output = need(args, "corpus", "output")
        for r in pipeline.demo(spark, formats.read_corpus(spark, corpus), p, output).collect():
            print(f"{r.w}\t{r.place}\t{r.other}\t{r.cos:.3f}")
        return
    if args.stage == "merge":
        lacking = formats.merge_vector_files(spark, *need(args, "vectors", "contexts", "output"))
        log.info("words without context vectors: %d", lacking)
        return
    if args.stage == "trainem":
        vocab, spool, output = need(args, "vocab", "cooc", "output")
        nothing = spark.createDataFrame([], "doc_id bigint, text string")
        c = pipeline.Corpus(nothing, p, formats.read_counts(spark, vocab))
        totals = [formats.read_counts(spark, f"{spool}/{part}").withColumnRenamed("freq", "total") for part in ("rows", "cols")]
        listed = listed_subwords(spark, args, c.vocab)
        result = pipeline.trained_on_spool(c, spark.read.parquet(f"{spool}/lines"), totals[0], totals[1].withColumnRenamed("w", "c"), listed)
        pipeline.save(c, result, output, args.binary or None, listed)
    else:
        (corpus,) = need(args, "corpus")
        known = formats.read_counts(spark, *need(args, "vocab")) if args.stage in ("train", "cooc") else None
        c = pipeline.Corpus(formats.read_corpus(spark, corpus), p, known)
        if args.stage == "vocab":
            (out,) = need(args, "vocab")
            formats.write_counts(c.vocab, out, "w", "freq", [F.col("idx")])
            formats.write_counts(c.contexts, f"{out}.context", "c", "freq", [F.col("idx")])
            log.info("vocabulary of %d words, %d contexts", c.vocab.count(), c.contexts.count())
            return
        if args.stage == "cooc":
            (out,) = need(args, "cooc")
            total = c.cells.agg(F.sum("cooc")).first()[0] or 0
            log.info("expected spool: %s", cooc.spool_estimate(total, p))
            pipeline.spool_of(c).write.mode("overwrite").parquet(f"{out}/lines")
            formats.write_counts(cooc.row_totals(c.cells), f"{out}/rows", "w", "total", [F.desc("total"), F.col("w")])
            formats.write_counts(cooc.col_totals(c.cells), f"{out}/cols", "c", "total", [F.desc("total"), F.col("c")])
            return
        (output,) = need(args, "output")
        listed = listed_subwords(spark, args, c.vocab)
        result = (pipeline.trained_em if args.stage == "em" else pipeline.trained_im)(c, listed)
        pipeline.save(c, result, output, args.binary or None, listed)
    log.debug("losses: %s", result.losses)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=(logging.ERROR, logging.INFO, logging.DEBUG)[args.verbose], format="%(message)s")
    spark = SparkSession.builder.appName(f"wordloom {args.stage}").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
