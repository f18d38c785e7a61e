"""Frequent values, pairs, n-gram counts and context scores."""

import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wordloom.llm import distinctive, frequent, ngrams, pairs, queries

T0 = datetime(2024, 1, 1)
SLICES = "slice_id bigint, corpus_id bigint, w string, freq bigint, counted_at timestamp, arrived_at timestamp, gram string"
LINES = "corpus_id bigint, run_no bigint, w_idx bigint, c_idx bigint, cooc bigint, sampled bigint, n bigint, ab string"


def slices(n=3000, seed=1):
    """A third of the rows hold one word; some are stale, repeated or null."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        w = "hot" if r.random() < 0.34 else None if r.random() < 0.02 else f"w{int(r.paretovariate(0.7)) % 400}"
        freq = r.choice([None, -1, 0, 1, 2, 3, 50])
        rows.append((r.randrange(40), 1, w, freq, T0 + timedelta(seconds=r.randrange(5)), T0, "extra"))
    return rows + rows[:100]


def counting(rows):
    best = {}
    for s, _, w, freq, at, *_ in rows:
        if w is not None and freq is not None and freq > 0:
            best[s, w] = max(best.get((s, w), (T0, 0)), (at, freq))
    return {k: f for k, (_, f) in best.items()}


@pytest.fixture(scope="module")
def slice_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("slices"))
    spark.createDataFrame(slices(), SLICES).write.parquet(f"{d}/word_slice.parquet")
    return d


def test_frequent(spark, slice_dir):
    sums = Counter()
    for (_, w), f in counting(slices()).items():
        sums[w] += f
    got = [(r.w, r.freq) for r in queries.p1_top_words(spark, slice_dir).collect()]
    assert got == sorted(sums.items(), key=lambda x: (-x[1], x[0].encode()))[:1000]
    total = sum(sums.values())
    assert {r.w for r in queries.p1_found(spark, slice_dir).collect()} == {w for w, f in sums.items() if f * 1000 >= total}


def test_p5_is_selected_by_score(spark, sf_dir):
    plan = queries.p5_found(spark, sf_dir)._jdf.queryExecution()
    assert "LOG2" in plan.optimizedPlan().toString().upper()
    found = {tuple(r) for r in queries.p5_found(spark, sf_dir).collect()}
    scored = queries.p5_context_scores(spark, sf_dir).collect()
    of_found = [r.score for r in scored if (r.corpus_id, r.w_idx, r.c_idx) in found]
    # Twice the bound is left as a margin, and most cells are below it.
    assert len(of_found) == len(found) and min(of_found) >= 1.5 * queries.P5_SCORE
    assert sum(r.score < queries.P5_SCORE for r in scored) > 0.5 * len(scored)
    # All readings of the lines ask for the same columns, so they are one.
    read = set(re.findall(r"ReadSchema: (struct<.*c_idx.*>)", spark._jvm.PythonSQLUtils.explainString(plan, "formatted")))
    assert len(read) == 1


def test_frequent_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("é", 1), ("Z", 1), (None, 9), ("c", None), ("", 1)], "w string, n bigint")
    assert [r.w for r in frequent.most_frequent(df, "w", "n", 3).collect()] == ["", "Z", "a"]
    assert frequent.most_frequent(df.where("n > 10"), "w", "n", 3).count() == 0
    assert frequent.values_above_share(df.where("n > 10"), "w", "n", 10).count() == 0
    assert {r.w for r in frequent.values_above_share(df, "w", "n", 5).collect()} == {"", "Z", "a", "b", "é"}


def test_terms(spark, slice_dir):
    kept = counting(slices())
    freq, held = Counter(), defaultdict(set)
    for (s, w), f in kept.items():
        freq[w] += f
        held[w].add(s)
    n = len({s for s, _ in kept})
    mark = {w: "rare" if len(x) < 3 else "common" if len(x) * 5 >= 2 * n else None for w, x in held.items()}
    got = queries.p3_term_counts(spark, slice_dir).collect()
    assert {r.w: (r.freq, r.n_slices, r.mark) for r in got} == {w: (freq[w], len(held[w]), mark[w]) for w in freq}
    assert {(r.w, r.mark) for r in queries.p3_found(spark, slice_dir).collect()} == {(w, m) for w, m in mark.items() if m}


def grams_of(records, max_len):
    freq, held = Counter(), defaultdict(set)
    for rec, terms, weight in records:
        terms = [t for t in terms if t is not None]
        for i in range(len(terms)):
            for n in range(1, max_len + 1):
                if i + n <= len(terms):
                    g = ngrams.SEP.join(terms[i : i + n])
                    freq[g] += weight
                    held[g].add(rec)
    return {g: (freq[g], len(held[g])) for g in freq}


@pytest.mark.parametrize("max_len", [1, 2, 3])
@pytest.mark.parametrize("share", [1.0, 0.02])
def test_ngrams(spark, max_len, share):
    r = random.Random(2)
    vocabulary = ["the"] * 6 + list("abcdefgh") + ["", "a\x02", "\x7f"]
    records = [(r.randrange(60), [r.choice(vocabulary) for _ in range(r.randrange(12))] + [None] * (r.random() < 0.1), r.randrange(1, 4)) for _ in range(300)]
    df = spark.createDataFrame(records + [(None, ["a"], 1), (1, None, 1), (1, ["a"], None)], "id bigint, terms array<string>, weight bigint").withColumn("first", F.lit("clash"))
    got = ngrams.ngram_counts(df, "id", "terms", max_len, "weight", share)
    rows = got.collect()
    assert len(rows) == len({x.gram for x in rows})
    assert {x.gram: (x.freq, x.n_records) for x in rows} == grams_of(records, max_len)


def test_many_warm_terms(spark):
    """300 terms of 0.3 % each: none is held up by its neighbours."""
    n = 90_000
    df = spark.range(n).select((F.col("id") % 997).alias("id"), F.array(F.concat(F.lit("t"), (F.col("id") % 300).cast("string"))).alias("terms"), F.lit(1).alias("weight"))
    got = ngrams.ngram_counts(df, "id", "terms", 1, "weight").collect()
    assert len(got) == 300 and {r.freq for r in got} == {n // 300} and all(r.n_records <= 300 for r in got)


def test_stack_keeps_no_records():
    """A term in very many records, in many batches, is counted as it passes."""
    import numpy as np
    import pyarrow as pa

    def batches():
        for k in range(200):
            ids = np.repeat(np.arange(k * 1000, (k + 1) * 1000), 2)
            yield pa.RecordBatch.from_arrays([pa.array(["x"] * 2000), pa.array(ids // 3), pa.array(np.ones(2000, np.int64))], names=["s", "r", "w"])

    for count in (ngrams._count_terms, ngrams._count_sorted):
        (got,) = [r for b in count(batches()) for r in b.to_pylist()]
        assert got == {"gram": "x", "freq": 400_000, "n_records": len(np.unique(np.arange(200_000) // 3))}


def test_separator_in_a_term(spark):
    df = spark.createDataFrame([(1, ["a\x01b"]), (2, ["a", "b"])], "id bigint, terms array<string>")
    assert {r.gram: r.freq for r in ngrams.ngram_counts(df, "id", "terms", 1).collect()} == {"a\x01b": 1, "a": 1, "b": 1}


def test_ngrams_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, terms array<string>")
    assert ngrams.ngram_counts(df, "id", "terms", 3).count() == 0


def test_ngrams_of_a_long_record(spark):
    df = spark.createDataFrame([(1, ["x"] * 50_000 + ["y"])], "id bigint, terms array<string>")
    got = {r.gram: (r.freq, r.n_records) for r in ngrams.ngram_counts(df, "id", "terms", 2).collect()}
    assert got == {"x": (50_000, 1), "y": (1, 1), "x\x01x": (49_999, 1), "x\x01y": (1, 1)}


def lines(seed=3):
    r = random.Random(seed)
    out = []
    for _ in range(4000):
        w = 0 if r.random() < 0.34 else r.randrange(1, 30)
        c = None if r.random() < 0.05 else r.randrange(30)
        out.append((r.choice([1, 2]), r.randrange(4), w, c, r.choice([0, 1, 2, 30]), 1, 7, "x"))
    return out + out[:300] + [(1, 1, None, 2, 5, 1, 7, "x"), (1, 1, 2, 3, None, 1, 7, "x"), (None, 1, 1, 2, 3, 1, 7, "x"), (None, None, 2, 1, 3, 1, 7, "x")]


def cells(rows):
    once, out = {}, Counter()
    for k, run, w, c, n, *_ in rows:
        if w is not None and c is not None and n:
            once[k, run, w, c] = max(once.get((k, run, w, c), 0), n)
    for (k, _, w, c), n in once.items():
        out[k, w, c] += n
    return out


def test_pairs(spark):
    cell = cells(lines())
    t, total = Counter(), Counter()
    for (k, w, _), n in cell.items():
        t[k, w] += n
        total[k] += n
    df = spark.createDataFrame(lines(), LINES)
    got = {(r.corpus_id, r.idx_a, r.idx_b): (r.n, r.t_a, r.t_b, r.total) for r in pairs.pair_association(df).collect()}
    assert got == {(k, a, b): (n, t[k, a], t[k, b], total[k]) for (k, a, b), n in cell.items() if a < b}
    found = pairs.pairs_above_chance(df, 2, 1).collect()
    assert {(r.corpus_id, r.idx_a, r.idx_b) for r in found} == {
        (k, a, b) for (k, a, b), n in cell.items() if a < b and n >= 2 and n * total[k] >= t[k, a] * t[k, b]
    }
    one = next(r for r in found if r.t_b)
    assert one.lift == pytest.approx(one.n * one.total / (one.t_a * one.t_b)) and one.pmi == pytest.approx(math.log(one.lift))


def test_pairs_with_huge_counts(spark):
    big = 2**40
    rows = [(1, 1, a, b, big, 1, 7, "x") for a, b in ((0, 1), (1, 0), (2, 3), (3, 2))]
    assert pairs.pairs_above_chance(spark.createDataFrame(rows, LINES), 1, 4).count() == 2
    assert pairs.pairs_above_chance(spark.createDataFrame(rows, LINES), 1, 5).count() == 0


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], LINES)
    assert pairs.pair_association(df).count() == 0
    assert distinctive.context_scores(df).count() == 0


def test_scores(spark):
    cell = cells(lines())
    t, f, df_, targets = Counter(), Counter(), Counter(), defaultdict(set)
    for (k, w, c), n in cell.items():
        t[k, w] += n
        f[k, c] += n
        df_[k, c] += 1
        targets[k].add(w)
    got = distinctive.context_scores(spark.createDataFrame(lines(), LINES)).collect()
    assert len(got) == len(cell)
    for r in got:
        k = r.corpus_id
        n_targets = len(targets[k])
        mean_t = sum(t[k, w] for w in targets[k]) / n_targets
        lam = f[k, r.c_idx] / n_targets
        tfn = r.n * math.log2(1 + mean_t / t[k, r.w_idx])
        score = (math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (1 + tfn)
        assert (r.n, r.t, r.df, r.f, r.n_targets) == (cell[k, r.w_idx, r.c_idx], t[k, r.w_idx], df_[k, r.c_idx], f[k, r.c_idx], n_targets)
        assert r.score == pytest.approx(score)


def test_rare_contexts_score_higher(spark):
    rows = [(1, 1, w, 0, 10, 1, 7, "x") for w in range(20)] + [(1, 1, 0, 1, 10, 1, 7, "x"), (1, 1, 1, 2, 10, 1, 7, "x")]
    got = {(r.w_idx, r.c_idx): r.score for r in distinctive.context_scores(spark.createDataFrame(rows, LINES)).collect()}
    assert got[0, 1] > 2 * got[0, 0]


def test_frequent_targets(spark):
    words = spark.createDataFrame(
        [(1, 0, None, 9, T0), (1, 0, "a", 2, T0 + timedelta(1)), (1, 1, None, 7, T0), (1, 1, "b", 7, T0), (2, 0, "a", 1, None), (3, 0, "a", 99, T0), (1, 2, "c", None, T0)],
        "corpus_id bigint, idx bigint, w string, freq bigint, counted_at timestamp",
    )
    corpora = spark.createDataFrame([(1, 5), (2, 1), (4, None)], "corpus_id bigint, minfreq bigint")
    got = distinctive.frequent_targets(words, corpora).collect()
    assert sorted((r.corpus_id, r.w_idx) for r in got) == [(1, 1), (2, 0)]
