"""Small cases with figures worked out by hand."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions.hashing import fnv1_32
from wordloom.operators import association, cooc, sampling, subword, train, vectors, vocab, windows
from wordloom.operators.ordered import ranked
from wordloom.operators.tokenize import drop_unterminated, tokenize
from wordloom.params import Params
from wordloom.runtime import cut_lineage

P = Params(minfreq=1, window=2, subsample=0.0, cds=0.75)
BREAK = "</s>"
F1 = "the cat sat. the dog sat .\nthe cat ran\n"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def words_of(spark, text, p=P, terminated=False):
    return [r.w for r in tokenize(docs(spark, text), p, terminated).orderBy("pos").collect()]


TEXT = ".5 foo.bar baz. .\nx\u00a0y\u3000z...w \r\n\n end. a..b"


def test_tokens(spark):
    assert words_of(spark, TEXT) == [BREAK, "5", "foo.bar", "baz.", BREAK, BREAK, "x", "y", "z...w", BREAK, BREAK, "end.", "a..b"]
    spaced = words_of(spark, TEXT, replace(P, period_is_whitespace=True))
    assert spaced == ["</s>", "5", "foo", BREAK, "bar", "baz", BREAK, BREAK, BREAK, "x", "y", "z", BREAK, BREAK, BREAK, "w", BREAK, BREAK, "end", BREAK, "a", BREAK, BREAK, "b"]


def test_white_space_is_not_regex_space(spark):
    near = "a\u180eb\u200bc\ufeffd\x1ce"
    assert words_of(spark, near) == [near]
    assert words_of(spark, "a\u0085b\u2028c\u202fd\u205fe\x0bf\x0cg") == list("abcdefg")


def test_no_tokens(spark):
    rows = tokenize(docs(spark, None, "", "  "), P)
    assert [(r.doc_id, r.w) for r in rows.orderBy("doc_id").collect()] == [(1, BREAK), (2, BREAK)]
    assert tokenize(docs(spark, None), P).count() == 0


def test_very_long_text(spark):
    assert tokenize(docs(spark, "word " * 200_000), P).count() == 200_001


def f1(spark, p=P):
    tokens = tokenize(docs(spark, F1), p, terminated=False)
    words = windows.sentences(tokens, p)
    return tokens, words, windows.window_pairs(words, p)


def test_vocab_order(spark):
    tokens, _, _ = f1(spark)
    rows = vocab.build_vocab(vocab.word_counts(tokens), P).orderBy("idx").collect()
    assert [(r.w, r.freq) for r in rows] == [(BREAK, 3), ("the", 3), ("cat", 2), ("dog", 1), ("ran", 1), ("sat", 1), ("sat.", 1)]
    cut = vocab.build_vocab(vocab.word_counts(tokens), replace(P, minfreq=4)).collect()
    assert [(r.w, r.idx, r.freq) for r in cut] == [(BREAK, 0, 0)]


def test_both_ways_to_cut(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{i}", 1 + i % 7) for i in range(50)] + [(BREAK, 5)], "w string, freq bigint")
    p = replace(P, maxvocab=12)
    few = sorted(vocab.cut_counts(counts, p).collect())
    monkeypatch.setattr(vocab, "TOP_ROWS", 3)
    assert sorted(vocab.cut_counts(counts, p).collect()) == few and len(few) == 13


def by_state(text, period):
    """Tokens by walking the characters."""
    white = set("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
    out, word = [], ""
    for ch in text:
        ends = ch in white or (period and ch == ".")
        if word and not ends:
            word += ch
            continue
        if word:
            out.append(word)
            word = ""
        if ch == "\n" or ch == ".":
            out.append(BREAK)
        elif not ends:
            word = ch
    return out + [word] * bool(word)


@pytest.mark.parametrize("period", [False, True])
def test_tokens_of_random_texts(spark, period):
    import random

    r = random.Random(6)
    pool = list("ab.\n \t\x0b\x0c\r\x85\xa0\u1680\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\u180e\x1c") + ["é", "😀", "字", "</s>", "'", "\\", "$1"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(400)]
    p = replace(P, period_is_whitespace=period)
    got = {i: [] for i in range(len(texts))}
    for row in tokenize(docs(spark, *texts), p, terminated=False).orderBy("doc_id", "pos").collect():
        got[row.doc_id].append(row.w)
    for i, t in enumerate(texts):
        assert got[i] == by_state(t, period), repr(t)


def test_cells_and_totals(spark):
    _, _, pairs = f1(spark)
    cells = cooc.cooc_cells(pairs)
    got = {(r.w, r.c): r.cooc for r in cells.collect()}
    assert sum(got.values()) == 24 and len(got) == 22
    assert {k for k, v in got.items() if v == 2} == {("cat", "the_-1"), ("the", "cat_1")}
    assert {r.w: r.total for r in cooc.row_totals(cells).collect()} == {"cat": 5, "dog": 3, "ran": 2, "sat": 2, "sat.": 4, "the": 8}
    cols = {r.c: r.total for r in cooc.col_totals(cells).collect()}
    assert cols["the_-1"] == 3 and cols["the_-2"] == 3 and cols["cat_1"] == 2 and len(cols) == 18
    assert cooc.smoothed_total(cooc.col_totals(cells), 0.75).first()[0] == pytest.approx(21.922599774924414)


def test_association(spark):
    _, _, pairs = f1(spark)
    cells = cooc.cooc_cells(pairs)
    scored = association.with_totals(cells, cells, P)
    rows = scored.select("w", "c", *[f(P).alias(m) for m, f in association.MEASURES.items()]).collect()
    got = {(r.w, r.c): r for r in rows}
    for key, pmi, npmi in [(("cat", "the_-1"), 1.347268, 0.562681), (("the", "cat_1"), 1.181363, 0.493392), (("sat", "dog_-1"), 2.394371, 0.775500), (("the", "dog_1"), 1.008077, 0.326501)]:
        assert got[key].pmi == pytest.approx(pmi, abs=1e-6)
        assert got[key].cpmi == got[key].nnegpmi == got[key].pmi
        assert got[key].npmi == pytest.approx(npmi, abs=1e-6)
    empty = spark.createDataFrame([("cat", "the_-1", 0)], "w string, c string, cooc bigint")
    r = association.with_totals(empty, cells, P).select(*[f(replace(P, clip=-2.0)).alias(m) for m, f in association.MEASURES.items()]).first()
    assert (r.pmi, r.cpmi, r.npmi, r.nnegpmi) == (None, -2.0, -1.0, -1.0)


def test_plain_windows_are_symmetric(spark):
    _, _, pairs = f1(spark, replace(P, positional=False))
    got = {(r.w, r.c): r.cooc for r in cooc.cooc_cells(pairs).collect()}
    assert got["cat", "the"] == 3 and got["the", "sat."] == 2 and len(got) == 18
    assert all(got[b, a] == n for (a, b), n in got.items())


def test_mirror_of_positions(spark, sf_dir):
    from wordloom.plans import queries

    cells = queries._corpus(spark, sf_dir).pairs.groupBy("w", "base_w", "pos").count()
    mirror = cells.select(F.col("base_w").alias("w"), F.col("w").alias("base_w"), (-F.col("pos")).alias("pos"), "count")
    assert cells.exceptAll(mirror).count() == 0


def test_unterminated_end_is_dropped(spark):
    tokens = drop_unterminated(tokenize(docs(spark, F1.rstrip("\n")), P, terminated=False))
    words = windows.sentences(tokens, P)
    assert windows.window_pairs(words, P).count() == 18


def test_chunks_end_windows(spark):
    p = replace(P, max_sentence=3)
    words = windows.sentences(tokenize(docs(spark, "a b c d e"), p), p)
    assert windows.window_pairs(words, p).count() == 8
    assert windows.target_events(words).count() == 5


def test_weighted_window_is_narrower(spark):
    words = windows.sentences(tokenize(docs(spark, "a b c d e f g h " * 50), P), P)
    wide, narrow = (windows.window_pairs(words, replace(P, weight_window=w)).count() for w in (False, True))
    assert wide / 2 < narrow < wide


def test_subsample_probability(spark):
    rows = spark.createDataFrame([(1000,), (5,), (1,), (0,)], "freq bigint")
    p = rows.select(sampling.subsample_p(F.col("freq"), F.lit(100_000), 1e-4)).collect()
    assert [r[0] for r in p] == pytest.approx([0.9, 0.0, 0.0, 0.0])
    assert rows.select(sampling.subsample_p(F.col("freq"), F.lit(100_000), 0)).first()[0] == 0


@pytest.mark.parametrize("rows", [1, 3, 10])
def test_large_vocabulary(spark, rows):
    """Words beyond what is broadcast are met in a shuffle; nothing changes."""
    text = " ".join(f"w{i % 40}" if i % 3 else "the" for i in range(600))
    tokens = tokenize(docs(spark, text, "the end"), P)
    counts = cut_lineage(vocab.cut_counts(vocab.word_counts(tokens), replace(P, minfreq=8)))
    p = replace(P, subsample=0.01)
    small = sampling.subsampled(tokens, counts, 600, p)
    large = sampling.subsampled(tokens, counts, 600, p, rows)
    assert counts.count() > rows and sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))


def test_sampler_is_chosen_by_name(spark, monkeypatch):
    from wordloom.plans.pipeline import Corpus

    def first(events, noise, keys, p):
        return events.crossJoin(noise.orderBy("idx").limit(1).select("c")).withColumn("k", F.lit(1).cast("bigint"))

    monkeypatch.setitem(sampling.SAMPLERS, "first", first)
    c = Corpus(docs(spark, "a b a c", "b a"), replace(P, sampler="first", positional=False))
    assert {(r.k, r.c) for r in c.draws.collect()} == {(1, "a")}


def test_noise_draws_follow_weights(spark):
    contexts = spark.createDataFrame([("a", 0, 10_000), ("b", 1, 100), ("c", 2, 1), ("never", 3, 0)], "c string, idx bigint, freq bigint")
    noise = sampling.noise_table(contexts, P)
    assert [(r.c, r.q) for r in noise.orderBy("idx").collect()] == [("a", 10**9), ("b", 31_622_777), ("c", 10**6)]
    events = spark.range(0, 20_000).withColumnRenamed("id", "e")
    seen = {r.c: r["count"] for r in sampling.drawn(events, noise, ["e"], P).groupBy("c").count().collect()}
    assert sum(seen.values()) == 100_000 and "never" not in seen
    assert seen["a"] / 100_000 == pytest.approx(10**9 / (10**9 + 32_622_777), abs=0.01)
    own = spark.createDataFrame([(1, "a")], "e bigint, w string")
    p = replace(P, negative=200, positional=False)
    assert sampling.drawn(own, noise, ["e"], p).where("c = 'a'").count() > 100
    p = replace(p, exclude_target=True)
    assert {r.c for r in sampling.drawn(own, noise, ["e"], p).collect()} <= {"b", "c"}
    empty = sampling.noise_table(contexts.where("freq < 0"), P)
    assert sampling.drawn(events, empty, ["e"], P).count() == 0


def test_ngrams_and_hash(spark):
    vocab_ = spark.createDataFrame([("cat", 0), ("a", 1), ("über", 2)], "w string, idx bigint")
    p = replace(P, buckets=1000)
    rows = subword.word_subwords(vocab_, 10, p).orderBy("w_idx", "ord").collect()
    assert [r.sw_idx for r in rows if r.w_idx == 0] == [0, 57, 267, 389, 905, 958]
    assert [r.sw_idx for r in rows if r.w_idx == 1] == [1]
    assert sum(r.w_idx == 2 for r in rows) == 15
    h = spark.createDataFrame([("foobar",), ("a",), ("",)], "w string").select(fnv1_32(F.hex(F.encode("w", "UTF-8")))).collect()
    assert [r[0] for r in h] == [0x31F0B262, 0x050C5D7E, 2166136261]
    assert subword.word_ngrams(vocab_.where("idx = 2"), replace(p, ngram_unit="char")).count() == 9
    assert subword.word_ngrams(vocab_, replace(p, minn=0)).count() == 0


def test_listed_subwords(spark):
    vocab_ = spark.createDataFrame([("cat", 0), ("dog", 1)], "w string, idx bigint")
    lines = spark.createDataFrame([("cat ca <cat> at",), ("cow co ow",), ("dog",)], "value string")
    listed = subword.parsed_subword_lines(lines)
    got = [(r.w_idx, r.ord, r.sw) for r in subword.listed_subwords(vocab_, listed).orderBy("ord").collect()]
    assert got == [(0, 1, "ca"), (0, 2, "at")]
    assert [r.value for r in subword.malformed_subword_lines(lines).collect()] == ["dog"]
    assert [r.w for r in subword.unlisted_words(vocab_, listed).collect()] == ["dog"]
    # n-grams take precedence over a list
    assert subword.word_subwords(vocab_, 2, replace(P, buckets=10, minn=0), listed).count() == 4
    assert subword.word_subwords(vocab_, 2, replace(P, buckets=10), listed).count() == 12


def test_sgd_step():
    m = np.array([[0.1, 0.2], [0.3, -0.4]])
    c = np.array([[0.5, 0.5]])
    sub = train.Subwords(np.array([0, 2]), np.array([0, 1]))
    loss = train.batch_step(m, c, sub, np.array([0]), np.array([0]), np.array([1.0]), 0.1)
    assert loss == pytest.approx(0.45125)
    assert m == pytest.approx(np.array([[0.12375, 0.22375], [0.32375, -0.37625]]))
    assert c == pytest.approx(np.array([[0.519, 0.4905]]))


def test_training_equals_a_plain_loop(spark):
    p = Params(dim=4, iterations=3, batch=7, negative=0, minn=0, alpha=0.05, workers=1)
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b), float(a * b % 3), 1) for a, b in {(int(x), int(y)) for x, y in rng.integers(0, 9, (60, 2))}]
    examples = spark.createDataFrame(rows, "w_idx bigint, c_idx bigint, y double, copy bigint")
    got = train.train(examples, 9, 9, p)

    from wordloom.functions.hashing import uniform

    m, c = (np.array([r.v for r in vectors.initial_vectors(spark.range(9).toDF("row"), 4, p.seed + k).orderBy("row").collect()]) for k in range(2))
    losses = []
    for it in range(3):
        order = examples.withColumn("u", uniform(p.seed + it, "w_idx", "c_idx", "copy")).orderBy("u").collect()
        loss = 0.0
        for i in range(0, len(order), 7):
            part = order[i : i + 7]
            rate = train.learning_rate((it + i / len(order)) / 3, p.alpha)
            z, old = m.copy(), c.copy()
            for r in part:
                g = z[r.w_idx] @ old[r.c_idx] - r.y
                loss += 0.5 * g * g
                c[r.c_idx] -= rate * g * z[r.w_idx]
                m[r.w_idx] -= rate * g * old[r.c_idx]
        losses.append(loss / len(order))
    assert got.words == pytest.approx(m) and got.contexts == pytest.approx(c) and got.losses == pytest.approx(losses)


def test_lines_stand_for_their_copies(spark):
    """Training on lines equals training on each of their copies, with rows of
    a batch that meet several times."""
    lines = spark.createDataFrame([(a, b, float(a + b), 1 + (a * b) % 4) for a in range(6) for b in range(6)], "w_idx bigint, c_idx bigint, y double, sampled bigint")
    copies = lines.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "sampled"))).drop("sampled")
    p = Params(dim=3, iterations=2, batch=8, minn=0, alpha=0.05, workers=2, block_examples=1)
    got, want = train.train(lines, 6, 6, p), train.train(copies, 6, 6, p)
    assert got.words == pytest.approx(want.words) and got.losses == pytest.approx(want.losses)


def test_steps_on_batches():
    rng = np.random.default_rng(3)
    w, k, y = rng.integers(0, 5, 50), rng.integers(0, 4, 50), rng.normal(size=50)
    m, c = rng.normal(size=(5, 3)), rng.normal(size=(4, 3))
    m2, c2, rates = m.copy(), c.copy(), [0.1 / (i + 1) for i in range(8)]
    want = sum(train.batch_step(m, c, train.Subwords.own_rows(5), w[i : i + 7], k[i : i + 7], y[i : i + 7], r) for i, r in zip(range(0, 50, 7), rates))
    assert train.plain_steps(m2, c2, w, k, y, 7, rates) == pytest.approx(want)
    assert m2 == pytest.approx(m) and c2 == pytest.approx(c)


def test_strata_of_workers(spark):
    """Blocks that share no row, in strata, come within 5 % of the sequential
    loss, with subwords that all blocks share too."""
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(2, 120, 3))
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 120, (9000, 2))})
    examples = cut_lineage(spark.createDataFrame([(a, b, float(left[a] @ right[b] + noise), 1) for (a, b), noise in zip(pairs, rng.normal(size=len(pairs)))], "w_idx bigint, c_idx bigint, y double, copy bigint"))
    members = spark.createDataFrame([(w, 120 + (w * k) % 40) for w in range(120) for k in (1, 3, 7)], "w_idx bigint, row bigint")
    p = Params(dim=6, iterations=4, batch=40, minn=0, alpha=0.2, workers=3, block_examples=1)
    alone = train.train(examples, 120, 120, replace(p, workers=1), members, 160).losses
    got = train.train(examples, 120, 120, p, members, 160)
    assert got.losses[-1] < 1.05 * alone[-1] and alone[-1] < 0.6 * alone[0], (got.losses, alone)
    assert got.words.shape == (160, 6) and got.contexts.shape == (120, 6)
    nothing = train.train(examples.where("y > 999"), 12, 12, p)
    assert nothing.losses == [0.0] * 4
    assert nothing.words == pytest.approx(np.array([r.v for r in vectors.initial_vectors(spark.range(12).toDF("row"), 6, p.seed).orderBy("row").collect()]))


def test_divergence_stops(spark):
    p = Params(dim=2, iterations=30, batch=500, minn=0, alpha=1e6)
    rows = [(a, b, 100.0, 1) for a in range(5) for b in range(5)]
    examples = spark.createDataFrame(rows, "w_idx bigint, c_idx bigint, y double, copy bigint")
    with np.errstate(all="ignore"), pytest.raises(ArithmeticError):
        train.train(examples, 5, 5, p)


def test_learning_rate():
    assert train.learning_rate(0.0, 0.025) == 0.025
    assert train.learning_rate(0.5, 0.025) == 0.0125
    assert train.learning_rate(1.0, 0.025) == pytest.approx(2.5e-6)


def test_composition_and_merge(spark):
    matrix = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [4.0, 4.0])], "row bigint, v array<double>")
    parts = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 2), (1, 0, 1)], "w_idx bigint, ord bigint, sw_idx bigint")
    got = {r.w_idx: r.v for r in vectors.composed(parts, matrix, 2).collect()}
    assert got == {0: [3.0, 8 / 3], 1: [0.0, 1.0]}
    words = spark.createDataFrame([("a_b", [1.0, 1.0]), ("z", [2.0, 2.0])], "w string, v array<double>")
    contexts = spark.createDataFrame([("a_b_-1", [1.0, 0.0]), ("a_b_2", [0.5, 0.5])], "c string, v array<double>")
    merged = {r.w: r.v for r in vectors.merged_contexts(words, contexts, 2, True).collect()}
    assert merged == {"a_b": [2.5, 1.5], "z": [2.0, 2.0]}
    assert [r.w for r in vectors.unmerged_words(words, contexts, True).collect()] == ["z"]


def test_spool(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a")], "w string, c string")
    noise = spark.createDataFrame([("a", "b"), ("a", "c")], "w string, c string")
    spool = cooc.spooled(pairs, noise)
    assert {(r.w, r.c): (r.cooc, r.sampled) for r in spool.collect()} == {("a", "b"): (2, 3), ("b", "a"): (1, 1), ("a", "c"): (0, 1)}
    assert cooc.replicated(spool).count() == 5
    mixed = cooc.shuffled(cooc.replicated(spool), ["w", "c", "k"], 3).orderBy("place").collect()
    assert [r.place for r in mixed] == list(range(5))
    assert cooc.spool_estimate(24, P) == {"lines": 54.0, "peak_bytes": 1512.0, "final_bytes": 648.0}


def test_ranks_with_ties_and_totals(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(100)], "a bigint, b bigint")
    got = ranked(rows, [F.desc("a"), F.asc("b")], "r", "b", "total").orderBy("r").collect()
    expected = sorted(((i % 3, i) for i in range(100)), key=lambda x: (-x[0], x[1]))
    assert [(x.a, x.b) for x in got] == expected and [x.r for x in got] == list(range(100))
    assert [x.total for x in got] == np.cumsum([b for _, b in expected]).tolist()
    assert ranked(rows.where("a > 5"), [F.asc("a")], "r").count() == 0


def test_params_are_checked():
    for bad in ({"buckets": 0}, {"model": 3}, {"window": 0}, {"ngram_unit": "word"}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert math.isclose(Params().cds, 0.75)


def test_each_draw_is_hashed_once(spark):
    """The tests for null that a join brings along do not hash again."""
    contexts = spark.createDataFrame([("a", 0, 3), ("b", 1, 2)], "c string, idx bigint, freq bigint")
    events = cut_lineage(spark.range(9).select("id", F.lit("a").alias("w")))
    draws = sampling.drawn(events, sampling.noise_table(contexts, P), ["id"], P)
    assert draws.count() == 9 * P.negative
    plan = draws._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 1, plan


def test_shuffled_lines_are_computed_once(spark):
    """No pass over the lines looks for bounds first."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lines = spark.range(1000).select("id").mapInArrow(counted, "id bigint")
    rows = cooc.shuffled(lines, ["id"], 9).orderBy("place").collect()
    assert seen.value == 1000
    assert [r.place for r in rows] == list(range(1000))
    from wordloom.functions.hashing import uniform

    assert [r.id for r in rows] == [r.id for r in spark.range(1000).orderBy(uniform(9, "id"), "id").collect()]
