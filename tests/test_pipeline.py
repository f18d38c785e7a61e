"""Both ways to train, end to end, and their files."""

from dataclasses import replace

import numpy as np
import pytest

from wordloom.params import Params
from wordloom.plans.pipeline import Corpus, run_em, run_im
from wordloom.sources.formats import read_model, read_vectors
from wordloom.streaming.embed import word_vector

P = Params(minfreq=2, window=2, subsample=0.0, negative=2, dim=6, iterations=3, buckets=50, batch=20, alpha=0.1)


@pytest.fixture(scope="module")
def corpus(spark):
    topics = ["red apple sweet fruit", "fast car loud road"]
    rows = [(i, " ".join((topics[i % 2] + " ").split() * 4)) for i in range(30)]
    return spark.createDataFrame([*rows, (99, None), (100, "")], "doc_id bigint, text string")


@pytest.mark.parametrize("run", [run_im, run_em])
@pytest.mark.parametrize("model", [0, 1, 2])
def test_runs(spark, corpus, tmp_path, run, model):
    p = replace(P, model=model, minn=3 if model == 1 else 0)
    result = run(corpus, p, str(tmp_path / "out"), str(tmp_path / "m.bin"))
    assert result.losses[-1] < result.losses[0]
    vocab = {r.w: r.idx for r in spark.read.parquet(str(tmp_path / "out/vocab")).collect()}
    assert len(vocab) == 9
    got = {r.w: np.array(r.v) for r in read_vectors(spark, str(tmp_path / "out/vectors.txt")).collect()}
    assert set(got) == set(vocab)
    m = read_model(str(tmp_path / "m.bin"))
    assert m.words == sorted(vocab, key=vocab.get)
    if model == 1:
        for w in vocab:
            assert got[w] == pytest.approx(word_vector(m, vocab, w), abs=1e-6)
    assert (tmp_path / "out/vectors.txt.context").exists() == (model == 0)


def test_topics_come_apart(spark, corpus):
    p = replace(P, minn=0, dim=8, iterations=15, positional=False)
    from wordloom.plans.pipeline import trained_em

    c = Corpus(corpus, p)
    words = {r.w: r.idx for r in c.vocab.collect()}
    m = trained_em(c).words
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    near, far = unit[words["red"]] @ unit[words["apple"]], unit[words["red"]] @ unit[words["road"]]
    assert near > far + 0.3


def test_contexts_equal_column_totals(corpus):
    c = Corpus(corpus, P)
    seen = {r.c: r.freq for r in c.contexts.collect()}
    assert len(seen) == 9 * 4
    assert sum(seen.values()) == c.cells.agg({"cooc": "sum"}).first()[0]


def test_listed_subwords(spark, corpus, tmp_path):
    listed = spark.createDataFrame([("apple", ["ap", "ple"])], "w string, subwords array<string>")
    p = replace(P, minn=0)
    result = run_em(corpus, p, str(tmp_path / "out"), str(tmp_path / "m.bin"), listed)
    assert result.words.shape == (9 + 50, 6)
    assert read_model(str(tmp_path / "m.bin")).buckets == 50


def test_vocabulary_is_kept_where_it_may_be(corpus):
    c = Corpus(corpus, P)
    assert c.under(seed=7).cut is c.cut
    assert c.under(minfreq=3).cut is not c.cut


@pytest.mark.parametrize("subsample", [0.0, 0.1])
def test_words_are_found_once(corpus, monkeypatch, subsample):
    """Epochs start from the stored words, or from the stored tokens where each
    drops others; the texts are read for the vocabulary and once more."""
    from wordloom.operators import sampling, windows
    from wordloom.plans.pipeline import trained_im

    met, cut = [], []
    known, sentences = sampling.known_tokens, windows.sentences
    monkeypatch.setattr(sampling, "known_tokens", lambda *a: met.append(1) or known(*a))
    monkeypatch.setattr(windows, "sentences", lambda *a: cut.append(1) or sentences(*a))
    result = trained_im(Corpus(corpus, replace(P, minn=0, iterations=2, subsample=subsample)))
    assert len(result.losses) == 2
    assert len(met) == 1 and len(cut) == (3 if subsample else 1)


def test_spools_are_not_copied(corpus, monkeypatch):
    """Training gets each line of the spool once, with its number of copies."""
    from wordloom.operators import train
    from wordloom.plans.pipeline import trained_em

    got = []
    monkeypatch.setattr(train, "train", lambda examples, *a: got.append(examples))
    trained_em(Corpus(corpus, replace(P, minn=0)))
    lines = got[0]
    assert "sampled" in lines.columns
    assert lines.count() == lines.select("w_idx", "c_idx").distinct().count()
    assert lines.agg({"sampled": "sum"}).first()[0] > lines.count()
