"""Languages of documents, measured on held-out text."""

import pytest

from wordloom.llm import langid, queries
from wordloom.llm.langid import LangModel, LangParams, Scorer, document_languages, document_stretches, fitted, labels_named, relabelled, stretches, tokens
from wordloom.runtime import read_table


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return [(r.sample_id, r.lang, r.text) for r in read_table(spark, sf_dir, "lang_sample").collect()]


@pytest.fixture(scope="module")
def model(samples):
    return fitted([(lang, t) for i, lang, t in samples if i % 4], [], LangParams())


def held_out(samples):
    return [(lang, t) for i, lang, t in samples if i % 4 == 0]


def test_held_out_accuracy(samples, model):
    test = held_out(samples)
    got = stretches(Scorer(model), [t for _, t in test])
    right = sum(max(s, key=lambda x: x.words).lang == lang for s, (lang, _) in zip(got, test))
    assert len(test) >= 20 and right == len(test)


def test_capitals_and_lost_accents(samples, model):
    test = held_out(samples)
    changed = [langid.plain(t.lower()).upper() for _, t in test]
    got = stretches(Scorer(model), changed)
    right = sum(max(s, key=lambda x: x.words).lang == lang for s, (lang, _) in zip(got, test))
    assert right >= 0.95 * len(test)


def test_mixtures(samples, model):
    test = dict(held_out(samples))
    langs = sorted(test)
    texts = [test[a] + "\n" + test[b] for a, b in zip(langs, langs[5:] + langs[:5])]
    good = 0
    for found, a, b in zip(stretches(Scorer(model), texts), langs, langs[5:] + langs[:5]):
        good += [s.lang for s in found] == [a, b] and all(s.confidence > 0.9 for s in found)
    assert good >= 0.8 * len(langs)


def test_no_words(model):
    texts = [None, "", " \n\t", "0.1 -0.2 3e5\n1 2 3", "...!?", "<p></p>", "word 0.1 0.2\nother 0.3 0.4", "\u200b"]
    assert stretches(Scorer(model), texts) == [[] for _ in texts]


def test_counts_and_marks(model):
    (found,) = stretches(Scorer(model), ["The <b>garden</b> of the river, and 42 of the " + langid.MARK + " words."])
    assert [(s.lang, s.words) for s in found] == [("en", 9)]
    assert tokens("l'eau d’or") == ["l'eau", "d’or"]


@pytest.mark.parametrize("end", [" <b class=x", " <!-- open", " &#xE000;", " &lt;i", " <", " &"])
def test_documents_of_a_batch_do_not_touch(samples, model, end):
    texts = [t + end for _, t in held_out(samples)[:4]]
    texts = [texts[0], "b > c --> " + texts[1], None, "", texts[2], "> --> " + texts[3]]
    scorer = Scorer(model)
    found = lambda ts: [[(s.lang, s.words) for s in x] for x in stretches(scorer, ts)]
    assert found(texts) == [found([t])[0] for t in texts]


def test_parts_hold_every_row():
    import pyarrow as pa

    from wordloom.llm.batches import parts_of

    texts = ["a" * 10, None, "b" * 95, "", "c" * 500, "d", "e" * 99, "f" * 2, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["i", "t"])
    parts = [p.column(0).to_pylist() for p in parts_of(batch, 1, rows=3, size=100)]
    assert parts == [[0, 1], [2, 3], [4], [5, 6], [7, 8]]
    assert list(parts_of(batch.slice(0, 0), 1)) == []


def test_one_pass_gives_the_same(spark, samples, model):
    texts = [t for _, t in held_out(samples)]
    texts += [a + "\n" + b for a, b in zip(texts, texts[3:])] + texts[:2] + [None, " "]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, label_lang string")
    apart = {r.doc_id: r.langs for r in document_languages(document_stretches(docs, model)).collect()}
    for n in (1, 7):
        got = langid.judged_documents(docs.repartition(n), model).collect()
        assert {r.doc_id: r.langs for r in got} == apart and all(r.label_lang == "x" for r in got)


def test_sample_depends_on_no_layout(spark, sf_dir, samples):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "lang_label")
    trusted, p = read_table(spark, sf_dir, "lang_sample"), LangParams(labelled_rows=30)
    one = langid.fitted_on(docs.coalesce(1).orderBy("doc_id"), trusted, labels, p)
    many = langid.fitted_on(docs.repartition(9).orderBy("fetched_at"), trusted, labels, p)
    assert one.exact.keys() == many.exact.keys() and all((one.exact[w] == many.exact[w]).all() for w in one.exact)


def test_very_long_text(model):
    (found,) = stretches(Scorer(model), ["and the river of the garden " * 30_000])
    assert [(s.lang, s.words) for s in found] == [("en", 180_000)]


def test_cache_is_bounded(samples):
    p = LangParams(cache_words=50)
    small = Scorer(LangModel(fitted([(lang, t) for _, lang, t in samples], [], p).p and _counts(samples), p))
    full = Scorer(LangModel(_counts(samples), LangParams()))
    for _, _, t in samples[:30]:
        assert stretches(small, [t]) == stretches(full, [t])
    assert len(small.row) < 500


def _counts(samples):
    return langid._count((lang, t) for _, lang, t in samples)


def test_backoff(samples):
    m = LangModel(_counts(samples), LangParams())
    langs = m.langs
    unseen = m.unseen(["żźćółka", "въщиця"])
    assert langs[unseen[0].argmax()] == "pl" and langs[unseen[1].argmax()] in ("ru", "uk")
    assert (m.unseen(["日本"]) == 0).all() or m.unseen(["日本"]).shape == (1, len(langs))


def test_labels(spark):
    docs = spark.createDataFrame([(1, " EN "), (2, "xx"), (3, None), (4, ""), (5, "Deutsch")], "doc_id bigint, lang string").selectExpr("*", "'x' as label_lang")
    labels = spark.createDataFrame([("en", "en"), ("deutsch", "de"), (None, "fr"), ("en", "en")], "label string, lang string")
    assert {r.doc_id: r.label_lang for r in labels_named(docs, labels).collect()} == {1: "en", 2: None, 3: None, 4: None, 5: "de"}


def test_relabelled(spark):
    found = spark.createDataFrame(
        [(1, 0, "en", 90, 1.0), (1, 1, "fr", 10, 1.0), (2, 0, "en", 80, 1.0), (2, 1, "de", 10, 1.0), (2, 2, "de", 10, 1.0), (3, 0, "fr", 5, 1.0), (4, 0, "en", 5, 1.0), (5, 0, "da", 3, 1.0), (5, 1, "sv", 3, 1.0)],
        "doc_id bigint, stretch bigint, lang string, n_words bigint, confidence double",
    )
    docs = spark.createDataFrame([(1, "en"), (2, "en"), (3, "en"), (4, None), (5, "da"), (6, None)], "doc_id bigint, label_lang string")
    got = relabelled(document_languages(found), docs, (15, 100)).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(2, "de"), (2, "en"), (3, "fr"), (4, "en"), (5, "da"), (5, "sv")]


def test_queries_run(spark, sf_dir):
    rows = queries.p10_stretches(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in read_table(spark, sf_dir, "documents").collect()}
    assert all(r.n_words > 0 and 0 < r.confidence <= 1 for r in rows)
    assert len({r.doc_id for r in rows}) > 0.9 * len(texts)
    labels = {r.label: r.lang for r in read_table(spark, sf_dir, "lang_label").collect()}
    named = {r.doc_id: labels.get((r.lang or "").strip().lower()) for r in read_table(spark, sf_dir, "documents").collect()}
    single = [r for r in rows if sum(x.doc_id == r.doc_id for x in rows) == 1 and named[r.doc_id]]
    assert sum(named[r.doc_id] == r.lang for r in single) > 0.85 * len(single)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    none = langid.fitted_on(docs, spark.createDataFrame([], "lang string, text string"), spark.createDataFrame([], "label string, lang string"))
    assert none.langs == []
    some = spark.createDataFrame([(1, "words here")], "doc_id bigint, text string")
    assert document_stretches(some, none).count() == 0
    assert document_languages(document_stretches(some, none)).count() == 0
