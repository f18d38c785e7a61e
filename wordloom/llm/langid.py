"""Language of documents and of the stretches of mixed ones.

Word-first backoff: a word that training has seen is scored by its log
frequency in each language, first as written, then without accents; any
other word by its character n-grams, at each place the longest one that
training has seen, from NGRAM characters down to one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import parts_of

NGRAM = 4


@dataclass(frozen=True)
class LangParams:
    #: Labelled documents on the driver to widen the vocabulary, at most.
    labelled_rows: int = 3_000
    #: Longer documents are not used for that; together this bounds the driver.
    labelled_chars: int = 20_000
    #: Weight of a word that training has not seen, and the largest lead in
    #: log probability that one word may give a language over another.
    unseen_weight: float = 0.35
    word_lead: float = 7.0
    #: Log probability lost when the language changes between two sentences,
    #: and within one.
    change: float = 6.0
    change_inside: float = 8.0
    #: Cached words in a Python worker.
    cache_words: int = 300_000


MARK = "\ue000"
_INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
# A tag does not reach over the mark into the next document.
_TAG = re.compile(f"</?[A-Za-z][^<>{MARK}]{{0,300}}>")
_ENTITY = re.compile(r"&(?:#\w{1,8}|\w{1,30});")
#: Entries of a count or vector dump: a line that begins with a word and its
#: numbers.
_NUMBER = r"[-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?"
_DUMPED = re.compile(rf"^[ \t]*[^\s{MARK}]+(?:[ \t]+{_NUMBER})+(?=\s|$)", re.M)
_WORD = re.compile(f"[^\\W\\d_]+(?:['’][^\\W\\d_]+)?|[.!?;\\n…]+|{MARK}")
_MARKS = re.compile("[\u0300-\u036f]+")
# Letters without a canonical decomposition.
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})


def plain(word: str) -> str:
    """The word without accents."""
    if word.isascii():
        return word
    return _MARKS.sub("", unicodedata.normalize("NFKD", word.translate(_LETTERS)))


def tokens(text: str) -> list[str]:
    """Case-folded words, sentence ends and document marks of joined texts."""
    text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return _WORD.findall(_DUMPED.sub("\n", unicodedata.normalize("NFC", text)).casefold())


class LangModel:
    """Scores of words in each language, from weighted word counts."""

    def __init__(self, counts: dict[str, Counter], p: LangParams) -> None:
        self.p = p
        self.langs = sorted(counts)
        n = len(self.langs)
        self.exact = self._log_table({lang: counts[lang] for lang in self.langs})
        folded = {lang: Counter() for lang in self.langs}
        for lang in self.langs:
            for w, c in counts[lang].items():
                folded[lang][plain(w)] += c
        self.folded = self._log_table(folded)
        self.letters = {x: i + 1 for i, x in enumerate(sorted({x for c in folded.values() for w in c for x in w}))}
        self.base = len(self.letters) + 2  # 0: unknown letter, last: word edge
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        words = sorted({w for c in folded.values() for w in c})
        if not words:
            return
        weights = np.array([[np.log1p(folded[lang][w]) for lang in self.langs] for w in words], np.float32)
        for size in range(1, NGRAM + 1):
            code, owner = self._codes(words, size)
            keys, at = np.unique(code, return_inverse=True)
            table = np.zeros((len(keys), n), np.float64)
            order = np.argsort(at, kind="stable")
            begin = np.searchsorted(at[order], np.arange(len(keys)))
            table += np.add.reduceat(weights[owner[order]].astype(np.float64), begin, axis=0)
            prob = (table + 0.02) / (table.sum(0) + 0.02 * len(keys))
            self.grams.append((keys, np.log(prob).astype(np.float32)))

    def _log_table(self, counts: dict[str, Counter]) -> dict[str, np.ndarray]:
        words = {w for c in counts.values() for w in c}
        total = np.array([sum(counts[lang].values()) for lang in self.langs], np.float64)
        out = {}
        for w in words:
            c = np.array([counts[lang][w] for lang in self.langs], np.float64)
            score = np.log((c + 0.05) / (total + 0.05 * max(1, len(words))))
            out[w] = np.maximum(score - score.max(), -self.p.word_lead).astype(np.float32)
        return out

    def _codes(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all n-grams of one size, and the word each belongs to; the
        edges of a word count as letters."""
        edge = self.base - 1
        text = "\x00" + "\x00".join(words) + "\x00"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, at = np.unique(points, return_inverse=True)
        code = np.array([edge if k == 0 else self.letters.get(chr(k), 0) for k in kinds.tolist()], np.int64)[at]
        word = np.cumsum(points == 0) - 1
        out = np.zeros(max(0, len(code) - size + 1), np.int64)
        for k in range(size):
            out = out * self.base + code[k : k + len(out)]
        owner = word[: len(out)]
        # A gram must not run over the edge into the next word.
        inner = np.cumsum(points == 0)
        last = inner[size - 1 :] - (points[size - 1 :] == 0)
        first = inner[: len(out)]
        keep = last == first if size > 1 else points[: len(out)] != 0
        return out[keep], owner[keep]

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words by their longest known n-grams."""
        n = len(self.langs)
        total = np.zeros((len(words), n), np.float32)
        edge = self.base - 1
        text = "\x00" + "\x00".join(words) + "\x00"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, at = np.unique(points, return_inverse=True)
        code = np.array([edge if k == 0 else self.letters.get(chr(k), 0) for k in kinds.tolist()], np.int64)[at]
        bounds = np.cumsum(points == 0)
        open_ = np.ones(len(code), bool)
        open_[-1] = False
        for size in range(NGRAM, 0, -1):
            if len(code) < size or len(self.grams) < size:
                continue
            keys, logs = self.grams[size - 1]
            grams = np.zeros(len(code) - size + 1, np.int64)
            for k in range(size):
                grams = grams * self.base + code[k : k + len(grams)]
            last = bounds[size - 1 :] - (points[size - 1 :] == 0)
            fits = open_[: len(grams)] & (last == bounds[: len(grams)])
            if size == 1:
                fits &= points != 0
            where = np.flatnonzero(fits)
            found = np.minimum(np.searchsorted(keys, grams[where]), len(keys) - 1)
            hit = keys[found] == grams[where]
            where, found = where[hit], found[hit]
            owner = bounds[where] - 1
            if len(owner):
                begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                led = logs[found] - logs[found].max(1, keepdims=True)
                total[owner[begin]] += np.add.reduceat(led, begin, axis=0)
            open_[where] = False
        score = total * self.p.unseen_weight
        return np.maximum(score - score.max(1, keepdims=True), -self.p.word_lead)


class Scorer:
    """A model with the scores of words met so far, bounded in number.

    Rows 0 and 1 of the scores stand for document marks and sentence ends.
    """

    def __init__(self, model: LangModel) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {MARK: 0}
        self.rows = np.zeros((2, len(self.model.langs)), np.float32)

    def codes(self, all_: list[str]) -> np.ndarray:
        """Row numbers of tokens in self.rows."""
        if len(self.row) > self.model.p.cache_words:
            self.reset()
        new = sorted(set(all_).difference(self.row))
        if new:
            words = [w for w in new if w[0].isalpha()]
            self.row.update((w, 1) for w in new if not w[0].isalpha())
            made = np.zeros((len(words), len(self.model.langs)), np.float32)
            rest = []
            for k, w in enumerate(words):
                known = self.model.exact.get(w)
                if known is None:
                    known = self.model.folded.get(f := plain(w))
                    if known is None:
                        rest.append((k, f or "\x01"))
                        continue
                made[k] = known
            if rest:
                made[[k for k, _ in rest]] = self.model.unseen([f for _, f in rest])
            self.row.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
            self.rows = np.concatenate([self.rows, made])
        return np.fromiter(map(self.row.__getitem__, all_), np.int64, len(all_))


@dataclass
class Stretch:
    lang: str
    words: int
    confidence: float


def _best_paths(score: np.ndarray, begin: np.ndarray, end: np.ndarray, change: np.ndarray) -> list[np.ndarray]:
    """Most likely language of each word of the texts score[begin:end] when a
    change before word i costs change[i].  Texts are walked side by side."""
    order = np.argsort(begin - end, kind="stable")
    first, size = begin[order], (end - begin)[order]
    k = score.shape[1]
    stay = np.arange(k)
    back = np.zeros((len(score), k), np.int16)
    total = score[first].copy()
    going = np.searchsorted(-size, -np.arange(1, size[0]), side="left")  # texts that have a word i
    for i, n in enumerate(going.tolist(), 1):
        at = first[:n] + i
        t = total[:n]
        top = t.argmax(1)
        moved = (t[np.arange(n), top] - change[at])[:, None]
        back[at] = np.where(t >= moved, stay, top[:, None])
        total[:n] = np.maximum(t, moved) + score[at]
    path = np.zeros(len(score), np.int64)
    path[first + size - 1] = total.argmax(1)
    for i, n in zip(range(len(going), 0, -1), going[::-1].tolist()):
        at = first[:n] + i
        path[at - 1] = back[at, path[at]]
    return [path[i:j] for i, j in zip(begin.tolist(), end.tolist())]


def stretches(scorer: Scorer, texts: list[str | None]) -> list[list[Stretch]]:
    """The stretches of one language in each text, in order; none for a text
    without words.  Confidence is the language's share of the probability.

    Where every sentence is best explained by one and the same language, and
    none explains poorly, that is the text's language; other texts are
    decided word by word, with a price on changes.
    """
    out: list[list[Stretch]] = [[] for _ in texts]
    kept = [k for k, t in enumerate(texts) if t]
    all_ = tokens(f"\n{MARK}\n".join(texts[k].replace(MARK, " ") for k in kept))
    if not all_ or not scorer.model.langs:
        return out
    code = scorer.codes(all_)
    word = code > 1
    if not word.any():
        return out
    sentence = np.cumsum(~word)[word]
    doc = np.cumsum(code == 0)[word]
    score = scorer.rows[code[word]]
    begin = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    ends = np.r_[begin[1:], len(sentence)]
    sums = np.add.reduceat(score, begin, axis=0)
    owner = doc[begin]
    best = sums.argmax(1)
    langs, p = scorer.model.langs, scorer.model.p
    poor = sums.max(1) < -p.change
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.r_[first[1:], len(owner)]
    one = [bool((best[i:j] == best[i]).all() and not poor[i:j].any()) for i, j in zip(first.tolist(), last.tolist())]
    lows, highs = begin[first], ends[last - 1]
    mixed = ~np.array(one)
    change = np.full(len(score), p.change_inside)
    change[begin] = p.change
    paths = iter(_best_paths(score, lows[mixed], highs[mixed], change) if mixed.any() else [])
    for i, lo, hi, single in zip(first.tolist(), lows.tolist(), highs.tolist(), one):
        part = score[lo:hi]
        path = np.full(hi - lo, best[i]) if single else next(paths)
        cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        found = out[kept[owner[i]]]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            total = part[a:b].sum(0)
            sure = 1.0 / np.exp(np.clip(total - total[path[a]], -60, 60)).sum()
            found.append(Stretch(langs[path[a]], b - a, float(sure)))
    return out


def _count(texts: Iterable[tuple[str, str]]) -> dict[str, Counter]:
    counts: dict[str, Counter] = {}
    for lang, text in texts:
        counts.setdefault(lang, Counter()).update(t for t in tokens(text) if t[0].isalpha())
    return counts


def fitted(trusted: list[tuple[str, str]], labelled: list[tuple[str, str]], p: LangParams) -> LangModel:
    """A model from trusted texts, widened by labelled ones.

    Only stretches of labelled texts that the trusted model finds in the
    labelled language are learned, so wrong labels and mixtures teach nothing.
    """
    base = _count((lang, text) for lang, text in trusted if lang and text)
    model = LangModel(base, p)
    for _ in range(2):
        scorer = Scorer(model)
        counts = {lang: Counter({w: 2 * n for w, n in c.items()}) for lang, c in base.items()}
        for i in range(0, len(labelled), 500):
            part = labelled[i : i + 500]
            for (lang, text), found in zip(part, _agreeing(scorer, [t for _, t in part])):
                if found == lang and lang in counts:
                    counts[lang].update(t for t in tokens(text) if t[0].isalpha())
        model = LangModel(counts, p)
    return model


def _agreeing(scorer: Scorer, texts: list[str]) -> list[str | None]:
    """The one language that best explains each text and nearly all of its
    sentences; null where there is none."""
    all_ = tokens(f"\n{MARK}\n".join(t.replace(MARK, " ") for t in texts))
    code = scorer.codes(all_)
    word = code > 1
    out: list[str | None] = [None] * len(texts)
    if not word.any() or not scorer.model.langs:
        return out
    sentence, doc = np.cumsum(~word)[word], np.cumsum(code == 0)[word]
    begin = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    sums = np.add.reduceat(scorer.rows[code[word]], begin, axis=0)
    owner = doc[begin]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for i, j in zip(first.tolist(), np.r_[first[1:], len(owner)].tolist()):
        top = sums[i:j].sum(0).argmax()
        if (sums[i:j].argmax(1) == top).mean() > 0.9:
            out[owner[i]] = scorer.model.langs[top]
    return out


def labels_named(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents with label_lang: what the label means, null if no language.

    Columns label_lang and label_key that documents may have are replaced."""
    # One meaning per label; the table of labels is a reference list.
    known = labels.where("label is not null").groupBy(F.lower(F.trim("label")).alias("label_key")).agg(F.min("lang").alias("label_lang"))
    keyed = documents.drop("label_lang").withColumn("label_key", F.lower(F.trim("lang")))
    return keyed.join(known, "label_key", "left").drop("label_key")


def fitted_on(documents: DataFrame, samples: DataFrame, labels: DataFrame, p: LangParams = LangParams()) -> LangModel:
    """The model of a corpus: all trusted samples and a bounded sample, chosen
    by hash of doc_id, of the documents whose label names a language."""
    trusted = [(r.lang, r.text) for r in samples.where("lang is not null and text is not null").select("lang", "text").toLocalIterator()]
    named = labels_named(documents.select("doc_id", "lang", "text"), labels)
    named = named.where(F.col("doc_id").isNotNull() & F.col("label_lang").isNotNull() & (F.length("text") <= p.labelled_chars))
    # Chosen by hash, so that the model depends on no order or layout of files.
    place = F.xxhash64(F.lit(17), "doc_id")
    last = named.select(place.alias("place")).orderBy("place").limit(p.labelled_rows).agg(F.max("place")).first()[0]
    picked = named.where(place <= last).orderBy(place, "doc_id").limit(p.labelled_rows) if last is not None else named.where("false")
    return fitted(trusted, [(r.label_lang, r.text) for r in picked.select("label_lang", "text").collect()], p)


def _arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _judged(scorer: Scorer, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[Stretch]]]]:
    """Parts of batches whose second column is the text, with its stretches.
    Equal texts of a part are judged once."""
    for batch in batches:
        for part in parts_of(batch, 1):
            coded = part.column(1).dictionary_encode()
            found = stretches(scorer, coded.dictionary.to_pylist())
            yield part, [[] if c is None else found[c] for c in coded.indices.to_pylist()]


def document_stretches(documents: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, stretch, lang, n_words, confidence), stretches numbered from 0.

    Null and blank texts and dumps of counts or vectors have no words and
    give no row, nor does a model without languages.  A word is a run of
    letters.  Other columns are ignored;
    every row is judged on its own, so rows with one doc_id repeat.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ("doc_id", "stretch", "lang", "n_words", "confidence")
    out = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _judged(Scorer(shared.value), batches):
            ids = part.column(0).to_pylist()
            yield _arrow_rows([(d, k, s.lang, s.words, s.confidence) for d, own in zip(ids, found) for k, s in enumerate(own)], out)

    schema = "doc_id bigint, stretch bigint, lang string, n_words bigint, confidence double"
    return documents.select("doc_id", "text").where("text is not null").mapInArrow(run, schema)


def judged_documents(documents: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, label_lang, langs) of documents (doc_id, text, label_lang) with
    words: langs as in document_languages(), made in the same pass, so that
    nothing is shuffled.  Every row is judged on its own."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("lang", pa.string()), ("n_words", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("label_lang", pa.string()), ("langs", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _judged(Scorer(shared.value), batches):
            rows = []
            for d, label, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), found):
                n = Counter()
                for s in own:
                    n[s.lang] += s.words
                if n:
                    rows.append((d, label, [{"lang": x, "n_words": k} for x, k in sorted(n.items(), key=lambda y: (-y[1], y[0]))]))
            yield _arrow_rows(rows, out)

    schema = "doc_id bigint, label_lang string, langs array<struct<lang: string, n_words: bigint>>"
    return documents.select("doc_id", "text", "label_lang").where("text is not null").mapInArrow(run, schema)


def document_languages(found: DataFrame) -> DataFrame:
    """(doc_id, langs) with langs an array of (lang, n_words), most words first,
    ties by lang.  A document has at most as many as the model has languages."""
    per = found.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n_words"))
    most = F.array_sort(
        F.collect_list(F.struct((-F.col("n_words")).alias("order"), F.col("lang").alias("lang"), F.col("n_words").alias("n_words")))
    )
    listed = per.groupBy("doc_id").agg(most.alias("langs"))
    return listed.withColumn("langs", F.transform("langs", lambda x: F.struct(x["lang"].alias("lang"), x["n_words"].alias("n_words"))))


def wrongly_labelled(judged: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(doc_id, lang) of judged (doc_id, label_lang, langs) whose label names no
    language or another than the main one, or with two languages of at least
    the least share of the words each: every language that holds that share."""
    num, den = least
    total = F.aggregate("langs", F.lit(0).cast("bigint"), lambda s, x: s + x["n_words"])
    held = F.filter("langs", lambda x: x["n_words"] * den >= F.col("total") * num)
    shares = judged.withColumn("total", total).withColumn("held", held)
    main = F.col("langs")[0]["lang"]
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != main) | (F.size("held") >= 2)
    return shares.where(wrong).select("doc_id", F.explode("held").alias("held")).select("doc_id", "held.lang")


def relabelled(shares: DataFrame, documents: DataFrame, least: tuple[int, int]) -> DataFrame:
    """wrongly_labelled() of shares (doc_id, langs) and documents (doc_id,
    label_lang)."""
    return wrongly_labelled(documents.join(shares, "doc_id"), least)
