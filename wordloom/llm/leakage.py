"""Evaluation passages inside a training corpus.

Texts are brought to a canonical form (markup, layout, accents, case and
invisible characters removed) and to a template: numbers, units after a
number and names become typed slots, decided from each text alone.  Windows
of three template words are looked up in a hash table of the items' windows,
with names as they are and as slots; hits are chained along their diagonals,
and a document leaks an item if one chain or two cover enough of it.  Slots
count where they correspond one to one, so a question asked again with other
numbers or names is caught, and one with values that contradict each other
is not helped by them.

The corpus is passed once, without a shuffle, for each block of items; the
table of a block is bounded by ITEMS_PER_BLOCK items and WORDS_PER_BLOCK words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.batches import parts_of
from wordloom.runtime import cut_lineage

#: Items whose windows are held in memory at once, and the most words of them
#: (some 40 bytes a word in each Python worker).
ITEMS_PER_BLOCK = 200_000
WORDS_PER_BLOCK = 4_000_000
#: Different spellings whose codes a worker remembers.
CACHED_WORDS = 500_000
WINDOW = 3
#: Words without a match that a piece may step over, in item and document.
STEP = 6
#: Share of an item's words that a document has to carry.
CARRIED = 0.5
#: Words at a cut or a changed word at the end of a piece may miss the window.
SLACK = 1

MARK = "\ue000"
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
# Neither markup nor an entity reaches over the mark into the next document.
_TAG = re.compile(f"</?[A-Za-z][^<>{MARK}]{{0,300}}>|<!--[^{MARK}]{{0,2000}}?-->")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_MARKS = re.compile("[\u0300-\u036f]+")
_BETWEEN = re.compile(f"[^\\w{MARK}]+|_+")
# Letters without a canonical decomposition, and units.
_LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ı": "i", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"})
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t oz lb ml cl dl l s sec min h hr hrs hours minutes seconds days "
    "w kw mw j kj cal kcal v a hz khz mhz ghz b kb mb gb tb c f k eur usd gbp percent"
).split()

NUMBER, UNIT, NAME = 1, 2, 3
_FIRST_WORD = 4
_UNITS = frozenset(UNITS)


def canonical(text: str) -> str:
    """Words of the text without case marks lost: one space between words."""
    text = _INVISIBLE.sub("", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]).replace(MARK, " "), text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_LETTERS)))
    return _BETWEEN.sub(" ", text)


class _Codes(dict):
    """Cased word -> its number among the items' words (0 for others) times 8,
    with bits for digits (1), a capitalised word (2) and a unit (4)."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        f = word.casefold()
        digits = f.isdigit()
        out = 8 * (0 if digits else self.number.get(f, 0)) + digits + 2 * word.istitle() + 4 * (f in _UNITS)
        self[word] = out
        return out


class Template:
    """Words of a text, each with its number and the kind of slot it may be."""

    def __init__(self, words: list[str], codes: _Codes) -> None:
        coded = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        digits = (coded & 1) > 0
        #: Numbers and units are slots wherever they come, names where asked.
        self.plain = np.where(digits, NUMBER, coded >> 3)
        self.plain[1:][digits[:-1] & ((coded[1:] & 4) > 0)] = UNIT
        self.name = ((coded & 2) > 0) & (self.plain != UNIT)


class ItemBlock:
    """Templates and window table of a bounded number of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        split = [(i, canonical(t.replace(MARK, " ")).split(), t) for i, t in items]
        split = [x for x in split if x[1]]
        self.ids = [i for i, _, _ in split]
        self.words = [[w.casefold() for w in ws] for _, ws, _ in split]
        number: dict[str, int] = {}
        for ws in self.words:
            for w in ws:
                number.setdefault(w, len(number) + _FIRST_WORD)
        self.number = number
        self.base = len(number) + _FIRST_WORD
        codes = _Codes(number)
        self.template: list[np.ndarray] = []
        keys, owner, place = [], [], []
        for k, (_, ws, text) in enumerate(split):
            plain = Template(ws, codes).plain
            names = self._names(text)
            named = plain.copy()
            named[np.array([w in names for w in ws]) & (plain != UNIT)] = NAME
            self.template.append(named)
            for coded in (plain, named) if names else (plain,):
                found = self.windows(coded, min(WINDOW, len(ws)))
                at = np.flatnonzero(found >= 0)
                keys.append(found[at])
                owner.append(np.full(len(at), k))
                place.append(at)
        table = np.stack([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owner, place)])
        table = np.unique(table, axis=1)
        self.keys, self.begin = np.unique(table[0], return_index=True)
        self.begin = np.r_[self.begin, table.shape[1]].astype(np.int64)
        self.owner, self.place = table[1].astype(np.int32), table[2].astype(np.int32)
        self.size = np.array([len(ws) for ws in self.words], np.int64)
        #: Words in windows that are nothing but slots.
        self.bare = np.array([self._bare(t) for t in self.template], np.int64)
        self.short = sorted({len(ws) for ws in self.words if len(ws) < WINDOW})
        #: Items that have names, and windows that have a name as a slot.
        self.has_names = any((t == NAME).any() for t in self.template)
        self._codes: _Codes | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_codes": None}

    @property
    def codes(self) -> _Codes:
        if self._codes is None:
            self._codes = _Codes(self.number)
        return self._codes

    @staticmethod
    def _names(text: str) -> set[str]:
        """Capitalised words within a sentence.  Where there is more than one
        for three lower-case words, as in languages that write every noun so,
        only those that come again."""
        inside = re.findall(r"(?<=[^\W\d_] )[^\W\d_]+|(?<=, )[^\W\d_]+", text)
        found = Counter(w for w in inside if w[:1].isupper() and w[1:].islower())
        low = sum(w.islower() for w in inside)
        if low <= 3 * len(found):
            found = Counter({w: n for w, n in found.items() if n > 1})
        return {x for w in found for x in canonical(w).split()}

    @staticmethod
    def _bare(template: np.ndarray) -> int:
        told = np.convolve(template >= _FIRST_WORD, np.ones(WINDOW, int))[WINDOW - 1 : len(template)] > 0
        return int((np.convolve(told, np.ones(WINDOW, int))[: len(template)] == 0).sum()) if len(template) >= WINDOW else 0

    def windows(self, codes: np.ndarray, size: int = WINDOW) -> np.ndarray:
        """A number for each window of known words, -1 for the others and for
        those that are nothing but slots, which any dump of numbers has."""
        n = len(codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out = np.zeros(n, np.int64)
        known, told = np.ones(n, bool), np.zeros(n, bool)
        for k in range(size):
            part = codes[k : k + n]
            out = out * self.base + part
            known &= part > 0
            told |= part >= _FIRST_WORD
        # Shorter windows are those of whole short items; 0 is no word.
        out *= self.base ** (WINDOW - size)
        out[~(known & told)] = -1
        return out

    def hits(self, t: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, item place, document place) of equal windows.  Each
        capitalised word is taken as it is and as a name, in every mixture."""
        found = []
        for size in [WINDOW, *self.short]:
            for mask in range(1 << size if self.has_names else 1):
                coded = t.plain
                if mask:
                    n = len(coded) - size + 1
                    if n <= 0:
                        continue
                    may = np.ones(n, bool)
                    for k in range(size):
                        if mask >> k & 1:
                            may &= t.name[k : k + n]
                    at = np.flatnonzero(may)
                    if not len(at):
                        continue
                    # The windows in question, one after the other.
                    parts = [np.where(mask >> k & 1, NAME, coded[at + k]) for k in range(size)]
                    keys = self.windows(np.stack(parts, 1).ravel(), size)[::size]
                else:
                    keys = self.windows(coded, size)
                    at = np.arange(len(keys))
                keep = keys >= 0
                keys, at = keys[keep], at[keep]
                row = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
                hit = self.keys[row] == keys if len(self.keys) else np.zeros(0, bool)
                row, at = row[hit], at[hit]
                n = self.begin[row + 1] - self.begin[row]
                where = np.repeat(self.begin[row] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(row) else row
                found.append((self.owner[where], self.place[where], np.repeat(at, n)))
        all_ = np.stack([np.concatenate(x).astype(np.int64) for x in zip(*found)])
        return tuple(np.unique(all_, axis=1))


def _runs(i: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Hits (item place, document place) as runs along their diagonals:
    (item begin, last, document begin, last, hits)."""
    order = np.lexsort((h, h - i))
    i, h = i[order], h[order]
    new = np.r_[True, (np.diff(h - i) != 0) | (np.diff(h) > STEP + WINDOW)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(i)] - 1
    return list(zip(i[first].tolist(), i[last].tolist(), h[first].tolist(), h[last].tolist(), (last - first + 1).tolist()))


def _extended(runs: list, template: np.ndarray, slots: np.ndarray) -> list:
    """The runs carried on over slots of the same kind in item and document,
    whose windows are no hits.  slots has the kind of each document word."""
    out = []
    for a, b, p, q, n in runs:
        while a > 0 and p > 0 and template[a - 1] <= NAME and slots[p - 1] == template[a - 1]:
            a, p = a - 1, p - 1
        while b + WINDOW < len(template) and q + WINDOW < len(slots) and template[b + WINDOW] <= NAME and slots[q + WINDOW] == template[b + WINDOW]:
            b, q = b + 1, q + 1
        if out and out[-1][2] - out[-1][0] == p - a and a - out[-1][1] <= STEP + WINDOW:
            # The run before it, of the same diagonal, has come up to this one.
            before = out.pop()
            a, p, n = before[0], before[2], before[4] + n
        out.append((a, b, p, q, n))
    return out


def _pieces(runs: list) -> list[tuple[int, int, int, int, int]]:
    """Runs as chains (item begin, item end, document begin, document end,
    hits): those on neighbouring diagonals that follow each other closely."""
    reach = STEP + WINDOW
    open_: list[list[int]] = []
    done: list[list[int]] = []
    for a, b, p, q, n in sorted(runs, key=lambda r: (r[2], r[0])):
        if len(open_) > 32:
            done += [c for c in open_ if c[3] < p - reach]
            open_ = [c for c in open_ if c[3] >= p - reach]
        best, gap = None, None
        for c in open_:
            di, dd = a - c[1], p - c[3]
            if 0 < di <= reach and 0 < dd <= reach and (gap is None or abs(di - dd) + di < gap):
                best, gap = c, abs(di - dd) + di
        if best is None:
            open_.append([a, b, p, q, n])
        else:
            best[1], best[3] = b, q
            best[4] += n
    return [(a, b + WINDOW, p, q + WINDOW, n) for a, b, p, q, n in done + open_]


def _covered(pieces: list[tuple[int, int, int, int, int]]) -> tuple[int, list]:
    """Most item words in one piece, or in two that follow each other.

    Two pieces x, y cover the smaller of the sum of their lengths and the
    stretch from the begin of x to the end of y.  Pieces are swept in the
    order of the document; of those that may come first, a prefix tree over
    their ends has the longest that ends before y begins, and a suffix tree
    the one that begins earliest of those that end after.
    """
    if not pieces:
        return 0, []
    single = max(pieces, key=lambda c: (c[1] - c[0], -c[2]))
    best, pick = single[1] - single[0], [single]
    n = max(c[1] for c in pieces) + 1
    longest: list = [None] * (n + 1)
    earliest: list = [None] * (n + 1)
    firsts = sorted(pieces, key=lambda c: c[3])
    k = 0
    for y in sorted(pieces, key=lambda c: c[2]):
        while k < len(firsts) and firsts[k][3] - WINDOW <= y[2]:
            x = firsts[k]
            k += 1
            at = x[1] + 1
            while at <= n:
                if longest[at] is None or x[1] - x[0] > longest[at][1] - longest[at][0]:
                    longest[at] = x
                at += at & -at
            at = n - x[1]
            while at <= n:
                if earliest[at] is None or x[0] < earliest[at][0]:
                    earliest[at] = x
                at += at & -at
        for tree, at in ((longest, y[0] + 1), (earliest, n - y[0])):
            while at > 0:
                x = tree[at]
                if x is not None and (words := min(x[1] - x[0] + y[1] - y[0], y[1] - x[0])) > best:
                    best, pick = words, [x, y]
                at -= at & -at
    return best, pick


def _aligned(size: int, runs: list, pieces: list) -> np.ndarray:
    """The document place of each word of the item, -1 where there is none;
    what lies between two hits of one diagonal is on it too, and the longest
    run decides where several pass."""
    out = np.full(size, -1, np.int64)
    longest = sorted(runs, key=lambda r: (r[0] - r[1], r[2]))
    for a, b, p, q, _ in pieces:
        for x0, x1, y0, y1, _ in longest:
            if x0 >= a and x1 + WINDOW <= b and y0 >= p and y1 + WINDOW <= q:
                at = np.arange(x0, x1 + WINDOW)
                at = at[out[at] < 0]
                out[at] = y0 + at - x0
    return out


def _slots(kinds: np.ndarray, mine: list[str], theirs: list[str | None]) -> tuple[int, int]:
    """Slots that hold another value than the item, and those of them that
    contradict the rest.  kinds, mine and theirs go word by word; a value of
    the item has one in the document, and the other way round."""
    pairs = [(int(k), x, y) for k, x, y in zip(kinds.tolist(), mine, theirs) if k <= NAME and y is not None]
    there: dict[tuple[int, str], set[str]] = defaultdict(set)
    back: dict[tuple[int, str], set[str]] = defaultdict(set)
    for kind, x, y in pairs:
        there[kind, x].add(y)
        back[kind, y].add(x)
    changed = [(kind, x, y) for kind, x, y in pairs if x != y]
    wrong = sum(len(there[kind, x]) > 1 or len(back[kind, y]) > 1 for kind, x, y in changed)
    return len(changed), wrong


def leaks_in(block: ItemBlock, ids: list[int], texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
    """(doc, item, share carried, pieces, slots changed) of a batch of texts."""
    kept = [k for k, t in enumerate(texts) if t]
    if not kept or not len(block.keys):
        return
    words = canonical(f" {MARK} ".join(texts[k].replace(MARK, " ") for k in kept)).split()
    if not words:
        return
    ends = np.array([k for k, w in enumerate(words) if w == MARK] + [len(words)])
    if len(ends) != len(kept):
        raise AssertionError("texts of a batch ran into each other")
    begin = np.r_[0, ends + 1]
    template = Template(words, block.codes)
    owner, i, h = block.hits(template)
    doc = np.searchsorted(ends, h)
    order = np.lexsort((h, i, owner, doc))
    owner, i, h, doc = owner[order], i[order], h[order], doc[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, int)
    other = np.r_[True, (np.diff(i) != 0) | (np.diff(owner) != 0) | (np.diff(doc) != 0)] if len(h) else np.zeros(0, bool)
    places = np.add.reduceat(other, first) if len(first) else first
    need = CARRIED * block.size - SLACK
    # Half of what is carried has to lie in windows, which hold WINDOW words,
    # or in slots beside them.
    enough = np.flatnonzero(2 * (WINDOW * places + block.bare[owner[first]]) >= need[owner[first]]) if len(first) else first
    last = np.r_[first[1:], len(h)]
    for at in enough.tolist():
        part = slice(first[at], last[at])
        k, d = int(owner[first[at]]), int(doc[first[at]])
        own_i, own_h = i[part], h[part] - begin[d]
        size = int(block.size[k])
        if size < WINDOW:
            yield ids[kept[d]], block.ids[k], 1.0, 1, 0
            continue
        runs = _runs(own_i, own_h)
        if block.bare[k]:
            own = slice(begin[d], ends[d])
            slots = np.where(template.name[own], NAME, np.minimum(template.plain[own], _FIRST_WORD))
            runs = _extended(runs, block.template[k], slots)
        carried, pieces = _covered(_pieces(runs))
        if carried < need[k]:
            continue
        place = _aligned(size, runs, pieces)
        inside = np.zeros(size, bool)
        for a, b, *_ in pieces:
            inside[a:b] = True
        there = np.flatnonzero(inside & (place >= 0))
        kinds = block.template[k][there]
        theirs = [words[begin[d] + p].casefold() for p in place[there].tolist()]
        mine = [block.words[k][x] for x in there.tolist()]
        changed, wrong = _slots(kinds, mine, theirs)
        matched = np.zeros(size + WINDOW, bool)
        for x in range(WINDOW):
            matched[own_i + x] = True
        matched[there[kinds <= NAME]] = True
        if carried - wrong < need[k] or 2 * int((matched[:size] & inside).sum()) < carried:
            continue
        yield ids[kept[d]], block.ids[k], (carried - wrong) / size, len(pieces), changed - wrong


def _blocks(items: DataFrame) -> Iterator[ItemBlock]:
    """Blocks of items; the driver holds the texts of one at a time."""
    block, words = [], 0
    for item_id, text in items.orderBy("item_id").toLocalIterator():
        # A word has at least one letter and one blank.
        if block and (len(block) >= ITEMS_PER_BLOCK or words + len(text) / 2 > WORDS_PER_BLOCK):
            yield ItemBlock(block)
            block, words = [], 0
        block.append((item_id, text))
        words += len(text) / 2
    yield ItemBlock(block)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, pieces, slots_changed) of every document that
    carries at least half of an item's words in the item's order.

    documents has doc_id and text, items item_id and text.  Null or blank
    texts, items without words and null item ids match nothing; an item id
    that comes twice counts with the first of its texts in byte order.  Each
    doc_id is judged on its own.  An item of one or two words is carried where
    all of them follow each other; an item of numbers only has no word to be
    found by.  share leaves out slots whose values contradict each other;
    slots_changed counts those that hold another value and do not.  Other
    columns are ignored.
    """
    spark = documents.sparkSession
    held = items.where("item_id is not null and text is not null").groupBy("item_id").agg({"text": "min"})
    schema = "doc_id bigint, item_id bigint, share double, pieces bigint, slots_changed bigint"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in parts_of(batch, 1):
                    rows = list(leaks_in(shared.value, part.column(0).to_pylist(), part.column(1).to_pylist()))
                    cols = list(zip(*rows)) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                        names=["doc_id", "item_id", "share", "pieces", "slots_changed"],
                    )

        return run

    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    found, shared = None, None
    for block in _blocks(held):
        if shared is not None:
            # More than one block: each pass ends before the next table is sent.
            found = cut_lineage(part) if found is None else found.unionByName(cut_lineage(part))
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        part = texts.mapInArrow(search(shared), schema)
    return part if found is None else found.unionByName(part)
