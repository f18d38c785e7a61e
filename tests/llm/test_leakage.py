"""Planted passages are found, look-alikes are not."""

import random

import pytest

from wordloom.llm import leakage
from wordloom.llm.leakage import ItemBlock, canonical, leaked_items, leaks_in

R = random.Random(4)
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "tu", "zé") for b in ("ran", "sol", "tik", "vum", "wex")] + ["the", "of", "and", "a", "in"]


def text_of(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


ITEMS = {i: text_of(40, random.Random(i)) for i in range(1, 9)}
FILL = text_of(120, random.Random(99))


def placed(text, before=30, after=30):
    f = FILL.split()
    return " ".join(f[:before]) + " " + text + " " + " ".join(f[before : before + after])


def found(text, items=ITEMS):
    return {(d, i) for d, i, *_ in leaks_in(ItemBlock(sorted(items.items())), [7], [text])}


def words(i):
    return ITEMS[i].split()


@pytest.mark.parametrize(
    "text",
    [
        placed(ITEMS[1]),
        placed(ITEMS[1].upper()),
        placed(ITEMS[1].replace("é", "e")),
        placed(ITEMS[1].replace("é", "é")),
        placed("<p>" + ITEMS[1].replace(" ", " <b>", 1).replace(" ", "</b>\n- ", 2) + "</p>"),
        placed(ITEMS[1].replace("ra", "r\u200ba").replace("so", "s\u00ado")),
        placed(", ".join(words(1))),
        placed("&quot;" + ITEMS[1].replace(" ", "&nbsp;") + "&quot;"),
        placed(" ".join(words(1)[10:32])),
        placed(" ".join(words(1)[:12])) + " " + FILL + " " + " ".join(words(1)[25:37]),
        placed(" ".join(w if k % 6 else "changed" for k, w in enumerate(words(1)))),
        ITEMS[1],
        FILL * 300 + ITEMS[1],
    ],
)
def test_found(text):
    assert found(text) == {(7, 1)}


@pytest.mark.parametrize(
    "text",
    [
        placed(""),
        placed(" ".join(words(1)[:9])),
        placed(" ".join(sorted(words(1)))),
        placed(" ".join(reversed(words(1)))),
        placed(" ".join(random.Random(0).sample(words(1), 40))),
        "",
        " \n ",
        None,
        "0.1 0.2 0.3 " * 50,
    ],
)
def test_not_found(text):
    assert found(text) == set()


def test_two_items_in_one_text():
    assert found(placed(ITEMS[2] + " " + FILL + " " + ITEMS[3])) == {(7, 2), (7, 3)}


def test_changed_numbers_are_slots():
    item = {1: "a train with 120 seats leaves at 8 from the town of Arden and 45 people get on at the next stop so how many seats of the 120 are free"}
    again = "a train with 300 seats leaves at 9 from the town of Borlin and 77 people get on at the next stop so how many seats of the 300 are free"
    rows = list(leaks_in(ItemBlock(list(item.items())), [7], [placed(again)]))
    assert [(d, i) for d, i, *_ in rows] == [(7, 1)] and rows[0][4] >= 3
    other = again.replace("the 300", "the 555")
    # One number of the item has two in this text: neither of them counts.
    (row,) = leaks_in(ItemBlock(list(item.items())), [7], [placed(other)])
    assert row[2:] == (29 / 31, 1, 3)


STORY = "yesterday the keeper told {0} that {1} had left the old mill and {0} went to ask {1} and {2} about the long road while {0} and {2} slept"


def test_contradicting_names_do_not_count():
    item = [(1, STORY.format("Anna", "Boris", "Clara"))]
    (renamed,) = leaks_in(ItemBlock(item), [7], [STORY.format("Xenia", "Yorick", "Zora")])
    assert renamed[2:] == (1.0, 1, 7)
    (merged,) = leaks_in(ItemBlock(item), [7], [STORY.format("Gustav", "Gustav", "Gustav")])
    assert merged[2] == pytest.approx(22 / 29) and merged[4] == 0


def test_name_dense_question():
    item = [(1, "so Anna gave Boris pears, Boris gave Clara plums, Clara and Anna ate with Boris what Clara and Anna had")]
    (row,) = leaks_in(ItemBlock(item), [7], ["so Xenia gave Yorick pears, Yorick gave Zora plums, Zora and Xenia ate with Yorick what Zora and Xenia had"])
    assert row[2] == 1.0 and row[4] == 9


def test_slots_depend_on_no_other_item():
    item = (1, STORY.format("Anna", "Boris", "Clara"))
    text = "The end. " + STORY.format("Carla", "Denis", "Emma") + " The End"
    alone = list(leaks_in(ItemBlock([item]), [7], [text]))
    others = [(2, "we know that Carla and Denis have read all of the many books with Emma"), (3, "the end of it all"), *((k, ITEMS[k - 10]) for k in range(11, 19))]
    assert alone and [r for r in leaks_in(ItemBlock([item, *others]), [7], [text]) if r[1] == 1] == alone


def test_numbers_alone_are_no_seed():
    import time

    numbers = [str(7 * k % 1000) for k in range(120)]
    block = ItemBlock([(1, "please add up " + " ".join(numbers) + " and tell")])
    began = time.time()
    assert not list(leaks_in(block, [7], [" ".join(str(k % 977) for k in range(4_000))]))
    assert time.time() - began < 1
    (row,) = leaks_in(block, [7], [placed("please add up " + " ".join(numbers) + " and tell")])
    assert row[2] == 1.0
    (row,) = leaks_in(block, [7], [placed("please add up " + " ".join(str(5000 + int(x)) for x in numbers))])
    assert row[2] > 0.95 and row[4] == 120


def test_short_items():
    block = ItemBlock([(1, "zebra"), (2, "mi zebra"), (3, "mi zebra vum")])
    hits = lambda t: {r[1] for r in leaks_in(block, [7], [t])}
    assert hits("a zebra") == {1} and hits("mi zebra") == {1, 2} and hits("so mi zebra vum it") == {1, 2, 3} and hits("mi vum") == set()


def test_many_repeats_are_fast():
    import time

    item = [f"w{k}x" for k in range(80)]
    text = " ".join([" ".join(item[:17])] * 4_000 + [" ".join(item[40:64])])
    began = time.time()
    ((_, _, share, pieces, _),) = leaks_in(ItemBlock([(1, " ".join(item))]), [7], [text])
    assert (share, pieces) == (41 / 80, 2) and time.time() - began < 5


def test_batches_change_nothing():
    r = random.Random(2)
    texts = [r.choice(OPEN_ENDS) + (placed(ITEMS[1 + k % 8]) if k % 3 else text_of(50, r)) + r.choice(OPEN_ENDS) for k in range(120)]
    block = ItemBlock(sorted(ITEMS.items()))
    together = sorted(leaks_in(block, list(range(120)), texts))
    assert together == sorted(row for k, t in enumerate(texts) for row in leaks_in(block, [k], [t])) and len(together) >= 80


def test_canonical():
    assert canonical("<b>Zażółć</b>&amp;gęślą_jaźń ﬁn\u00adale") == " Zazolc gesla jazn finale"


@pytest.mark.parametrize("times", [1, 40, 200])
def test_second_piece_after_many_copies_of_the_first(times):
    item = [f"w{k}x" for k in range(80)]
    gap = " ".join(f"other{k}" for k in range(30))
    text = f" {gap} ".join([" ".join(item[:25])] * times + [" ".join(item[39:60])])
    ((_, _, share, pieces, _),) = leaks_in(ItemBlock([(1, " ".join(item))]), [7], [text])
    assert (share, pieces) == (46 / 80, 2)


def test_cover_is_that_of_all_pieces():
    r = random.Random(8)
    for _ in range(300):
        pieces = []
        for _ in range(r.randint(1, 90)):
            a, p, n = r.randrange(40), r.randrange(300), r.randint(3, 12)
            pieces.append((a, a + n, p, p + n, n))
        two = [
            y[1] - x[0] - max(0, y[0] - x[1])
            for x in pieces for y in pieces if y[0] > x[0] and y[1] > x[1] and y[2] >= x[3] - leakage.WINDOW
        ]
        words, picked = leakage._covered(pieces)
        assert words == max([c[1] - c[0] for c in pieces] + two)
        x, y = picked[0], picked[-1]
        assert set(picked) <= set(pieces) and y[1] - x[0] - max(0, y[0] - x[1]) == words
        assert len(picked) == 1 or y[2] >= x[3] - leakage.WINDOW


def test_new_name_that_another_item_has():
    story = "yesterday the keeper told {0} that {1} had left the old mill and {0} went to ask {1} about the long road while {0} and {1} slept"
    items = {1: story.format("Anna", "Bruno"), 2: "we know that in the town both Carla and Denis have read all of the many books on this shelf"}
    asked = story.format("Carla", "Denis")
    own = list(leaks_in(ItemBlock([(1, items[1])]), [7], [asked]))
    both = [row for row in leaks_in(ItemBlock(sorted(items.items())), [7], [asked]) if row[1] == 1]
    assert own == both and own[0][2:] == (1.0, 1, 6)
    assert found(items[1], items) == {(7, 1)} and found(items[2], items) == {(7, 2)}


OPEN_ENDS = [" <b class=x", " <!-- open", " &#xE000;", " &#57344; &#xe000;", " &lt;i", " &lt;!-- open", " <", " &", " &#xE000"]


@pytest.mark.parametrize("end", OPEN_ENDS)
def test_documents_of_a_batch_do_not_touch(end):
    block = ItemBlock(sorted(ITEMS.items()))
    texts = [ITEMS[1] + end, "b > c --> " + ITEMS[2], None, end + ITEMS[3] + end, "> --> " + ITEMS[4]]
    alone = [row for k, t in enumerate(texts) for row in leaks_in(block, [k], [t])]
    assert sorted(leaks_in(block, list(range(5)), texts)) == sorted(alone)
    assert {row[:2] for row in alone} == {(0, 1), (1, 2), (3, 3), (4, 4)}


def test_blocks_of_items(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, placed(ITEMS[1]), "x"), (2, placed(ITEMS[2]), "x"), (3, None, "x"), (4, placed(ITEMS[1]), None), (None, ITEMS[1], "x"), (5, "", "x")], "doc_id bigint, text string, item_id string"
    )
    rows = [(i, t, "p") for i, t in ITEMS.items()] + [(20, None, "p"), (None, ITEMS[3], "p"), (21, " ", "p"), (22, "one two", "p"), (1, ITEMS[1], "p")]
    items = spark.createDataFrame(rows, "item_id bigint, text string, doc_id string")
    expected = {(1, 1), (2, 2), (4, 1)}
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == expected
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 3)
    got = leaked_items(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted(expected)
    assert leaked_items(docs, items.where("item_id > 999")).count() == 0
    assert leaked_items(docs.where("doc_id > 999"), items).count() == 0
