import pytest

from quillspark.llm.leaks import LeakFinder, leaked_passages, tokens_of, tokens_with_offsets
from tests.conftest import rows

ITEM = "In 2021 the Sifes council leased 272 moorings to Fogomun for a restated term. Which of the 316 schedules would a clerk at Dabo reopen? The apprentice copied Rimu as Supa, an error worth $5,307,811 by May 3."
OTHER = "In 2011 the Gupo council leased 12 moorings to Lasan for a restated term. Which of the 44 schedules would a clerk at Mefa reopen? The apprentice copied Toba as Nilo, an error worth $9,001,222 by June 9."
ZH = "学徒远云云数得541匣恒岭却记作17匣差额归明川承担试比较丰恒盛账与云石恒账在2020年的12笔出入"


def leaks(text):
    return {i for i, *_ in LeakFinder([(1, ITEM), (2, OTHER), (3, ZH)]).find(text)}


def test_forms_of_copying():
    filler = "Revenue rose this year. " * 30
    assert leaks(filler + ITEM + filler) == {1}
    assert leaks(filler + ITEM.upper().replace(" ", "  ")) == {1}
    assert leaks(ITEM.replace("council", "<b>council</b>").replace("clerk", "cle​rk").replace(".", "")) == {1}
    words = ITEM.split()
    assert leaks(" ".join("any" if i % 10 == 4 else w for i, w in enumerate(words))) == {1}  # one word in ten
    assert leaks(" ".join(words[: len(words) // 2])) == {1}
    assert leaks(" ".join(words[:12]) + " " + filler + " ".join(words[-14:])) == {1}  # two pieces
    assert leaks("，".join(ZH[i : i + 7] for i in range(0, len(ZH), 7))) == {3}


def test_no_cases():
    assert leaks("In 2019 the Poru council leased 99 moorings to Datem for a restated term. Which of the 7 schedules would a clerk at Kilo reopen?") == set()
    assert leaks("for a restated term") == set()
    assert leaks(" ".join(ITEM.split()[:8])) == set()  # too little
    assert leaks("") == set() and leaks(None) == set()


def test_offsets_point_into_the_original():
    text = "Caf́é <i>Sum</i>​mer, 1,234.5 été"
    tokens, spans = tokens_with_offsets(text)
    assert tokens == tokens_of(text)
    assert text[spans[-1][0] : spans[-1][1]] == "été"
    doc = "Before it. " + ITEM + " After it."
    (_, share, a, b), *_rest = LeakFinder([(1, ITEM)]).find(doc)
    assert share > 0.99 and doc[a:b] == ITEM.rstrip(".")


def test_tables(spark):
    docs = spark.createDataFrame([(1, "x " * 100_000 + ITEM, 9), (2, None, 9), (3, "", 9), (4, OTHER, 9), (4, OTHER, 9), (None, ITEM, 9)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, ITEM, 1), (11, ITEM, 1), (12, OTHER, 1), (12, OTHER, 1), (13, None, 1), (14, "", 1), (None, ITEM, 1)], "item_id bigint, text string, doc_id int")
    assert rows(leaked_passages(docs, items).select("doc_id", "item_id")) == [(1, 10), (1, 11), (4, 12), (4, 12)]
    assert rows(leaked_passages(docs.limit(0), items)) == []
    assert rows(leaked_passages(docs, items.limit(0))) == []


def test_near_copies_share_pieces():
    words = [f"word{chr(97 + i)}{chr(97 + 7 * i % 26)}" for i in range(26)]
    first, second = " ".join(words), " ".join(words[:-1] + ["other"])
    finder = LeakFinder([(1, first), (2, second)])
    text = "before it " + " ".join(words[:20]) + " and after it"
    assert sorted(r[0] for r in finder.find(text)) == [1, 2]
    assert finder.find("before it " + " ".join(words[:6]) + " and after it") == []  # a mere phrase


def test_shared_context():
    context = "The harbour ledger of Teluso lists nineteen barges, forty crates of lamp oil and a clerk named Budovan who signed for all of them in June."
    finder = LeakFinder([(1, context + " How many barges does the ledger list?"), (2, context + " Who signed for the lamp oil that came in June?")])
    found = finder.find("Some words first. " + context + " Some words after.")
    text = "Some words first. " + context + " Some words after."
    assert sorted(r[0] for r in found) == [1, 2]
    assert all(text[a:b] == context.rstrip(".") and share > 0.6 for _, share, a, b in found)


def test_long_tags_and_comparisons():
    assert tokens_of("one <span " + 'style="x" ' * 40 + ">two</span> a < b and c > d") == ["one", "two", "a", "b", "and", "c", "d"]


def test_limits(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id bigint, text string")
    for limit in ({"most_items": 1}, {"most_letters": 10}):
        with pytest.raises(ValueError):
            leaked_passages(docs, items, **limit)
