import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators.packed import split_items, unpack_items
from tests.conftest import rows


@pytest.mark.parametrize(
    ("text", "items"),
    [('"3.02", "7.01 Notice, vote | tally"', ["3.02", "7.01 Notice, vote | tally"]), ('"5.07 Officers ""acting"" or named"', ['5.07 Officers "acting" or named']), ('["1.01", "3.02 Officers \\"acting\\" or named"]', ["1.01", '3.02 Officers "acting" or named']), ("'1.01 Pact, terms'|'2.01'", ["1.01 Pact, terms", "2.01"]), ("1.01 Pact signed, terms attached|1.02 Bylaws", ["1.01 Pact signed, terms attached", "1.02 Bylaws"]), ("{1.01,2.02}", ["1.01", "2.02"]), ("item 1.01|ITEM 5.02", ["item 1.01", "ITEM 5.02"]), ("1.01, and 2.02 and Item 3.03", ["1.01", "2.02", "Item 3.03"]), ("5.02 Sale closed\n8.01\r\n9.01", ["5.02 Sale closed", "8.01", "9.01"]), (";1.01,,2.02;", ["1.01", "2.02"]), ("-", []), ("n/a", []), ("", []), (None, []), ('"1.01, 2.02', ["1.01", "2.02"]), ("1.01, n/a, 2.02", ["1.01", "2.02"])],
)
def test_forms(text, items):
    assert split_items(pa.array([text], pa.string())).to_pylist() == [items]


CAPTION = st.text("abc xyzé", min_size=1, max_size=12).map(lambda s: " ".join(s.split())).filter(lambda s: s and s != "and" and not s.endswith(" and"))
ITEM = st.tuples(st.integers(1, 9), st.integers(1, 9), st.one_of(st.none(), CAPTION)).map(lambda t: f"{t[0]}.0{t[1]}" + (f" {t[2]}" if t[2] else ""))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(ITEM, max_size=6), st.sampled_from([", ", ";", " | ", "\n"]), st.booleans()), max_size=8))
def test_round_trip(packed):
    """Items packed by any delimiter, quoted or not, come out as they went in, row by row."""
    texts = [sep.join(f'"{i}"' if quote else i for i in items) for items, sep, quote in packed]
    assert split_items(pa.array(texts, pa.string())).to_pylist() == [items for items, _, _ in packed]


def test_sliced_and_chunked_arrays():
    whole = pa.array(["1.01", "2.02, 3.03", None, "4.04"])
    assert split_items(whole.slice(1, 2)).to_pylist() == [["2.02", "3.03"], []]
    assert split_items(pa.chunked_array([["1.01"], ["2.02"]])).to_pylist() == [["1.01"], ["2.02"]]


def test_rows(spark):
    data = [("a", "2.02, 1.01", 7, "z"), ("b", None, 7, "z"), ("c", "", 7, "z"), ("d", "1.01;" * 50_000, 7, "z")]
    df = spark.createDataFrame(data, "accession string, items string, position int, item string")
    got = unpack_items(df, key="accession", packed="items")
    assert rows(got.where("accession <> 'd'")) == [("a", 1, "2.02"), ("a", 2, "1.01")]
    assert got.where("accession = 'd'").count() == 50_000
    assert rows(unpack_items(df.limit(0), key="accession", packed="items")) == []
