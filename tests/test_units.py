from decimal import Decimal

import pytest

from quillspark.operators.units import parse_unit, quote_unit, stated_unit, to_canonical
from tests.conftest import rows

SCHEMA = "id bigint, kind string, value decimal(28,6), unit string, quote string, k string, v string"


@pytest.mark.parametrize(
    ("text", "kind", "factor"),
    [("$MM", "usd", 10**6), ("USD '000", "usd", 1000), ("000's", "usd", 1000), ("US$ B", "usd", 10**9), ("whole dollars", "usd", 1), ("as printed", "usd", None), ("n/a", "usd", None), ("", "usd", None), (None, "usd", None), ("c/sh", "usd_per_share", Decimal("0.01")), ("per 100 sh, USD", "usd_per_share", Decimal("0.01")), ("bps", "ratio", Decimal("0.0001")), ("per cent", "ratio", Decimal("0.01")), ("fraction of price", "ratio", 1)],
)
def test_unit_column(text, kind, factor):
    got = parse_unit(text, kind)
    assert (got is None) if factor is None else float(got.factor) == pytest.approx(float(factor))


@pytest.mark.parametrize(
    ("quote", "value", "kind", "factor"),
    [("Revenue | 5,000 (in millions, shares in thousands)", "5000", "usd", 10**6), ("Revenue of $1,549.6 mn in fiscal 2020", "1549.6", "usd", 10**6), ("(000's omitted) Revenue 12", "12", "usd", 1000), ("Revenue, excluding 1,250,000 idle shares: 914", "914", "usd", None), ("stated in U.S. dollars, not rounded\nRevenue 7", "7", "usd", 1), ("a price of $10 per 100 shares", "10", "usd_per_share", 0.01), ("a premium of 27% to the last close", "27", "ratio", 0.01), ("a fee of 9 falls due", "9", "usd", None), ("", "1", "usd", None), (None, "1", "usd", None)],
)
def test_quote(quote, value, kind, factor):
    got = quote_unit(quote, value, kind)
    assert (got is None) if factor is None else float(got.factor) == pytest.approx(factor)


def test_quote_holds_over_column():
    assert stated_unit("millions", "Revenue of $5 thousand in fiscal 2020", "5", "usd").factor == 1000


def test_rows(spark):
    data = [(1, "usd", Decimal("1.5"), "millions", None, "x", "y"), (1, "usd", Decimal("1.5"), "millions", None, "x", "y"), (2, "usd", None, "millions", None, None, None), (3, "usd", Decimal(3), None, None, None, None), (4, "ratio", Decimal("27.5"), None, "a premium of 27.5% " + "x" * 100_000, None, None), (5, None, Decimal(3), "millions", None, None, None), (6, "usd_per_share", Decimal("0.00005"), "USD/share", None, None, None)]
    got = rows(to_canonical(spark.createDataFrame(data, SCHEMA), key="id", kind="kind", value="value", unit="unit", quote="quote"))
    assert got == [(1, 1_500_000), (1, 1_500_000), (4, 2750), (6, 1)]
    assert rows(to_canonical(spark.createDataFrame([], SCHEMA), key="id", kind="kind", value="value", unit="unit", quote="quote")) == []


def test_trillions(spark):
    data = [(1, "usd", Decimal("1.5"), "trillions", None, None, None), (2, "usd", Decimal("0.5"), None, "Revenue 0.5 (in trillions)", None, None), (3, "usd", Decimal("2"), "millions", None, None, None)]
    got = rows(to_canonical(spark.createDataFrame(data, SCHEMA), key="id", kind="kind", value="value", unit="unit", quote="quote"))
    assert got == [(1, 1_500_000_000_000), (2, 500_000_000_000), (3, 2_000_000)]


def test_other_currencies_and_offsets(spark):
    data = [
        (1, "usd", Decimal("5"), "EUR millions", None, None, None), (2, "usd", Decimal("5"), "GBP thousands", None, None, None), (3, "usd", Decimal("5"), "millions", "Revenue of €5 million in fiscal 2020", None, None), (4, "usd", Decimal("5"), "millions", "(in millions of euros) Revenue 5", None, None),
        (5, "usd", Decimal("5"), "EUR millions", "Revenue of $5 million in fiscal 2020", None, None), (6, "usd_per_share", Decimal("5"), "C$ per share", None, None, None), (7, "usd_per_share", Decimal("5"), "$ millions per share", None, None, None), (8, "usd", Decimal("5"), "Canadian dollars, in thousands", None, None, None),
        (9, "ratio", Decimal("1.27"), "times the closing price", None, None, None), (10, "ratio", Decimal("1.5"), None, "a price of 1.5 times the last close", None, None), (11, "usd", Decimal("5"), "US$ millions", None, None, None),
    ]
    got = rows(to_canonical(spark.createDataFrame(data, SCHEMA), key="id", kind="kind", value="value", unit="unit", quote="quote"))
    assert got == [(10, 5000), (11, 5_000_000), (5, 5_000_000), (7, 50_000_000_000), (9, 2700)]
