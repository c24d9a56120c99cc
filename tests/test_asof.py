import datetime as dt
import random

from quillspark.operators.asof import attribute_at
from quillspark.operators.filings import distinct_filings, ticker_at_filing
from tests.conftest import rows

ARGS = dict(event_key="cik", event_day="day", key="cik", first="a", last="b", value="ticker")


def d(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_against_brute_force(spark):
    rnd = random.Random(9)
    versions = [(f"c{rnd.randint(0, 4)}", d(a := rnd.randint(0, 200)), d(a + rnd.randint(0, 60)), f"T{i}") for i in range(80)]
    events = [(f"c{rnd.randint(0, 5)}", d(rnd.randint(0, 260))) for _ in range(300)]
    got = rows(attribute_at(spark.createDataFrame(events, "cik string, day date"), spark.createDataFrame(versions, "cik string, a date, b date, ticker string"), **ARGS, buckets=3))
    want = []
    for k, day in sorted(set(events)):
        open_now = [(a, b, t) for c, a, b, t in versions if c == k and a <= day <= b]
        want.append((k, day, max(open_now)[2] if open_now else None))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_edges(spark):
    versions = spark.createDataFrame([("c", d(0), d(9), "OLD", 1), ("c", d(5), d(6), "NEW", 1), ("c", d(5), d(6), "NEW", 1), ("c", None, d(99), "X", 1), ("c", d(8), d(7), "Y", 1), (None, d(0), d(9), "Z", 1), ("c", d(2), d(3), None, 1)], "cik string, a date, b date, ticker string, day int")
    events = spark.createDataFrame([("c", d(5), "q"), ("c", d(5), "q"), ("c", d(7), "q"), ("c", d(50), "q"), ("c", None, "q"), (None, d(5), "q"), ("c", d(2), "q")], "cik string, day date, ticker string")
    assert rows(attribute_at(events, versions, **ARGS)) == [("c", d(2), "OLD"), ("c", d(5), "NEW"), ("c", d(50), None), ("c", d(7), "OLD")] or rows(attribute_at(events, versions, **ARGS)) == sorted([("c", d(2), "OLD"), ("c", d(5), "NEW"), ("c", d(50), None), ("c", d(7), "OLD")], key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(attribute_at(events.limit(0), versions, **ARGS)) == []
    assert {r[2] for r in rows(attribute_at(events, versions.limit(0), **ARGS))} == {None}


def test_filings_fold_and_keys_meet(spark):
    t0, t1 = dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 9)
    deals = spark.createDataFrame([("x", " 42", d(5), "1.01", t0), ("x", "0000000042", d(5), None, t1), ("y", "7", d(5), "2.02", t0), (None, "42", d(5), "2.02", t0), ("z", None, d(5), "2.02", t0)], "accession string, cik string, filed_date date, items string, ingested_at timestamp")
    hist = spark.createDataFrame([("0000000042", "AAA", d(0), d(9))], "cik string, ticker string, first_seen date, last_seen date")
    assert rows(distinct_filings(deals).select("accession", "items")) == [("x", "1.01"), ("y", "2.02"), ("z", "2.02")]
    assert rows(ticker_at_filing(deals, hist)) == [("x", "AAA", d(5))]
