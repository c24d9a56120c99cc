import datetime as dt
import random

from quillspark.operators.intervals import periods_and_gaps
from tests.conftest import rows

SCHEMA = "k string, a date, b date, day string, delta int"


def d(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def brute(ranges):
    out = []
    for key in sorted({k for k, _, _ in ranges}):
        days = sorted({x for k, a, b in ranges if k == key for x in range(a, b + 1)})
        periods = []
        for x in days:
            if periods and periods[-1][1] + 1 == x:
                periods[-1][1] = x
            else:
                periods.append([x, x])
        for i, (a, b) in enumerate(periods):
            out.append((key, "period", d(a), d(b)))
            if i + 1 < len(periods):
                out.append((key, "gap", d(b + 1), d(periods[i + 1][0] - 1)))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def test_against_brute_force(spark):
    rnd = random.Random(4)
    ranges = [(f"k{rnd.randint(0, 6) if rnd.random() < 0.6 else 0}", a := rnd.randint(0, 300), a + rnd.randint(0, 12)) for _ in range(160)]
    df = spark.createDataFrame([(k, d(a), d(b), "x", 1) for k, a, b in ranges], SCHEMA)
    assert rows(periods_and_gaps(df, key="k", start="a", end="b")) == brute(ranges)


def test_edges(spark):
    data = [("a", d(1), d(3)), ("a", d(1), d(3)), ("a", d(4), d(4)), ("a", None, d(9)), ("a", d(9), None), ("a", d(9), d(8)), (None, d(1), d(2)), ("b", d(6), d(6))]
    df = spark.createDataFrame([(*r, None, None) for r in data], SCHEMA)
    assert rows(periods_and_gaps(df, key="k", start="a", end="b")) == [("a", "period", d(1), d(4)), ("b", "period", d(6), d(6))]
    assert rows(periods_and_gaps(spark.createDataFrame([], SCHEMA), key="k", start="a", end="b")) == []
