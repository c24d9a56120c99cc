import datetime as dt
import random

from quillspark.llm.nearest import nearest_day
from tests.conftest import rows

ARGS = dict(left_key="t", left_day="d", right_key="s", right_day="day", tolerance=5)


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    left = [(rnd.choice("ab"), d(rnd.randint(0, 120))) for _ in range(80)]
    right = [(rnd.choice("abc"), d(rnd.randint(0, 120))) for _ in range(40)]
    want = []
    for k, day in set(left):
        near = sorted((abs((r - day).days), r) for s, r in right if s == k)
        if near and near[0][0] <= 5:
            want.append((k, day, near[0][1]))
    got = rows(nearest_day(spark.createDataFrame(left, "t string, d date"), spark.createDataFrame(right, "s string, day date"), **ARGS))
    assert got == sorted(want, key=lambda r: tuple((False, str(x)) for x in r))


def test_edges(spark):
    left = spark.createDataFrame([("a", d(10), 1), ("a", d(10), 1), ("a", d(50), 1), (None, d(10), 1), ("a", None, 1), ("b", d(3), 1)], "t string, d date, day int")
    right = spark.createDataFrame([("a", d(12), 1), ("a", d(8), 1), ("a", d(8), 1), ("a", None, 1), (None, d(10), 1)], "s string, day date, d int")
    assert rows(nearest_day(left, right, **ARGS)) == [("a", d(10), d(8))]  # the earlier of two equally near
    assert rows(nearest_day(left.limit(0), right, **ARGS)) == []
    assert rows(nearest_day(left, right.limit(0), **ARGS)) == []
