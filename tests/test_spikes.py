import datetime as dt
from decimal import Decimal

import numpy as np
import pytest

from quillspark.operators.spikes import SpikeRules, _frozen, distinct_bars, flag_readings
from tests.conftest import rows

SCHEMA = "ticker string, date date, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume bigint, source string, listing_id date, ingested_at timestamp, z double, row int"


def series(ticker, n, seed, base=50.0):
    rng = np.random.default_rng(seed)
    close = base * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    volume = rng.lognormal(11, 0.3, n).astype(int)
    return [[ticker, dt.date(2020, 1, 1) + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, int(v), "s", None, dt.datetime(2021, 1, 1), 1.0, 1] for i, (c, v) in enumerate(zip(close, volume))]


def frame(spark, data):
    q = lambda x: None if x is None else Decimal(f"{x:.6f}")
    return spark.createDataFrame([[r[0], r[1], *(q(x) for x in r[2:6]), *r[6:]] for r in data], SCHEMA)


@pytest.fixture(scope="module")
def planted(spark):
    data = [r for k in range(6) for r in series(f"T{k}", 300, k)]
    at = lambda k, i: data[k * 300 + i]
    want = set()

    def mark(k, i, field):
        want.add((f"T{k}", "s", at(k, i)[1], field))

    at(0, 100)[5] *= 10  # spike outside its range
    mark(0, 100, "close")
    for i in (150, 151):  # a two-day spike whose bar agrees with it
        for c in (3, 4, 5):
            at(1, i)[c] *= 0.1
        mark(1, i, "close")
    at(2, 60)[5] = -1.0
    mark(2, 60, "close")
    at(2, 200)[6] = -5
    mark(2, 200, "volume")
    at(3, 70)[6] *= 1000
    mark(3, 70, "volume")
    for i in range(201, 215):  # frozen after the first true reading
        at(3, i)[5], at(3, i)[3], at(3, i)[4] = at(3, 200)[5], at(3, 200)[3], at(3, 200)[4]
        mark(3, i, "close")
    for i in range(160, 300):  # a lasting change of level is no case
        for c in (2, 3, 4, 5):
            at(4, i)[c] *= 4
    at(5, 40)[5] = None
    return frame(spark, data), want


def test_planted_cases(spark, planted):
    df, want = planted
    assert {tuple(r) for r in flag_readings(df).collect()} == want


def test_redeliveries_change_nothing(spark, planted):
    df, want = planted
    assert {tuple(r) for r in flag_readings(df.unionByName(df).unionByName(df)).collect()} == want


def test_edges(spark):
    one = frame(spark, [["A", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 5, None, None, dt.datetime(2021, 1, 1), None, None], ["B", dt.date(2020, 1, 1), None, None, None, None, None, "s", None, None, None, None], [None, dt.date(2020, 1, 1), None, None, None, -1.0, None, "s", None, None, None, None], ["C", None, None, None, None, -1.0, None, "s", None, None, None, None], ["D", dt.date(2020, 1, 1), None, None, None, 0.0, None, None, None, None, None, None]])
    assert rows(flag_readings(one)) == [("D", None, dt.date(2020, 1, 1), "close")]
    assert rows(flag_readings(one.limit(0))) == []


def test_newest_delivery_with_a_value(spark):
    day = dt.date(2020, 1, 1)
    df = frame(spark, [["A", day, 1.0, 1.0, 1.0, 1.0, 5, "s", None, dt.datetime(2021, 1, 1), None, None], ["A", day, 1.0, 1.0, 1.0, None, 7, "s", None, dt.datetime(2021, 1, 2), None, None]])
    got = distinct_bars(df).first()
    assert (got["close"], got["volume"]) == (Decimal("1.000000"), 7)
    assert SpikeRules().window > 0


def test_several_frozen_runs():
    x = np.arange(150.0)
    for at in (20, 60, 100):
        x[at : at + 8] = x[at]
    want = np.zeros(150, bool)
    for at in (20, 60, 100):
        want[at + 1 : at + 8] = True
    got = _frozen(x, np.zeros(150, int), 1, SpikeRules())
    assert (got == want).all()
    habit = np.repeat(np.arange(15.0), 10)  # repeats of this length are no habit if nothing shorter repeats
    habit = np.concatenate([np.repeat(np.arange(100.0), 5), 1000 + habit])
    assert not _frozen(habit, np.zeros(len(habit), int), 1, SpikeRules()).any()  # but they are here
