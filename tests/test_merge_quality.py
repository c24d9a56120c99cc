import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.operators import merge
from quillspark.operators.quality import QualityError, assert_closed_year, assert_columns, assert_fresh, assert_no_fanout, funnel
from tests.conftest import rows

DAY = dt.date(2026, 1, 5)


def bars(spark, data):
    return spark.createDataFrame(data, "ticker string, date date, close double, at int")


def test_merge_keeps_the_newest(spark):
    old, new = bars(spark, [("A", DAY, 1.0, 1), ("B", DAY, 2.0, 1)]), bars(spark, [("A", DAY, 9.0, 2), ("ZT", DAY, 1.0, 2)])
    got = merge.merge_latest(old, new, keys=["ticker", "date"], newest=["at"], drop=F.col("ticker") == "ZT")
    assert rows(got.select("ticker", "close")) == [("A", 9.0), ("B", 2.0)]
    with pytest.raises(QualityError):
        merge.merge_latest(old, new.drop("at"), keys=["ticker"], newest=["close"])


def test_insert_and_verify(spark):
    old, new = bars(spark, [("A", DAY, 1.0, 1)]), bars(spark, [("A", DAY, 5.0, 2), ("B", DAY, 2.0, 1)])
    fresh = merge.insert_missing(old, new, keys=["ticker", "date"])
    assert rows(fresh.select("ticker")) == [("B",)]
    assert merge.missing_after_write(old, new, keys=["ticker"]).count() == 1
    assert merge.missing_after_write(old.unionByName(fresh), new, keys=["ticker"]).count() == 0


def test_upsert_and_widen(spark):
    old, new = bars(spark, [("A", DAY, 1.0, 1), ("C", DAY, 3.0, 1)]), bars(spark, [("A", DAY, None, 7), ("B", DAY, 2.0, 1)])
    assert rows(merge.upsert(old, new, keys=["ticker", "date"]).select("ticker", "close", "at")) == [("A", 1.0, 7), ("B", 2.0, 1), ("C", 3.0, 1)]
    assert rows(merge.upsert(old, new, keys=["ticker", "date"], keep_old=["at"]).select("ticker", "at")) == [("A", 1), ("B", 1), ("C", 1)]
    r = spark.createDataFrame([("k", 1, 5, 2, "x")], "k string, lo int, hi int, n int, src string")
    s = spark.createDataFrame([("k", 0, 4, 3, "y")], "k string, lo int, hi int, n int, src string")
    assert rows(merge.widen(r, s, keys=["k"], low="lo", high="hi", total="n", label="src")) == [("k", 0, 5, 5, "x and y")]


def test_publish_refuses_to_shrink(spark, tmp_path):
    path = str(tmp_path / "part")
    assert merge.publish_partition(spark, spark.range(10), path) == 10
    with pytest.raises(QualityError):
        merge.publish_partition(spark, spark.range(4), path)
    assert spark.read.parquet(path).count() == 10
    assert merge.publish_partition(spark, spark.range(4), path, restate=True) == 4


def test_write_years_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "years")
    merge.write_years(bars(spark, [("A", dt.date(2020, 1, 1), 1.0, 1), ("A", dt.date(2021, 1, 1), 1.0, 1)]), path)
    merge.write_years(bars(spark, [("A", dt.date(2021, 2, 1), 2.0, 1)]), path)
    assert rows(spark.read.parquet(path).select("date")) == [(dt.date(2020, 1, 1),), (dt.date(2021, 2, 1),)]


def test_freshness_has_to_fail(spark):
    df = bars(spark, [("A", DAY, 1.0, 1)])
    assert assert_fresh(df, day="date", today=DAY, most_days=3)["rows"] == 1
    for bad in (dict(today=dt.date(2026, 2, 1), most_days=3), dict(today=dt.date(2026, 1, 1), most_days=3), dict(today=DAY, most_days=3, least_rows=2), dict(today=DAY, most_days=3, required=("nope",))):
        with pytest.raises(QualityError):
            assert_fresh(df, day="date", **bad)
    with pytest.raises(QualityError):
        assert_fresh(df.limit(0), day="date", today=DAY, most_days=3, least_rows=0)
    with pytest.raises(QualityError):
        assert_closed_year(df, day="date", year=2026)
    with pytest.raises(QualityError):
        assert_no_fanout(df, df.unionByName(df))
    assert assert_columns(df, ["ticker"]) is df


def test_funnel_counts_a_cascade(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False)], "x int, ok boolean")
    assert rows(funnel(df, [("all", F.lit(True)), ("ok", F.col("ok")), ("big", F.col("x") > 5)])) == [(0, "all", 3, 0, False), (1, "ok", 1, 2, False), (2, "big", 0, 1, True)]
