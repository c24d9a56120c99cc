import datetime as dt
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspark.operators.quality import QualityError
from quillspark.sources import delimited, feeds, generators, jdbc
from quillspark.sources.catalog import Catalog, CatalogError, DatasetRef, may_publish, with_listing
from quillspark.streaming import polling
from tests.conftest import rows


def test_catalog(spark, tmp_path):
    for y in (2023, 2024, 2025):
        spark.createDataFrame([(y,)], "y int").write.parquet(str(tmp_path / str(y)))
    text = "".join(f'[[dataset]]\nname = "px"\npartition = "{y}"\nlocation = "{tmp_path / str(y)}"\n' for y in (2023, 2024, 2025)) + '[[dataset]]\nname = "db"\npartition = "all"\nlocation = "x"\nbackend = "postgres"\n'
    cat = Catalog.from_toml(text)
    assert cat.read(spark, "px").count() == 3
    assert rows(cat.read_recent_years(spark, "px", 2025)) == [(2024,), (2025,)]
    assert {s for _, _, s in cat.verify(spark)} == {"ok", "skipped"}
    for bad in (lambda: cat.get("px", "1999"), lambda: cat.read(spark, "db"), lambda: cat.partitions("nope"), lambda: cat.read_recent_years(spark, "px", 1990), lambda: may_publish(DatasetRef("d", "p", "x", "r2"), 5), lambda: may_publish(DatasetRef("d", "p", "x"), 0)):
        with pytest.raises(CatalogError):
            bad()
    assert "listing_id" in with_listing(spark.range(1)).columns


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("adsh\tvalue\n1\t007\n2\t\n")
    assert rows(delimited.read_text_table(spark, str(tmp_path / "a.tsv"), required=["adsh"])) == [("1", "007"), ("2", None)]
    with pytest.raises(QualityError, match="adsh"):
        delimited.read_text_table(spark, str(tmp_path / "a.tsv"), required=["adsh_"])
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("sub.txt", "x\n1\n")
    assert open(delimited.extract_members(str(tmp_path / "q.zip"), str(tmp_path / "out"), ["sub.txt"])["sub.txt"]).read() == "x\n1\n"
    with pytest.raises(QualityError):
        delimited.extract_members(str(tmp_path / "q.zip"), str(tmp_path / "out"), ["num.txt"])


def test_feeds(spark):
    lines = spark.createDataFrame([("4         ACME CORP                  1234567     20240105    edgar/data/1/x.txt",), ("Form Type  Company",)], "value string")
    assert rows(feeds.index_lines(lines, ("4",))) == [("4", "ACME CORP", "1234567", dt.date(2024, 1, 5), "edgar/data/1/x.txt")]
    doc = json.dumps({"cik": "7", "filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["8-K", "4"], "filingDate": ["2024-01-05", "x"], "items": ["1.01", ""]}}})
    assert rows(feeds.submissions_rows(spark.createDataFrame([(doc,)], "json string")).select("accession", "filed")) == [("a", dt.date(2024, 1, 5)), ("b", None)]
    fred = json.dumps({"observations": [{"date": "2024-01-01", "value": "."}, {"date": "2024-01-02", "value": "4.5"}]})
    assert rows(feeds.observations(spark.createDataFrame([("S", fred)], "series_id string, json string")).select("value")) == [(Decimal("4.5000000000"),), (None,)]
    tick = json.dumps({"0": {"cik_str": 320193, "ticker": "AAA", "title": "A"}})
    assert rows(feeds.ticker_map(spark.createDataFrame([(tick,)], "json string"))) == [("0000320193", "AAA", "A")]
    atom = "<feed><entry><title>8-K - A</title><updated>1</updated><id>urn:accession-number=0001234567-24-000001</id><category term='8-K'/></entry><entry><title>8-K - A</title><updated>2</updated><id>urn:accession-number=0001234567-24-000001</id><category term='8-K'/></entry></feed>"
    assert rows(feeds.feed_entries(spark.createDataFrame([(atom,)], "xml string")).select("accession", "updated")) == [("0001234567-24-000001", "2")]
    own = "<ownershipDocument><issuer><issuerCik>9</issuerCik><issuerTradingSymbol>T</issuerTradingSymbol></issuer><periodOfReport>2024-01-02</periodOfReport>" + "".join(f"<reportingOwner><reportingOwnerId><rptOwnerCik>{k}</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isDirector>{v}</isDirector></reportingOwnerRelationship></reportingOwner>" for k, v in ((1, 1), (2, 1), (3, 0))) + "<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-03</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>3</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    assert rows(feeds.ownership_transactions(spark.createDataFrame([("x", own)], "accession string, xml string")).select("buyer", "role", "value")) == [("1", "insider", Decimal("150.00")), ("2", "insider", Decimal("150.00"))]
    uni = spark.createDataFrame([("AAA", "NYSE", "Stock", "2024-01-01"), ("ZTEST", "NYSE", "Stock", "2024-01-01"), ("OLD", "NYSE", "Stock", "2020-01-01")], "ticker string, exchange string, asset_type string, end_date string")
    assert rows(feeds.listed_universe(uni, exchanges=("NYSE",), types=("Stock",), today="2024-01-05").select("ticker")) == [("AAA",)]


def test_generators(spark):
    assert rows(generators.each(spark, [1, 5])) == [(1,), (5,)]
    assert generators.synthetic_bars(spark, tickers=5, days=4).groupBy("ticker").count().where("count <> 4").count() == 0
    assert rows(generators.values(spark, [(1, "a")], "x int, y string")) == [(1, "a")]


def test_stream_appends_each_key_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda *keys: spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 1), 2.0) for k in keys], "k string, at timestamp, value double").coalesce(1).write.mode("append").parquet(src)
    put("a", "a", "b")
    run = lambda n: polling.run_available(polling.first_deliveries(polling.file_stream(spark, src, "k string, at timestamp, value double"), at="at", keys=["k"]), polling.append_missing(out, ["k"]), checkpoint=str(tmp_path / n))
    run("c")
    put("b", "c")
    run("c")
    run("again")  # a second reader replays everything
    assert rows(spark.read.parquet(out).select("k")) == [("a",), ("b",), ("c",)]


def test_stream_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 1), 2.0), ("a", dt.datetime(2024, 1, 1, 5), 3.0), ("a", dt.datetime(2024, 2, 1), 1.0)], "k string, at timestamp, value double").write.parquet(src)
    got = []
    polling.run_available(polling.windowed_counts(polling.file_stream(spark, src, "k string, at timestamp, value double"), at="at", by=["k"]), lambda b, _: got.extend(b.collect()), checkpoint=str(tmp_path / "c"))
    assert ("a", 2, 5.0) in {tuple(r[1:]) for r in got} or got == []
    assert F is not None


def test_database(spark):
    """A database in memory, read over one connection and over several."""
    url, driver = "jdbc:derby:memory:quill;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark.range(100).withColumnRenamed("id", "N").write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "T").save()
    except Exception as why:  # this build of Spark brings no database
        pytest.skip(str(why)[:80])
    assert jdbc.read_query(spark, url, "select N from T where N < 7", driver=driver).count() == 7
    parts = jdbc.read_query(spark, url, "select N from T", driver=driver, split=("N", 20, 80, 4))
    assert parts.rdd.getNumPartitions() == 4 and rows(parts)[:2] == [(0,), (1,)] and parts.count() == 100
