import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspark.plans import deal_text, filers
from tests.conftest import rows

DAY = dt.date


def deals(spark, *more):
    base = [
        # accession, cik, company, filed, value, role, type, ingested, id
        ("whole", "7", "Target Co", DAY(2018, 6, 1), Decimal(100), "seller", "operating", dt.datetime(2018, 6, 2), 1),
        ("kept", "0000000008", "Keeper Co", DAY(2018, 6, 1), Decimal(100), "party", "operating", dt.datetime(2018, 6, 2), 2),
        ("later8k", "9", "Later Co", DAY(2018, 6, 1), Decimal(100), "party", "operating", dt.datetime(2018, 6, 2), 3),
        ("x9", "9", "Later Co", DAY(2019, 6, 1), None, "party", "unclassified", dt.datetime(2019, 6, 2), 4),
        ("recent", "10", "Recent Co", DAY(2021, 1, 1), Decimal(100), "party", "operating", dt.datetime(2021, 6, 2), 5),
        ("buyer", "7", "Target Co", DAY(2018, 1, 1), Decimal(100), "acquirer", "operating", dt.datetime(2018, 6, 2), 6),
        ("division", "7", "Target Co", DAY(2018, 1, 1), Decimal(100), "seller", "division_sale", dt.datetime(2018, 6, 2), 7),
        ("unknown", "11", "No Figures", DAY(2018, 6, 1), Decimal(100), "seller", "operating", dt.datetime(2018, 6, 2), 8),
    ]
    return spark.createDataFrame([*base, *more], "accession string, cik string, company string, filed_date date, value_usd decimal(20,2), filer_role string, deal_type string, ingested_at timestamp, id bigint")


def facts(spark):
    year = lambda cik, y, revenue, income: [(cik, DAY(y, 12, 31), "revenue", None if revenue is None else Decimal(revenue), "stated" if revenue is not None else "absent"), (cik, DAY(y, 12, 31), "net_income", Decimal(income), "stated")]
    data = [*year("7", 2016, 10, 1), *year("7", 2017, 20, -2), *year("8", 2017, 5, 1), *year("8", 2019, 5, 1), *year("9", 2017, 5, 1), *year("10", 2019, 5, 1), *year("12", 2021, 5, 1)]
    return spark.createDataFrame(data, "cik string, period_end date, concept string, value decimal(28,4), status string")


def universe(spark):
    return spark.createDataFrame([(c, DAY(y, 12, 31), "s") for c, y in (("7", 2017), ("8", 2019), ("9", 2017), ("10", 2019))], "cik string, last_period date, status string")


def test_identity_by_the_filing_record(spark):
    got = filers.deal_identity(deals(spark), facts(spark), universe(spark), today="2022-01-01")
    assert dict(rows(got.select("accession", "identity"))) == {"whole": "acquired_whole", "kept": "kept_filing", "later8k": "kept_filing", "recent": "too_recent", "unknown": None}
    with pytest.raises(ValueError, match="universe"):
        filers.deal_identity(deals(spark), facts(spark), None, today="2022-01-01")
    weak = filers.deal_identity(deals(spark), facts(spark), None, today="2022-01-01", by_facts=True)
    assert dict(rows(weak.select("accession", "identity")))["whole"] == "acquired_whole"


def test_multiples_are_of_one_year(spark):
    again = ("whole", "7", "Target Co", DAY(2018, 6, 1), Decimal(300), "seller", "operating", dt.datetime(2018, 7, 2), 0)  # a newer delivery
    found = filers.deal_identity(deals(spark, again), facts(spark), universe(spark), today="2022-01-01")
    got = filers.deal_multiples(found, facts(spark)).select("accession", "value_usd", "pre_end", "revenue", "net_income", "to_revenue", "to_income")
    assert rows(got) == [("whole", Decimal("300.00"), DAY(2017, 12, 31), Decimal("20.0000"), Decimal("-2.0000"), 15.0, None)]
    assert rows(filers.deal_multiples(found.limit(0), facts(spark))) == []


def ask(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_kinds_and_ties(spark):
    t = F.col("text")
    assert ask(spark, deal_text.classify_text(t), "an Agreement and Plan of Merger", "the Credit Agreement and a merger agreement", "nothing", None, "a tender offer under a Settlement Agreement") == ["m_and_a", None, None, None, "settlement"]


def test_value_needs_words_of_a_price(spark):
    texts = ["for an aggregate purchase price of $1.5 billion, of which $20 million in escrow", "an escrow of $5 million", "in a total market of $30 billion", "valued at $750k", "consideration of $9,999", "total of $2,000,000 " + "x" * 300 + " a fee of $9,000,000", None, "aggregate of $ 3.2mm"]
    assert ask(spark, deal_text.deal_value(F.col("text")).cast("bigint"), *texts) == [1_500_000_000, None, None, 750_000, None, 2_000_000, None, 3_200_000]
    assert ask(spark, deal_text.deal_value(F.col("text"), strict=True).cast("bigint"), "a total of $2,000,000 raised", "the acquisition for a total of $2,000,000") == [None, 2_000_000]


def test_consideration_and_figures(spark):
    assert ask(spark, deal_text.consideration(F.col("text")), "paid in cash", "the exchange ratio", "in cash and stock consideration", "x") == ["cash", "stock", "mixed", "not_stated"]
    assert ask(spark, deal_text.target_financials(F.col("text")), "as required by Item 9.01(a)", "revenue of approximately $5 million", "x") == ["rule_305_promised", "figures_in_filing", "none_disclosed"]


def test_parties(spark):
    who = deal_text.parties(F.col("text"), F.lit("Alpha Holdings Inc"))
    texts = ["Alpha, as buyer, entered into an agreement with Beta Merger Sub Inc. and Gamma Foods Inc.", "Alpha agreed to sell its unit to Delta Partners LLC", "an agreement with Epsilon Corp", "as buyer and as seller", "an agreement with Alpha Holdings Inc"]
    assert [tuple(r) for r in ask(spark, who, *texts)] == [
        ("acquirer", "Gamma Foods Inc.", "Alpha Holdings Inc", "Gamma Foods Inc.", "derived_from_role"),
        ("seller", "Delta Partners LLC", "Delta Partners LLC", "Alpha Holdings Inc", "derived_from_role"),
        ("party", "Epsilon Corp", None, None, "counterparty_only"),
        ("not_stated", None, None, None, "not_parsed"),
        ("not_stated", None, None, None, "not_parsed"),
    ]


def test_types(spark):
    t = F.col("text")
    kind = deal_text.deal_type(t, deal_text.classify_text(t))
    texts = ["a merger agreement for its division", "a merger agreement; each share shall be converted into cash, whatever its segment", "a business combination agreement with a blank check company", "asset-backed notes", "lunch"]
    assert ask(spark, kind, *texts) == ["division_sale", "operating", "spac", "securitization", "unclassified"]
    assert ask(spark, deal_text.deal_type(t, F.lit(None).cast("string"), sic=F.lit("6770")), "x") == ["spac"]
    assert ask(spark, deal_text.deal_type(t, F.lit(None).cast("string"), exhibit=F.lit(True)), "x") == ["operating"]


def test_attribution_and_citation(spark):
    data = [("Farmer Bros. Co.", "Farmer Brothers Co", True), ("Sandstorm Gold", "Royal Gold", False), ("Merger Sub, Inc.", "Royal Gold", False), (None, "Royal Gold", False), ("holders of Royal Gold", None, True), ("75th percentile", "Royal Gold", False)]
    df = spark.createDataFrame(data, "a string, b string, want boolean")
    assert df.where(deal_text.attributed(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    df = spark.createDataFrame([("a  Price of\n$5", "He said: A price of $5 each", True), ("a price of $6", "a price of $5", False), ("", "x", False), (None, "x", False), ("x", None, False)], "q string, t string, want boolean")
    assert df.where(deal_text.cites(F.col("q"), F.col("t")) != F.col("want")).count() == 0
