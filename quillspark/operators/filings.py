"""Relations over the filing tables that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.exprs import cik_key
from quillspark.operators.asof import attribute_at


def distinct_filings(deals: DataFrame) -> DataFrame:
    """One row per accession: ``accession, cik10, filed_date, items``.

    Redeliveries fold into the latest delivery that has the field; deliveries
    at the same instant fold to the greatest value.  A NULL accession is no
    filing.  The fold has a map-side part, so a filing delivered very often
    does not gather its copies in one task.
    """
    at = F.col("ingested_at")
    newest = lambda c, name: F.max(F.when(c.isNotNull(), F.struct(at.alias("at"), c.alias("x"))))["x"].alias(name)
    return deals.where("accession is not null").groupBy("accession").agg(newest(cik_key("cik"), "cik10"), newest(F.col("filed_date"), "filed_date"), newest(F.col("items"), "items"))


def ticker_at_filing(deals: DataFrame, history: DataFrame, *, buckets: int | None = None) -> DataFrame:
    """``accession, ticker, filed_date`` of each filing whose company held a ticker on its day."""
    filings = distinct_filings(deals.select("accession", "cik", "filed_date", "items", "ingested_at")).select("accession", "cik10", "filed_date")
    known = history.select(cik_key("cik").alias("cik10"), "ticker", "first_seen", "last_seen")
    held = attribute_at(deals.select(cik_key("cik").alias("cik10"), "filed_date"), known, event_key="cik10", event_day="filed_date", key="cik10", first="first_seen", last="last_seen", value="ticker", buckets=buckets)
    return filings.join(held.where("ticker is not null"), ["cik10", "filed_date"]).select("accession", "ticker", "filed_date")
