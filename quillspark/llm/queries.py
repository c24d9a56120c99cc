"""Queries of the training-text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.exprs import iso
from quillspark.llm.leaks import leaked_passages
from quillspark.llm.mixing import mix_shares, mix_sources
from quillspark.llm.names import entity_classes, entity_pairs
from quillspark.llm.nearest import nearest_day
from quillspark.llm.sentences import split_sentences
from quillspark.operators.filings import ticker_at_filing
from quillspark.session import checkpointed
from quillspark.sources.tables import table


def _all_names(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "entity_review")
    return reviews.select(F.explode(F.array("sponsor_name", "matched_name")).alias("name")).where("name is not null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different spellings of one organisation."""
    return entity_pairs(entity_classes(_all_names(spark, d)))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its organisation and how many spellings that has."""
    classes = entity_classes(_all_names(spark, d))
    return classes.join(classes.groupBy("entity").agg(F.count("*").alias("spellings")), "entity").select("name", "entity", "spellings")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The bar nearest to each filing, at most five days off."""
    held = checkpointed(ticker_at_filing(table(spark, d, "deals"), table(spark, d, "company_ticker_history")))  # read twice below
    bars = table(spark, d, "prices_eod_raw").where("close is not null").select("ticker", "date")
    near = nearest_day(held, bars, left_key="ticker", left_day="filed_date", right_key="ticker", right_day="date", tolerance=5, out="bar")
    return held.join(near, ["ticker", "filed_date"]).select("accession", "ticker", iso("bar").alias("bar_date"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the test items that leaked into them."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_passages")).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The leaks with the share of the item that stands in the document and where."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the training mix, what each counts for, and how often it appears."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches."""
    return mix_shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document."""
    return split_sentences(table(spark, d, "documents"))


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities, "p6_found": p6_found, "p8_found": p8_found, "p8_spans": p8_spans, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}

_CIK = "lpad(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), 10, '0')"

ORACLE_SQL = {
    "p6_found": f"""
with d as (select distinct accession, {_CIK} as k, filed_date from deals),
h as (select distinct {_CIK} as k, ticker, first_seen, last_seen from company_ticker_history),
t as (select * from (select d.accession, d.filed_date, h.ticker, row_number() over (partition by d.accession order by h.first_seen desc, h.last_seen desc, h.ticker desc) as rn
  from d join h on d.k = h.k and h.first_seen <= d.filed_date and d.filed_date <= h.last_seen) where rn = 1),
b as (select distinct ticker, date from prices_eod_raw where close is not null)
select accession, ticker, strftime(date, '%Y-%m-%d') as bar_date from (
  select t.accession, t.ticker, b.date, row_number() over (partition by t.accession order by abs(b.date - t.filed_date), b.date) as rn
  from t join b on b.ticker = t.ticker and b.date between t.filed_date - 5 and t.filed_date + 5) where rn = 1""",
}
