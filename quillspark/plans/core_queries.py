"""Queries of the general training-data problems (units, spikes, as-of, periods, packed items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.exprs import iso
from quillspark.operators.filings import distinct_filings, ticker_at_filing
from quillspark.operators.intervals import periods_and_gaps
from quillspark.operators.packed import unpack_items
from quillspark.operators.spikes import flag_readings
from quillspark.operators.units import to_canonical
from quillspark.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every stated revenue, fee, consideration and premium in its field's common unit."""
    projections = table(spark, d, "proxy_projection").withColumn("kind", F.lit("usd"))
    figures = table(spark, d, "proxy_figure").withColumn("kind", F.when(F.col("field") == "consideration_per_share", "usd_per_share").when(F.col("field") == "premium_pct", "ratio").when(F.col("field") == "termination_fee", "usd"))
    parts = [("proxy_projection", projections, "revenue", "units"), ("proxy_figure", figures, "value", "unit")]
    found = [to_canonical(t, key="id", kind="kind", value=v, unit=u, quote="quote").select(F.lit(name).alias("src_table"), F.col("id").alias("row_id"), "common_value") for name, t, v, u in parts]
    return found[0].unionByName(found[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Bars whose close or volume cannot be true."""
    return flag_readings(table(spark, d, "prices_eod_raw")).select("ticker", "source", iso("bar_date").alias("bar_date"), "field")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The ticker that each filing's company held on its day."""
    return ticker_at_filing(table(spark, d, "deals"), table(spark, d, "company_ticker_history")).select("accession", "ticker")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous listed periods of each company and the gaps between them."""
    got = periods_and_gaps(table(spark, d, "company_ticker_history"), key="cik", start="first_seen", end="last_seen")
    return got.select("cik", "kind", iso("start_date").alias("start_date"), iso("end_date").alias("end_date"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per packed 8-K item of each filing."""
    return unpack_items(distinct_filings(table(spark, d, "deals")), key="accession", packed="items")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found}

_CIK = "lpad(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), 10, '0')"

ORACLE_SQL = {
    "p4_found": f"""
with d as (select distinct accession, {_CIK} as k, filed_date from deals),
     h as (select distinct {_CIK} as k, ticker, first_seen, last_seen from company_ticker_history)
select accession, ticker from (
  select d.accession, h.ticker, row_number() over (partition by d.accession order by h.first_seen desc, h.last_seen desc, h.ticker desc) as rn
  from d join h on d.k = h.k and h.first_seen <= d.filed_date and d.filed_date <= h.last_seen
) where rn = 1""",
    "p5_found": """
with r as (select distinct cik, first_seen as s, last_seen as e from company_ticker_history where first_seen <= last_seen),
o as (select *, max(e) over (partition by cik order by s, e rows between unbounded preceding and 1 preceding) as reach from r),
g as (select *, sum(case when reach is null or s > reach + 1 then 1 else 0 end) over (partition by cik order by s, e rows between unbounded preceding and current row) as grp from o),
p as (select cik, min(s) as s, max(e) as e from g group by cik, grp),
n as (select *, lead(s) over (partition by cik order by s) as nxt from p)
select cik, 'period' as kind, strftime(s, '%Y-%m-%d') as start_date, strftime(e, '%Y-%m-%d') as end_date from n
union all
select cik, 'gap' as kind, strftime(e + 1, '%Y-%m-%d') as start_date, strftime(nxt - 1, '%Y-%m-%d') as end_date from n where nxt is not null""",
}
