"""The relations that the analytical plans read, as views over a dataset's tables.

Each is one SELECT that Spark and any ANSI engine read alike; ``{name}``
stands for a table.  They hold no analysis: they only rename, cast and pick.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import table

RELATIONS = {
    # one bar per ticker and day: the newest delivery
    "bars": """
select ticker, date, open, high, low, close, volume, security_type, exchange, listing_id, source from (
  select *, row_number() over (partition by ticker, date order by ingested_at desc, source desc, close desc nulls last, volume desc nulls last, open desc nulls last, high desc nulls last, low desc nulls last, listing_id desc nulls last, exchange desc nulls last, security_type desc nulls last) as rn
  from {prices_eod_raw}) t where rn = 1""",
    # a dividend on the 15th, with a split in June; a second one on 1 January
    "actions": """
select distinct ticker, date as ex_date,
  cast(case when extract(day from date) = 15 and extract(month from date) = 6 then 2 when extract(day from date) = 4 and extract(month from date) = 3 then 0.5 else 1 end as decimal(18,8)) as split_factor,
  cast(case when extract(day from date) = 15 then 0.05 else 0 end as decimal(18,8)) as div_cash
from {prices_eod_raw} where extract(day from date) = 15 or (extract(day from date) = 4 and extract(month from date) = 3)""",
    # a filing as an event of the ticker its company held that day
    "study_events": """
select accession as event_id, ticker, filed_date as event_date, deal_type as role from (
  select d.accession, d.filed_date, d.deal_type, h.ticker, row_number() over (partition by d.accession order by h.first_seen desc, h.ticker desc, d.id) as rn
  from {deals} d join {company_ticker_history} h on lpad(trim(d.cik), 10, '0') = h.cik and h.first_seen <= d.filed_date and d.filed_date <= h.last_seen) t where rn = 1""",
    # yearly figures of a filer, one row per concept
    "facts_long": """
select cast(cik as varchar(20)) as cik, concat('Filer ', cast(cik as varchar(20))) as company, cast(2000 + (nation * 37) % 400 as int) as sic, case when nation % 6 = 0 then 'financial' else 'operating' end as sic_class, concept,
  case when status = 'stated' then cast(value as decimal(28,4)) end as value, status, cast(concat(cast(fy as varchar(4)), '-12-31') as date) as period_end, cast(concat(cast(fy + 1 as varchar(4)), '-03-01') as date) as filed, concat(cast(cik as varchar(20)), '-', cast(fy as varchar(4))) as adsh
from (
  select o_custkey as cik, c_nationkey as nation, y.fy, k.concept,
    case when (o_custkey + y.fy + k.n) % 11 = 0 then 'absent' when (o_custkey + y.fy + k.n) % 13 = 0 then 'unmapped' else 'stated' end as status,
    y.total * k.w as value
  from (select o_custkey, cast(extract(year from o_orderdate) as int) as fy, sum(cast(o_totalprice as decimal(18,2))) * 10 as total from {orders} group by o_custkey, cast(extract(year from o_orderdate) as int)) y
  join {customer} on c_custkey = o_custkey
  cross join (select 'revenue' as concept, 1 as n, cast(1.00 as decimal(6,2)) as w union all select 'assets', 2, 1.50 union all select 'operating_cash_flow', 3, 0.20 union all select 'capex', 4, 0.05 union all select 'equity', 5, 0.60 union all select 'liabilities', 6, 0.90 union all select 'net_income', 7, 0.10) k
) f""",
    # the submissions of a filing quarter, all text as in the raw files
    "raw_sub": """
select cast(o_orderkey as varchar(20)) as adsh, cast(o_custkey as varchar(20)) as cik, concat('Filer ', cast(o_custkey as varchar(20)), case when o_orderkey % 9 = 0 then ' Holdings' else '' end) as name,
  case when o_custkey % 17 = 0 then '' else cast(2000 + (o_custkey * 97) % 7500 as varchar(10)) end as sic,
  case when o_orderkey % 4 = 0 then '10-Q' else '10-K' end as form,
  concat(cast(extract(year from o_orderdate) + 20 as varchar(4)), lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'), '28') as period,
  case when o_orderkey % 10 = 1 then 'Q4' else 'FY' end as fp,
  concat(cast(extract(year from o_orderdate) + 21 as varchar(4)), lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'), '05') as filed
from {orders}""",
    "raw_num": """
select cast(l_orderkey as varchar(20)) as adsh, t.tag, case when l_linenumber % 7 = 6 then 'custom/2024' else 'us-gaap/2024' end as version,
  concat(cast(extract(year from o_orderdate) + 20 - (case when l_linenumber = 5 then 1 else 0 end) as varchar(4)), lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'), '28') as ddate,
  cast(t.qtrs as varchar(4)) as qtrs, case when l_returnflag = 'R' and l_linestatus = 'F' then 'CAD' else 'USD' end as uom, case when l_returnflag = 'A' and l_linestatus = 'O' then 'Segment=X' else '' end as segments,
  case when l_linenumber = 7 then 'Parent' else '' end as coreg,
  case when l_quantity < 4 then '' else cast(cast(l_extendedprice as decimal(18,2)) as varchar(30)) end as value
from {lineitem} join {orders} on o_orderkey = l_orderkey
join (select 0 as n, 'Revenues' as tag, 4 as qtrs union all select 1, 'SalesRevenueNet', 4 union all select 2, 'Assets', 0 union all select 3, 'NetIncomeLoss', 4 union all select 4, 'ProfitLoss', 4 union all select 5, 'Liabilities', 0 union all select 6, 'StockholdersEquity', 0) t
  on t.n = (l_partkey + l_linenumber) % 7""",
    "raw_pre": """
select cast(l_orderkey as varchar(20)) as adsh, cast(l_suppkey % 5 as varchar(4)) as report, cast(l_linenumber as varchar(4)) as line, case when l_partkey % 3 = 0 then 'BS' else 'IS' end as stmt, case when l_linestatus = 'O' then '0' else '1' end as inpth,
  case l_partkey % 4 when 0 then 'ResearchAndDevelopmentExpense' when 1 then 'RoyaltyRevenue' when 2 then 'InterestAndFeeIncome' else 'OperatingExpenses' end as tag
from {lineitem}""",
    # plan filings of sponsors
    "plan_filings": """
select plan_year, ein, sponsor_name, case when id % 4 = 0 then '002' else '001' end as plan_num, participants, case when id % 7 = 0 then null else cast(floor(participants * 0.8) as int) end as active, naics, upper(state) as state,
  case when id % 23 = 0 then 'M' end as dfe_code, case when id % 19 = 0 then '1' else '2' end as entity_code, case when id % 11 = 0 then '2L2M' else '2E' end as pension_code, case when id % 4 = 0 then 'short' else 'main' end as form,
  cast(concat(cast(1960 + id % 70 as varchar(4)), '-01-01') as date) as plan_eff_date
from {entity_review}""",
    "sec_names": """
select matched_cik as cik, min(ein) as ein, min(matched_name) as name, case when cast(right(matched_cik, 1) as int) < 5 then concat('T', right(matched_cik, 4)) else '' end as tickers
from {entity_review} where matched_cik is not null group by matched_cik""",
    # open-market purchases
    "buys": """
select cast(user_id as varchar(20)) as issuer, case when event_id % 3 = 0 then 'ten_percent' else 'insider' end as role, cast(event_id % 97 as varchar(10)) as buyer, cast(ts as date) as day, cast(value as decimal(18,2)) as value
from {events} where event_type = 'purchase'""",
    # one observation per series and day, some without a value
    "macro": """
select event_type as series_id, cast(ts as date) as obs_date, case when extract(day from ts) % 5 = 0 then null else cast(sum(cast(value as decimal(18,2))) as decimal(18,2)) end as value
from {events} group by event_type, cast(ts as date), extract(day from ts)""",
}

#: Columns by which the newest delivery of a bar is told, the first ones first; NULL is least.
_BAR_ORDER = ("ingested_at", "source", "close", "volume", "open", "high", "low", "listing_id", "exchange", "security_type")


def _folded_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The relation ``bars`` as a fold: deliveries of a bar combine before they are shuffled, however many there are."""
    newest = F.max(F.struct(*_BAR_ORDER)).alias("n")
    rows = table(spark, folder, "prices_eod_raw").groupBy("ticker", "date").agg(newest)
    return rows.select("ticker", "date", *(f"n.{c}" for c in ("open", "high", "low", "close", "volume", "security_type", "exchange", "listing_id", "source")))


def _facts_by_filer(spark: SparkSession, folder: str) -> DataFrame:
    """The relation ``facts_long`` in order of filers: orders meet once by ``cik``, before there is a row per concept, so folds per filer shuffle nothing more."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("cik"), F.expr("cast(extract(year from o_orderdate) as int)").alias("fy"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    yearly = orders.where("cik is not null").repartition("cik").groupBy("cik", "fy").agg((F.sum("price") * 10).alias("total"))
    filers = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("cik"), F.col("c_nationkey").alias("nation"))
    inner = RELATIONS["facts_long"].partition("from (\n")
    concepts = re.search(r"cross join (\(.*\) k)\n", inner[2]).group(1)
    return spark.sql(
        inner[0] + f"""from (select /*+ merge(c) */ y.cik, c.nation, y.fy, k.concept,
    case when (cast(y.cik as bigint) + y.fy + k.n) % 11 = 0 then 'absent' when (cast(y.cik as bigint) + y.fy + k.n) % 13 = 0 then 'unmapped' else 'stated' end as status, y.total * k.w as value
  from {{yearly}} y join {{filers}} c on c.cik = y.cik cross join {concepts}) f""",
        yearly=yearly, filers=filers,
    )


#: Relations that Spark builds in a better way than the SQL says.
_BUILT = {"bars": _folded_bars, "facts_long": _facts_by_filer}

_TABLE = re.compile(r"\{(\w+)\}")


def relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The relation ``name`` over the tables of ``folder``."""
    if name in _BUILT:
        return _BUILT[name](spark, folder)
    text = RELATIONS[name]
    return spark.sql(text, **{t: table(spark, folder, t) for t in sorted(set(_TABLE.findall(text)))})


def relation_sql(name: str) -> str:
    """The same relation as plain SQL over registered views."""
    return _TABLE.sub(r"\1", RELATIONS[name])


def with_relations(*names: str, then: str) -> str:
    """SQL that defines the relations and goes on with ``then`` (CTEs without 'with', or a SELECT)."""
    ctes = ", ".join(f"{n} as ({relation_sql(n)})" for n in names)
    return f"with {ctes}, {then}" if not then.lstrip().lower().startswith("select") else f"with {ctes} {then}"
