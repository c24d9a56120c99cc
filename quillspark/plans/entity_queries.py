"""Queries over names and symbols of companies and the daily promotion, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quillspark.plans import entities, sponsors
from quillspark.plans.adapters import relation, with_relations
from quillspark.sources.tables import table

DAY = date(2025, 12, 24)


def name_bare(spark, d):
    """Sponsors' names without accents and endings, and how many names share each."""
    n = table(spark, d, "entity_review").select("sponsor_name").where("sponsor_name is not null").distinct()
    return n.groupBy(entities.bare_name(F.col("sponsor_name")).alias("bare")).agg(F.count("*").alias("names"))


def symbol_gaps(spark, d):
    """Symbols with bars that no company has held, and what explains it."""
    bars = table(spark, d, "prices_eod_raw").groupBy("ticker").agg(F.max("exchange").alias("exchange"))
    return entities.symbol_gaps(bars, table(spark, d, "company_ticker_history"))


def fund_clusters(spark, d):
    """Sponsors of several plans' names read as buyers of the matched registrant: how many look like funds buying a fund."""
    r = table(spark, d, "entity_review").where("matched_name is not null and sponsor_name is not null").groupBy("matched_name").agg(F.array_sort(F.collect_set("sponsor_name")).alias("buyers"))
    return r.select(entities.fund_like(F.col("buyers"), F.lit(None).cast("string"), F.col("matched_name")).alias("why")).groupBy("why").agg(F.count("*").alias("clusters"))


def promote_session(spark, d):
    """The filers that one session's moves, filings and purchase clusters promote."""
    bars = relation(spark, d, "bars").where((F.col("date") == F.lit(DAY)) & (F.col("open") > 0) & F.col("close").isNotNull())
    listed = bars.select("ticker", F.lower("security_type").alias("security_type"), F.round((F.col("close").cast("double") - F.col("open").cast("double")) / F.col("open").cast("double") * 100, 6).alias("pct_move"))
    held = table(spark, d, "company_ticker_history").select("ticker", "cik", F.lit(None).cast("string").alias("company"), F.col("last_seen"))
    deals = table(spark, d, "deals").where("accession is not null").select("cik", "company", "filed_date", "deal_type")
    buys = relation(spark, d, "buys").groupBy("issuer", "role", "day").agg(F.countDistinct("buyer").alias("n")).where("n >= 2")
    clusters = buys.select(F.concat_ws(":", F.lit("cluster"), "issuer", "role", F.date_format("day", "yyyy-MM-dd")).alias("key"), F.to_timestamp(F.date_add(F.lit(DAY), -F.dayofmonth("day"))).alias("at"))
    return entities.promote_day(DAY, listed, held, deals, clusters)


def review_queue_order(spark, d):
    """The sponsors that only a name finds, exact names and few candidates first (a top-k report)."""
    history = sponsors.resolve_sponsors(sponsors.sponsor_rollup(relation(spark, d, "plan_filings")), relation(spark, d, "sec_names"))
    return sponsors.review_queue(history).limit(100).select("plan_year", "ein", "match_basis", "candidates")


QUERIES = {f.__name__: f for f in (name_bare, symbol_gaps, fund_clusters, promote_session, review_queue_order)}

_CIK = "lpad(nullif(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), ''), 10, '0')"
_SUFFIX = "|".join(entities.ENTITY_SUFFIXES)


def _without_class(text: str) -> str:
    for suffix in entities.CLASS_SUFFIXES:
        text = f"regexp_replace({text}, '(\\S) {suffix}$', '\\1')"
    return text


def _words(name: str, words: tuple[str, ...]) -> str:
    return f"list_has_any(list_transform(regexp_extract_all({name}, '[A-Za-z][A-Za-z&.'']*'), lambda w: upper(trim(w, '.'))), {list(words)})"


_PLAIN = "regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(sponsor_name)), '&', ' and '), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^the\\s+', '')"

ORACLE_SQL = {
    "name_bare": f"select regexp_replace({_without_class(_PLAIN)}, '(\\S)( ({_SUFFIX}))+$', '\\1') as bare, count(*) as names from (select distinct sponsor_name from entity_review where sponsor_name is not null) group by 1",
    "symbol_gaps": """
with lost as (select ticker, max(exchange) as exchange from prices_eod_raw where ticker not in (select ticker from company_ticker_history where ticker is not null) group by 1),
known as (select distinct ticker as t from company_ticker_history),
x as (select *, replace(ticker, '-', '.') in (select t from known) or replace(ticker, '.', '-') in (select t from known) or regexp_replace(ticker, '[-.]', '', 'g') in (select t from known) as spelled,
  (regexp_matches(ticker, '[-.]') or regexp_matches(ticker, '(WS|WT|RT)$') or regexp_matches(ticker, '[A-Z]{4}[UWR]$')) and case when regexp_matches(regexp_replace(ticker, '[-.].*$', ''), '(WS|WT|RT)$') then regexp_replace(regexp_replace(ticker, '[-.].*$', ''), '(WS|WT|RT)$', '') else regexp_replace(regexp_replace(ticker, '[-.].*$', ''), '([A-Z]{4})[UWR]$', '\\1') end in (select t from known) as parent from lost)
select ticker, case when spelled then 'spelling' when parent then 'parent' when exchange in ('PINK', 'OTCMKTS', 'OTCQB', 'OTCQX', 'OTCGREY', 'OTCD', 'NMFQS', 'OTCBB') then 'otc' when regexp_matches(ticker, '^[A-Z]{4}[FY]$') then 'foreign' else 'unknown' end as why from x""",
    "fund_clusters": f"""
with r as (select matched_name, bool_and({_words('sponsor_name', entities.ENTITY_WORDS)}) as firms, {_words('matched_name', entities.FUND_WORDS)} as fund from entity_review where matched_name is not null and sponsor_name is not null group by 1)
select case when firms then 'all buyers are entities; no listed equity' || case when fund then ', fund in issuer name' else '' end end as why, count(*) as clusters from r group by 1""",
    "promote_session": with_relations("bars", "buys", then=f"""
moved as (select ticker, max(abs(round((close::double - open::double) / open::double * 100, 6))) as move from bars where date = date '2025-12-24' and open > 0 and close is not null and lower(security_type) = 'stock' group by 1),
owner as (select ticker, {_CIK} as cik10 from company_ticker_history qualify row_number() over (partition by ticker order by last_seen desc, {_CIK}) = 1),
cl as (select issuer, role, day, count(distinct buyer) as n from buys group by all having count(distinct buyer) >= 2),
legs as (select o.cik10, 0 as k, null as company, m.ticker, m.move from moved m join owner o using (ticker)
  union all select {_CIK}, 1, company, null, null from deals where accession is not null and filed_date = date '2025-12-24' and deal_type in ('operating', 'division_sale')
  union all select lpad(issuer, 10, '0'), 2, null, null, null from cl where day(day) between 0 and 6),
g as (select cik10, arg_min(company, k) filter (where coalesce(company, '') <> '') as any_name, min(company) filter (where coalesce(company, '') <> '') as company, arg_max(ticker, (move, ticker)) filter (where ticker is not null) as ticker, string_agg(distinct ticker, ',' order by ticker) as tickers, list_sort(list_distinct(list(k))) as ks from legs where cik10 is not null group by 1)
select cik10, coalesce(company, cik10) as company, ticker, coalesce(tickers, '') as tickers, array_to_string(list_transform(ks, lambda k: ['volatility', 'deal_filing', 'form4_cluster'][k + 1]), ',') as reasons, cast(len(ks) as int) as n_reasons from g"""),
}
