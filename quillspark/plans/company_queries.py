"""Queries over filed figures, sponsors, merges and texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.exprs import cik_key
from quillspark.operators import merge
from quillspark.plans import deal_text, filers, misc, sponsors
from quillspark.plans.adapters import relation, with_relations
from quillspark.session import checkpointed
from quillspark.sources.tables import table

TODAY = "2026-01-01"


def _facts(spark, d):
    return relation(spark, d, "facts_long")


def _resolved(spark, d):
    return filers.resolve_facts(*(relation(spark, d, n) for n in ("raw_sub", "raw_num", "raw_pre")))


def facts_resolve(spark, d):
    """Every filing and concept with its value or the reason it has none."""
    return _resolved(spark, d).select("adsh", "cik", "concept", "tag", "value", "status", "period_end", "filed")


def facts_topline(spark, d):
    """The tag at the top of each income statement."""
    return filers.toplines(relation(spark, d, "raw_pre"), filers.population(relation(spark, d, "raw_sub")))


def facts_funnel(spark, d):
    """Submissions down to the resolved population."""
    return filers.population_funnel(relation(spark, d, "raw_sub"))


def coverage_status(spark, d):
    """Filings and filers by concept and status."""
    return filers.coverage_by_status(_resolved(spark, d))


def coverage_matrix(spark, d):
    """Coverage by concept, year and quarter."""
    return filers.coverage_matrix(_resolved(spark, d))


def coverage_drift(spark, d):
    """The span of coverage within the same quarter of the year."""
    return filers.coverage_drift(_resolved(spark, d))


def unmapped_queue(spark, d):
    """The most frequent unmapped toplines."""
    return filers.unmapped_queue(_resolved(spark, d))


def filer_universe(spark, d):
    """All filers and whether they still file."""
    return filers.filer_universe(relation(spark, d, "raw_sub"))


def stopped_filers(spark, d):
    """Filers that stopped, with their last period."""
    return filer_universe(spark, d).where("status = 'stopped'").select("cik", "last_period")


def latest_per_concept(spark, d):
    """Each operating filer's newest figures."""
    return filers.latest_figures(_facts(spark, d))


def peer_sets(spark, d):
    """Peers of each filer."""
    return filers.peer_sets(_facts(spark, d))


def peer_ladder_outcomes(spark, d):
    """Filers by outcome of the peer search."""
    return filers.peer_outcomes(filers.peer_sets(_facts(spark, d)))


def peer_alternatives(spark, d):
    """Filers that other floors would serve."""
    return filers.peer_alternatives(_facts(spark, d))


def peer_median_value(spark, d):
    """The peers' median cash-flow margin of each filer."""
    f = filers.latest_figures(_facts(spark, d))
    values = f.where("revenue > 0").select("cik", (F.col("operating_cash_flow").cast("double") / F.col("revenue").cast("double")).alias("value"))
    return filers.peer_median(_facts(spark, d), values)


def _valued(spark, d):
    facts = checkpointed(_facts(spark, d))  # read four times below
    number = F.col("cik").cast("bigint")
    betas = filers.latest_figures(facts).where(number % 3 == 0).select("cik", F.round(F.lit(0.5) + (number % 20).cast("double") / 10, 6).alias("beta"))
    peers = filers.peer_median(facts, betas.withColumnRenamed("beta", "value")).where("median_value is not null").select("cik", F.col("median_value").alias("beta"), F.col("sic_depth").alias("depth"))
    return filers.valuations(facts, betas=betas, peer_betas=peers, past=filers.past_growth(facts))


def dcf_values(spark, d):
    """Discounted-cash-flow arithmetic per filer."""
    return _valued(spark, d)


def dcf_substitutions(spark, d):
    """How often each substitution was made, by outcome."""
    v = _valued(spark, d).where("outcome = 'valued'")
    return v.select("outcome", F.explode(F.split("substitutions", ",")).alias("substitution")).groupBy("outcome", "substitution").agg(F.count("*").alias("filers"))


def dcf_coverage(spark, d):
    """Valued filers by the quarter in which their fiscal year ends."""
    return filers.valuation_coverage(_valued(spark, d))


def _deal_inputs(spark, d):
    """Deals, yearly figures of their companies (which end in different years), and a universe in which every third company goes on filing."""
    facts = _facts(spark, d).withColumn("cik", F.concat(F.lit("4"), F.lpad("cik", 7, "0"))).withColumn("shift", F.explode(F.array(F.lit(240), F.lit(324)))).withColumn("period_end", F.expr("add_months(period_end, shift)")).drop("shift")
    facts = facts.where(F.year("period_end") <= 2013 + F.col("cik").cast("bigint") % 13)
    last = facts.groupBy("cik").agg(F.max("period_end").alias("last"))
    universe = last.select("cik", F.when(F.col("cik").cast("bigint") % 3 == 0, F.add_months("last", 24)).otherwise(F.col("last")).alias("last_period"), F.lit("filing").alias("status"))
    # the deals are spread over as many companies as there are figures of
    number = F.expr("cast(right(accession, 6) as int) % 1500 + 1").cast("string")
    return table(spark, d, "deals").withColumn("cik", F.concat(F.lit("4"), F.lpad(number, 7, "0"))), facts, universe


def _identified(spark, d):
    return filers.deal_identity(*_deal_inputs(spark, d), today="2026-07-01")


def deal_identity(spark, d):
    """What the filing record says of each priced deal's target."""
    return _identified(spark, d).select("accession", "cik10", "filed_date", "value_usd", "pre_end", "last_end", "last_deal_filing", "identity")


def deal_multiples(spark, d):
    """Deal values over the last annual figures before the deal."""
    return filers.deal_multiples(_identified(spark, d), _deal_inputs(spark, d)[1])


def deal_filers(spark, d):
    """Filings with their company's key and whether it files later."""
    return misc.filings_by_cik(table(spark, d, "deals"))


def _sponsors(spark, d):
    return sponsors.sponsor_rollup(relation(spark, d, "plan_filings"))


def sponsors_rollup(spark, d):
    """Sponsors per plan year."""
    return _sponsors(spark, d).withColumn("plan_counts", F.array_join(F.transform("plan_counts", lambda p: F.concat(p["plan"], F.lit(":"), p["participants"].cast("string"), F.lit(":"), F.coalesce(p["active"].cast("string"), F.lit("-")))), ";"))


def _history(spark, d):
    return sponsors.resolve_sponsors(_sponsors(spark, d), relation(spark, d, "sec_names"))


def sponsors_resolved(spark, d):
    """Sponsors with what finds them among the registrants."""
    return _history(spark, d).select("plan_year", "ein", "sponsor_name", "ein_cik", "exact_cik", "exact_candidates", "norm_cik", "norm_candidates", "by_ein", "by_ein_listed", "name_matched")


def plan_year_completeness(spark, d):
    """Filings per plan year against the fullest."""
    return sponsors.completeness(relation(spark, d, "plan_filings"))


def trend_matched_plans(spark, d):
    """The multi-year trend of each sponsor."""
    return sponsors.trend(_history(spark, d), newest_complete=2024)


def review_queue(spark, d):
    """Sponsors that only a name finds."""
    return sponsors.review_queue(_history(spark, d))


def mature_population(spark, d):
    """Sponsors narrowed down, stage by stage."""
    from quillspark.operators.quality import funnel

    return funnel(trend_matched_plans(spark, d), sponsors.target_stages(trend_matched_plans(spark, d), today=TODAY))


def mature_targets(spark, d):
    """The sponsors that remain after all stages."""
    t = trend_matched_plans(spark, d)
    for _, condition in sponsors.target_stages(t, today=TODAY):
        t = t.where(condition)
    return t.select("ein", "sponsor_name", "active_max", "trend", "oldest_plan_eff")


def purchase_clusters(spark, d):
    """Clusters of purchases by several buyers."""
    return sponsors.purchase_clusters(relation(spark, d, "buys"), floors={"insider": 100, "ten_percent": 200})


def superseded_filings(spark, d):
    """Filings that no amendment supersedes."""
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.when(F.col("o_orderkey") % 5 == 0, "4/A").otherwise("4").alias("form"), F.col("o_custkey").alias("issuer"), F.array(F.col("o_orderpriority")).alias("owners"), F.year("o_orderdate").alias("period"))
    return sponsors.without_superseded(f).select("accession", "form", "issuer", "period")


def _legs(spark, d):
    deals = table(spark, d, "deals").withColumn("cik10", cik_key("cik")).where("deal_type in ('operating', 'division_sale')").select("cik10", F.col("company").alias("name"))
    names = relation(spark, d, "sec_names").select(cik_key("cik").alias("cik10"), "name")
    held = table(spark, d, "company_ticker_history").select(cik_key("cik").alias("cik10"), F.lit(None).cast("string").alias("name"))
    return ("filing", deals), ("registrant", names), ("symbol", held)


def promote_union(spark, d):
    """Entities that any of three relations names."""
    return sponsors.promote(*_legs(spark, d))


def promote_gate(spark, d):
    """Promoted entities and whether they have a value."""
    v = _valued(spark, d).withColumn("cik", F.lpad(F.concat(F.lit("4"), F.lpad("cik", 7, "0")), 10, "0"))
    return sponsors.gate(sponsors.promote(*_legs(spark, d)), v)


def _staged_bars(spark, d):
    prices = table(spark, d, "prices_eod_raw")
    old, new = prices.where("year(date) <= 2020"), prices.where("year(date) >= 2020")
    return old, new


def merge_latest(spark, d):
    """Stored and staged bars, one per (ticker, date, source), the newest delivery."""
    old, new = _staged_bars(spark, d)
    got = merge.merge_latest(old, new, keys=["ticker", "date", "source"], newest=["ingested_at", "close", "volume"], drop=F.col("ticker").like("ZTEST%"))
    return got.select("ticker", "date", "source", "close", "volume")


def upsert_missing_anti(spark, d):
    """Staged sessions that are not stored yet."""
    old, new = _staged_bars(spark, d)
    k = ["ticker", "date"]
    return merge.insert_missing(old.select(*k), new.select(*k).distinct(), keys=k)


def upsert_macro(spark, d):
    """Macro observations with restated ones over the stored."""
    m = relation(spark, d, "macro")
    return merge.upsert(m.where("obs_date < date'2024-01-20'"), m.where("obs_date >= date'2024-01-10'").withColumn("value", F.when(F.dayofmonth("obs_date") == 12, None).otherwise(F.col("value") + 1).cast("decimal(18,2)")), keys=["series_id", "obs_date"])


def widen_ranges(spark, d):
    """Ticker ranges widened by new sightings."""
    h = table(spark, d, "company_ticker_history")
    return merge.widen(h.where("id % 2 = 0"), h.where("id % 2 = 1"), keys=["cik", "ticker"], low="first_seen", high="last_seen", total="filings", label="source")


def price_fate(spark, d):
    """Whether bars cover each company's time under a symbol."""
    return misc.price_fate(table(spark, d, "company_ticker_history"), table(spark, d, "prices_eod_raw").select("ticker", "date"))


def ticker_owner_count(spark, d):
    """How many companies held each symbol."""
    return misc.ticker_owners(table(spark, d, "company_ticker_history"))


def ticker_routes(spark, d):
    """Symbols by the route that found them."""
    return misc.route_counts(table(spark, d, "company_ticker_history"))


def macro_latest(spark, d):
    """Newest value of each series."""
    return misc.latest_per_series(relation(spark, d, "macro"))


def macro_change(spark, d):
    """Change of each series over 7 and 20 days."""
    return misc.change_over_days(relation(spark, d, "macro"), (7, 20))


def reconcile_universe(spark, d):
    """Tickers with bars against tickers with a history."""
    return misc.reconcile(table(spark, d, "prices_eod_raw").select("ticker"), table(spark, d, "company_ticker_history").select("ticker"), key="ticker")


def name_norm(spark, d):
    """Names without noise words, and how many names share each."""
    n = table(spark, d, "entity_review").select("sponsor_name").where("sponsor_name is not null").distinct()
    return n.select(sponsors.name_key(F.col("sponsor_name")).alias("name_key")).groupBy("name_key").agg(F.count("*").alias("names"))


def cik_norm(spark, d):
    """Companies by normalised key."""
    return table(spark, d, "deals").groupBy(cik_key("cik").alias("cik10")).agg(F.count("*").alias("rows"), F.countDistinct("cik").alias("spellings"))


def accession_norm(spark, d):
    """Accessions in their dashed form."""
    return table(spark, d, "deals").select("id", misc.normalised_accession(F.replace("accession", F.lit("-"), F.lit(""))).alias("accession"))


def json_payload(spark, d):
    """Events by a field of their payload."""
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("events"))


def text_value_extract(spark, d):
    """The greatest dollar amount of each document."""
    return table(spark, d, "documents").select("doc_id", misc.largest_amount(F.col("text")).alias("amount"))


def text_classify(spark, d):
    """Documents by the phrases they hold."""
    return table(spark, d, "documents").select(deal_text.classify_text(F.col("text")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("documents"))


def text_deal_terms(spark, d):
    """Documents by kind of agreement, consideration, target's figures and type of deal."""
    t = F.col("text")
    kind = deal_text.classify_text(t)
    terms = table(spark, d, "documents").where("text is not null").select(kind.alias("kind"), deal_text.consideration(t).alias("consideration"), deal_text.target_financials(t).alias("financials"), deal_text.deal_type(t, kind).alias("deal_type"))
    return terms.groupBy("kind", "consideration", "financials", "deal_type").agg(F.count("*").alias("documents"))


def text_deal_value(spark, d):
    """The greatest amount of each document that stands near words of a price."""
    return table(spark, d, "documents").select("doc_id", deal_text.deal_value(F.col("text")).cast("double").alias("value"))


def text_parties(spark, d):
    """The filer's role in each deal's text and the other party."""
    one = table(spark, d, "deals").where("accession is not null").groupBy("accession").agg(F.max(F.struct("ingested_at", "id", "company")).alias("m")).select("accession", "m.company")
    docs = table(spark, d, "documents").where("accession is not null and text is not null").groupBy("accession").agg(F.max("text").alias("text"))
    return docs.join(one, "accession", "left").select("accession", deal_text.parties(F.col("text"), F.col("company")).alias("p")).select("accession", "p.*")


def proxy_checks(spark, d):
    """Proxy figures whose quote stands in the filing's text, and whose reference names the filer."""
    figures = table(spark, d, "proxy_figure").where("reason = 'stated' and quote is not null")
    names = table(spark, d, "deals").where("accession is not null").groupBy("accession").agg(F.max("company").alias("company"))
    docs = table(spark, d, "documents").where("accession is not null").groupBy("accession").agg(F.max("text").alias("text"))
    checked = figures.join(names, "accession", "left").join(docs, "accession", "left").select("field", deal_text.attributed(F.col("reference"), F.col("company")).alias("own"), deal_text.cites(F.col("quote"), F.col("text")).alias("cited"))
    return checked.groupBy("field", "own", "cited").agg(F.count("*").alias("figures"))


def text_section_density(spark, d):
    """Where each document's figures stand densest."""
    return table(spark, d, "documents").select("doc_id", misc.densest_window(F.col("text")).cast("bigint").alias("at"))


def text_section_window(spark, d):
    """The window of each section that a document holds, by heading and figures."""
    docs = table(spark, d, "documents")
    found = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(name).alias("section"), misc.section_window(F.col("text"), headings).alias("w")) for name, headings in misc.SECTIONS.items()))).alias("s"))
    return found.where("s.w is not null").select("doc_id", "s.section", "s.w.*")


def visible_text(spark, d):
    """Documents as a reader sees them, by length."""
    return table(spark, d, "documents").select("doc_id", F.length(misc.visible_text(F.col("text"))).alias("shown"))


def proxy_shape(spark, d):
    """Figures per filing and the shape they make."""
    return misc.consideration_shape(table(spark, d, "proxy_figure"))


def projection_growth(spark, d):
    """Yearly growth of each projection."""
    return misc.growth_of_series(table(spark, d, "proxy_projection"))


def projection_coherence(spark, d):
    """Whether projected figures hold together."""
    return misc.coherent_projections(table(spark, d, "proxy_projection"))


def dataset_stats(spark, d):
    """Rows and newest day of the datasets."""
    return misc.dataset_stats([("prices", table(spark, d, "prices_eod_raw"), "date"), ("deals", table(spark, d, "deals"), "filed_date"), ("history", table(spark, d, "company_ticker_history"), "last_seen"), ("documents", table(spark, d, "documents"), "filed_date")])


def overdue_jobs(spark, d):
    """Jobs (event types) that have not run since they were due."""
    e = table(spark, d, "events")
    beats = e.select(F.col("event_type").alias("job"), F.col("ts").alias("at"))
    cadence = e.select(F.col("event_type").alias("job")).distinct().withColumn("due_every_hours", F.when(F.col("job") < "m", 1).otherwise(1000))
    return misc.overdue_jobs(beats, cadence, now="2024-02-05 00:00:00").select("job", "due_every_hours", "overdue")


QUERIES = {f.__name__: f for f in (facts_resolve, facts_topline, facts_funnel, coverage_status, coverage_matrix, coverage_drift, unmapped_queue, filer_universe, stopped_filers, latest_per_concept, peer_sets, peer_ladder_outcomes, peer_alternatives, peer_median_value, dcf_values, dcf_substitutions, dcf_coverage, deal_multiples, deal_identity, deal_filers, sponsors_rollup, sponsors_resolved, plan_year_completeness, trend_matched_plans, review_queue, mature_population, mature_targets, purchase_clusters, superseded_filings, promote_union, promote_gate, merge_latest, upsert_missing_anti, upsert_macro, widen_ranges, price_fate, ticker_owner_count, ticker_routes, macro_latest, macro_change, reconcile_universe, name_norm, cik_norm, accession_norm, json_payload, text_value_extract, text_classify, text_deal_terms, text_deal_value, text_parties, proxy_checks, text_section_density, text_section_window, visible_text, proxy_shape, projection_growth, projection_coherence, dataset_stats, overdue_jobs)}

ORACLE_SQL: dict[str, str] = {}

_SUBS = """
subs as (select adsh, lpad(cik, 10, '0') as cik, name as company, try_cast(sic as int) as sic, form, fp, strptime(period, '%Y%m%d')::date as period_end, strptime(filed, '%Y%m%d')::date as filed from raw_sub),
classed as (select *, case when sic is null then 'unclassified' when sic = 6798 then 'reit' when sic between 6000 and 6199 then 'bank_credit' when sic between 6200 and 6299 then 'broker' when sic between 6300 and 6411 then 'insurance' when sic between 6500 and 6599 then 'real_estate' when sic between 6700 and 6799 then 'holding' else 'operating' end as sic_class,
  (period_end - interval 12 month + interval 1 day)::date >= date '2017-12-15' as in_era from subs),
pop as (select * from classed where form = '10-K' and fp = 'FY' and sic_class = 'operating' and in_era),
top as (select adsh, arg_min(tag, (try_cast(report as int), try_cast(line as int), tag)) as topline from raw_pre where stmt = 'IS' and inpth = '0' and try_cast(report as int) is not null and try_cast(line as int) is not null and adsh in (select adsh from pop) group by adsh)
"""

_CONCEPT_ROWS = " union all ".join(f"select '{c.name}' as concept, '{t}' as tag, {i} as rank, {c.quarters} as q, {'true' if c.unmapped_like else 'false'} as can_miss" for c in filers.CONCEPTS for i, t in enumerate(c.tags))

_RESOLVED = (
    _SUBS
    + f""",
tags as ({_CONCEPT_ROWS}),
cand as (select n.adsh, t.concept, t.tag, t.rank, try_cast(n.value as decimal(28,4)) as value, coalesce(n.value, '') <> '' as has, coalesce(n.coreg, '') <> '' as co, coalesce(n.segments, '') <> '' as seg, n.uom, try_cast(n.qtrs as int) = t.q and strptime(n.ddate, '%Y%m%d')::date = p.period_end as own
  from raw_num n join tags t on t.tag = n.tag join pop p on p.adsh = n.adsh where n.version like 'us-gaap/%'),
usable as (select adsh, concept, arg_min(tag, (rank, tag, value)) as tag, arg_min(value, (rank, tag, value)) as value from cand where not co and not seg and uom = 'USD' and own and has group by all),
hints as (select adsh, concept, bool_or(not co and not seg and uom = 'USD' and own and not has) as nil, bool_or(not co and not seg and uom = 'USD' and not own and has) as other, bool_or(not co and seg and has) as dim, bool_or(not co and not seg and uom <> 'USD' and has) as ccy from cand group by all),
resolved as (select p.adsh, p.cik, p.company, p.sic, c.concept, u.tag, u.value, case when u.adsh is not null then 'stated' when h.nil then 'absent' when h.other then 'period_mismatch' when h.dim then 'segment_only' when h.ccy then 'not_usd' when c.can_miss and regexp_matches(t.topline, 'revenue|sales|fees|premium|interestincome', 'i') then 'unmapped' else 'absent' end as status, case when c.can_miss then t.topline end as unmapped_tag, p.period_end, p.filed
  from pop p cross join (select distinct concept, can_miss from tags) c left join usable u on u.adsh = p.adsh and u.concept = c.concept left join hints h on h.adsh = p.adsh and h.concept = c.concept left join top t on t.adsh = p.adsh)
"""
)

_MATRIX = "matrix as (select concept, year(filed) as year, quarter(filed) as quarter, count(*) as filings, count(*) filter (where status = 'stated') as stated, round(count(*) filter (where status = 'stated') / count(*), 6) as share from resolved group by all)"


def _raw(then: str) -> str:
    return with_relations("raw_sub", "raw_num", "raw_pre", then=_RESOLVED + then)


_LATEST = """
r as (select *, row_number() over (partition by cik, concept order by period_end desc nulls last, filed desc nulls last, adsh desc nulls last) as rn from facts_long where sic_class = 'operating'),
latest as (select cik, arg_max(company, (period_end, filed, adsh, concept)) as company, arg_max(sic, (period_end, filed, adsh, concept)) as sic, max(period_end) as period_end, """ + ", ".join(f"max(case when concept = '{c}' and status = 'stated' then value end) as {c}" for c in ("revenue", "assets", "operating_cash_flow", "capex", "equity", "liabilities", "net_income")) + """ from r where rn = 1 group by cik)
"""

_PEERS = (
    _LATEST
    + """,
base as (select cik, company, sic, revenue, assets, case when assets > 0 and revenue is not null then revenue::double / assets::double end as turnover from latest),
placeable as (select * from base where sic is not null and assets > 0),
"""
    + ",\n".join(
        f"p{d} as (select a.cik, count(*) as banded, count(*) filter (where p.revenue > 1000000) as material, median(p.turnover) filter (where p.revenue > 1000000) as med, quantile_cont(p.turnover, 0.75) filter (where p.revenue > 1000000) - quantile_cont(p.turnover, 0.25) filter (where p.revenue > 1000000) as iqr from placeable a join placeable p on p.sic // {10 ** (4 - d)} = a.sic // {10 ** (4 - d)} and p.cik <> a.cik and p.assets::double between a.assets::double / 3 and a.assets::double * 3 group by a.cik)"
        for d in (4, 3, 2)
    )
    + """,
picked as (select b.*, case when coalesce(p4.material, 0) >= 8 then 4 when coalesce(p3.material, 0) >= 8 then 3 when coalesce(p2.material, 0) >= 8 then 2 end as depth, p4.banded as b4, p3.banded as b3, p2.banded as b2, p4.material as m4, p3.material as m3, p2.material as m2, p4.med as e4, p3.med as e3, p2.med as e2, p4.iqr as i4, p3.iqr as i3, p2.iqr as i2
  from base b left join p4 on p4.cik = b.cik left join p3 on p3.cik = b.cik left join p2 on p2.cik = b.cik),
sets as (select cik, company, sic, revenue, assets, depth as sic_depth, coalesce(case depth when 4 then b4 when 3 then b3 when 2 then b2 end, 0) as peers_banded, coalesce(case depth when 4 then m4 when 3 then m3 when 2 then m2 end, 0) as peers_material, round(case depth when 4 then e4 when 3 then e3 when 2 then e2 end, 6) as turnover_median, round(case depth when 4 then i4 when 3 then i3 when 2 then i2 end, 6) as turnover_iqr, round(turnover, 6) as turnover_self,
  case when sic is null or coalesce(assets <= 0, true) then 'unplaceable' when coalesce(revenue <= 1000000, true) then 'immaterial' when depth is null then 'too_few_peers' else 'served' end as outcome, coalesce(depth < 4, false) as depth_fell_back from picked)
"""
)


def _peered(then: str) -> str:
    return with_relations("facts_long", then=_PEERS + then)


_PV = "case when abs(rate_x - {g}) < 1e-9 then fcf_x * 10 else fcf_x * ((1 + {g}) / (1 + rate_x)) * (1 - pow((1 + {g}) / (1 + rate_x), 10)) / (1 - (1 + {g}) / (1 + rate_x)) end + fcf_x * pow(1 + {g}, 10) * (1 + 0.025::double) / (rate_x - 0.025::double) / pow(1 + rate_x, 10)"
_VALUED = (
    _LATEST
    + """,
own as (select cik, round(0.5::double + (cast(cik as bigint) % 20)::double / 10, 6) as beta from latest where cast(cik as bigint) % 3 = 0),
vbase as (select cik, sic, assets from latest where sic is not null and assets > 0), vhave as (select b.*, o.beta as v from vbase b join own o using (cik)), """
    + ", ".join(f"v{d} as (select a.cik, count(*) as n, median(p.v) as m from vbase a join vhave p on p.sic // {10 ** (4 - d)} = a.sic // {10 ** (4 - d)} and p.cik <> a.cik and p.assets::double between a.assets::double / 3 and a.assets::double * 3 group by a.cik)" for d in (4, 3, 2))
    + """,
peer_beta as (select b.cik, case when v4.n >= 8 then round(v4.m, 6) when v3.n >= 8 then round(v3.m, 6) when v2.n >= 8 then round(v2.m, 6) end as beta, case when v4.n >= 8 then 4 when v3.n >= 8 then 3 when v2.n >= 8 then 2 end as depth from vbase b left join v4 on v4.cik = b.cik left join v3 on v3.cik = b.cik left join v2 on v2.cik = b.cik),
yearly as (select cik, year(period_end) as y, max(value) as v from facts_long where concept = 'revenue' and status = 'stated' and value > 0 group by all),
past as (select cik, round(pow(arg_max(v, y)::double / arg_min(v, y)::double, 1.0 / (max(y) - min(y))) - 1, 9) as past from yearly group by cik having max(y) > min(y)),
fcf as (select l.*, o.beta as own_beta, p.beta as peer_beta, p.depth, h.past, coalesce(o.beta, p.beta) as beta_x, case when operating_cash_flow is not null then (operating_cash_flow - coalesce(abs(capex), 0))::double end as fcf_x, coalesce(equity::double, 0) + coalesce(liabilities::double, 0) as whole
  from latest l left join own o on o.cik = l.cik left join peer_beta p on p.cik = l.cik left join past h on h.cik = l.cik),
costed as (select *, case when beta_x is null then 0.095::double else 0.0483::double + beta_x * 0.0433::double end as ke from fcf),
rated as (select *, case when whole > 0 then (coalesce(equity::double, 0) * ke + coalesce(liabilities::double, 0) * ((0.0483::double + 0.02::double) * (1 - 0.21::double))) / whole else ke end as rate_x from costed),
outcomes as (select *, case when fcf_x is null then 'no_cash_flow' when fcf_x <= 0 then 'negative_fcf' when rate_x < 0.04 or 0.025 >= rate_x then 'no_discount_rate' else 'valued' end as outcome from rated),
vals as (select cik, company, period_end, fcf_x as fcf, case when outcome = 'valued' then round(rate_x, 8) end as rate, """
    + ", ".join(f"case when outcome = 'valued' then round({_PV.format(g=f'{g}::double')}, 0) end as {name}" for name, g in (("value", 0.03), ("flex_0", 0.0), ("flex_3", 0.03), ("flex_6", 0.06), ("flex_10", 0.1)))
    + """, outcome,
  case when outcome = 'valued' then concat_ws(',', case when own_beta is null and peer_beta is not null then 'peer_beta' end, case when own_beta is null and peer_beta is not null and depth < 4 then 'comp_depth' end, case when operating_cash_flow is not null and capex is null then 'absent_capex' end, 'erp_constant', 'growth_constant', case when abs(past - 0.03) > 0.1 then 'growth_mismatch' end, case when beta_x is null then 'no_beta' end) else '' end as substitutions from outcomes)
"""
)

_SPONSORS = """
per_plan as (select plan_year, ein, coalesce(plan_num, '?') as plan, max(coalesce(participants, 0)) as participants, max(active) as active, min(sponsor_name) as sponsor_name, max(naics) as naics, max(state) as state, max(dfe_code) as dfe_code, max(entity_code) as entity_code, bool_or(coalesce(pension_code like '%2L%' or pension_code like '%2M%', false)) as has_403b, bool_or(form = 'short') as short, bool_or(form = 'main') as main, min(case when plan_eff_date > date '1900-01-01' and plan_eff_date <= make_date(plan_year + 1, 1, 1) then plan_eff_date end) as plan_eff from plan_filings where ein is not null group by all),
rolled as (select plan_year, ein, min(sponsor_name) as sponsor_name, max(naics) as naics, max(state) as state, count(*) as plans, sum(participants)::bigint as participants_sum, max(participants) as participants_max, sum(active)::bigint as active_sum, max(active) as active_max,
  string_agg(plan || ':' || participants || ':' || coalesce(active::varchar, '-'), ';' order by plan) as plan_counts, min(plan_eff) as oldest_plan_eff, max(dfe_code) as dfe_code, coalesce(bool_or(dfe_code is not null), false) as is_dfe, coalesce(bool_or(entity_code = '1'), false) as is_multiemployer, coalesce(bool_or(short), false) as files_short_form, coalesce(bool_or(main), false) as files_main_form,
  case when bool_or(has_403b) and coalesce(max(naics) in ('712100', '622000', '611000', '624100', '813000', '624200', '624310', '711100', '621420', '623000', '515100', '621498'), false) then 'both' when bool_or(has_403b) then 'plan_type' when max(naics) in ('712100', '622000', '611000', '624100', '813000', '624200', '624310', '711100', '621420', '623000', '515100', '621498') then 'naics' end as nonprofit_basis from per_plan group by all)
"""

_NOISE = ", ".join(f"'{w}'" for w in sponsors.NAME_NOISE)


def _name_key(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(replace({c}, '&', ' and ')), '[^a-z0-9 ]', ' ', 'g')), '\\s+'), lambda w: w <> '' and not list_contains([{_NOISE}], w)), ' ')"


_RESOLUTION = (
    _SPONSORS
    + f""",
by_ein as (select ein, min(cik) as ein_cik, max(tickers) as ein_tickers from sec_names where ein is not null and ein <> '' group by 1),
exact as (select upper(trim(name)) as ekey, min(cik) as exact_cik, count(*) as exact_candidates from sec_names where name is not null group by 1),
norm as (select {_name_key('name')} as nkey, min(cik) as norm_cik, count(*) as norm_candidates from sec_names group by 1 having {_name_key('name')} <> ''),
history as (select r.*, b.ein_cik, e.exact_cik, e.exact_candidates, n.norm_cik, n.norm_candidates, b.ein_cik is not null as by_ein, coalesce(b.ein_tickers, '') <> '' as by_ein_listed, e.exact_cik is not null or n.norm_cik is not null as name_matched
  from rolled r left join by_ein b on b.ein = r.ein left join exact e on e.ekey = upper(trim(r.sponsor_name)) left join norm n on n.nkey = nullif({_name_key('r.sponsor_name')}, ''))
"""
)

_TREND = (
    _RESOLUTION
    + """,
done as (select * from history where plan_year <= 2024),
ends as (select ein, min(plan_year) as first_year, max(plan_year) as last_year, count(*) as years_filed from done group by ein),
newest as (select ein, min(sponsor_name) as sponsor_name, max_by(naics, plan_year) as naics, max_by(state, plan_year) as state, max_by(plans, plan_year) as plans, max_by(participants_sum, plan_year) as participants_sum, max_by(active_max, plan_year) as active_max, min(oldest_plan_eff) as oldest_plan_eff, bool_or(is_dfe) as is_dfe, bool_or(is_multiemployer) as is_multiemployer, max_by(nonprofit_basis, plan_year) as nonprofit_basis, max_by(by_ein, plan_year) as by_ein, max_by(name_matched, plan_year) as name_matched from done group by ein),
fp as (select p.ein, p.plan, p.active from per_plan p join ends e on e.ein = p.ein and p.plan_year = e.first_year), lp as (select p.ein, p.plan, p.active from per_plan p join ends e on e.ein = p.ein and p.plan_year = e.last_year),
cp as (select f.ein, count(*) as common_plans, sum(f.active)::bigint as mf, sum(l.active)::bigint as ml from fp f join lp l on l.ein = f.ein and l.plan = f.plan and f.active is not null and l.active is not null group by 1),
nf as (select ein, count(*) as n from fp group by 1), nl as (select ein, count(*) as n from lp group by 1), seen as (select ein, max(plan_year) as last_seen_year from history group by 1), ys as (select distinct plan_year as y from done),
t as (select n.ein, n.sponsor_name, n.naics, n.state, n.plans, n.participants_sum, n.active_max, n.oldest_plan_eff, n.is_dfe, n.is_multiemployer, n.nonprofit_basis, n.by_ein, n.name_matched, e.first_year, e.last_year, e.years_filed, s.last_seen_year, cast(coalesce(c.common_plans, 0) as int) as common_plans, cast(nl.n - coalesce(c.common_plans, 0) as int) as plans_added, cast(nf.n - coalesce(c.common_plans, 0) as int) as plans_dropped, coalesce(c.mf, 0) as matched_first, coalesce(c.ml, 0) as matched_last, (select count(*) from ys where y between e.first_year and e.last_year) - e.years_filed as gap_years, case when s.last_seen_year >= 2024 then 'filing' else 'lapsed' end as status,
  case when e.years_filed >= 2 and c.mf > 0 then (c.ml - c.mf)::double / c.mf end as pct from newest n join ends e using (ein) join seen s using (ein) join nf on nf.ein = n.ein join nl on nl.ein = n.ein left join cp c on c.ein = n.ein),
trended as (select * exclude (pct), case when pct is null then 'unknown' when pct > 0.05 then 'growing' when pct < -0.05 then 'declining' else 'flat' end as trend, round(pct, 6) as pct_change from t)
"""
)


def _plan(body: str, then: str) -> str:
    return with_relations("plan_filings", "sec_names", then=body + then)


_STAGES = ["true", "not coalesce(by_ein, false) and not coalesce(name_matched, false)", "not coalesce(is_dfe, false) and not coalesce(is_multiemployer, false)", "nonprofit_basis is null", "status = 'filing'", "trend in ('flat', 'declining')", "active_max between 20 and 1000", "(date '2026-01-01' - oldest_plan_eff) / 365.25 >= 20"]
_STAGE_NAMES = ["sponsors", "no registrant", "an employer", "for profit", "still files", "not growing", "of the size", "old enough"]
_CIK10 = "lpad(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), 10, '0')"
_IDENTITY = f"""
fin as (select * from (select lpad(concat('4', lpad(cik, 7, '0')), 10, '0') as cik10, cast(period_end + to_months(shift) as date) as period_end, concept, value, status from facts_long, (values (240), (324)) v(shift)) where year(period_end) <= 2013 + cast(cik10 as bigint) % 13),
uni as (select cik10, case when cast(cik10 as bigint) % 3 = 0 then max(period_end) + interval 24 month else max(period_end) end as last_end from fin group by cik10),
spread as (select * replace (lpad(concat('4', lpad(cast(cast(right(accession, 6) as int) % 1500 + 1 as varchar), 7, '0')), 10, '0') as cik) from deals),
one as (select * exclude (rn) from (select *, cik as cik10, row_number() over (partition by accession order by ingested_at desc nulls last, id desc) as rn from spread) where rn = 1),
op as (select * from one where filer_role <> 'acquirer' and value_usd is not null and deal_type = 'operating'),
spans as (select o.accession, max(case when f.period_end < o.filed_date then f.period_end end) as pre_end from op o join fin f on f.cik10 = o.cik10 group by 1),
later as (select cik as cik10, max(filed_date) as last_deal_filing from spread group by 1),
identified as (select o.accession, o.cik10, o.filed_date, o.value_usd, cast(s.pre_end as date) as pre_end, cast(u.last_end as date) as last_end, l.last_deal_filing,
  case when s.pre_end is null then null when u.last_end > s.pre_end then 'kept_filing' when l.last_deal_filing > o.filed_date then 'kept_filing'
    when date '2026-07-01' - o.filed_date < 548 or (select cast(max(period_end) as date) from fin) - o.filed_date < 548 then 'too_recent' else 'acquired_whole' end as identity
  from op o left join spans s using (accession) left join uni u on u.cik10 = o.cik10 left join later l on l.cik10 = o.cik10)
"""
_PROMOTED = f"""
legs as (select {_CIK10} as cik10, company as name, 'filing' as reason, 0 as no from deals where deal_type in ('operating', 'division_sale') union all select {_CIK10}, name, 'registrant', 1 from sec_names union all select {_CIK10}, null, 'symbol', 2 from company_ticker_history),
promoted as (select cik10, arg_min(name, (no, name)) filter (where name is not null) as name, string_agg(distinct reason, ',' order by reason) as reasons, count(distinct reason) as n_reasons from legs where cik10 is not null group by 1)
"""


def _said(pattern: str) -> str:
    return f"coalesce(regexp_matches(text, $${pattern}$$, 'i'), false)"


_KIND_NAMES = sorted({k for k, _, _ in deal_text.PHRASES})
_KINDS = (
    "with scores as (select text, " + ", ".join(" + ".join(f"(case when {_said(p)} then {w} else 0 end)" for x, w, p in deal_text.PHRASES if x == k) + f" as {k}" for k in _KIND_NAMES) + " from documents), "
    + f"kinds as (select text, case when greatest({', '.join(_KIND_NAMES)}) = 0 then null when len(list_filter([{', '.join(_KIND_NAMES)}], lambda v: v = greatest({', '.join(_KIND_NAMES)}))) > 1 then null "
    + " ".join(f"when {k} = greatest({', '.join(_KIND_NAMES)}) then '{k}'" for k in _KIND_NAMES) + " end as kind from scores) "
)


def _funnel_sql(source: str, conditions: list[str], names: list[str]) -> str:
    held = [" and ".join(f"coalesce({c}, false)" for c in conditions[: k + 1]) for k in range(len(conditions))]
    counts = ", ".join(f"count(*) filter (where {h}) as c{k}" for k, h in enumerate(held))
    rows = " union all ".join(f"select {k} as stage_no, '{n}' as stage, c{k} as remaining, {f'c{k - 1} - c{k}' if k else 'cast(0 as bigint)'} as removed, {f'c{k} = 0 and c{k - 1} > 0' if k else 'false'} as collapsed from fc" for k, n in enumerate(names))
    return f", fc as (select {counts} from {source}) {rows}"


ORACLE_SQL.update({
    "facts_resolve": _raw("select adsh, cik, concept, tag, value, status, period_end, filed from resolved"),
    "facts_topline": _raw("select * from top"),
    "facts_funnel": _raw(_funnel_sql("classed", ["true", "form = '10-K'", "fp = 'FY'", "sic_class <> 'unclassified'", "sic_class = 'operating'", "in_era"], ["submissions", "annual report", "full fiscal year", "classified", "operating company", "current era"])),
    "coverage_status": _raw("select concept, status, count(*) as filings, count(distinct cik) as filers from resolved group by all"),
    "coverage_matrix": _raw(f", {_MATRIX} select * from matrix"),
    "coverage_drift": _raw(f", {_MATRIX} select concept, quarter, min(share) as least, max(share) as greatest, round(max(share) - min(share), 6) as span from matrix group by all"),
    "unmapped_queue": _raw("select * from (select concept, unmapped_tag, count(*) as filings, cast(row_number() over (partition by concept order by count(*) desc, unmapped_tag) as int) as rank from resolved where status = 'unmapped' group by concept, unmapped_tag) where rank <= 20"),
    "filer_universe": with_relations("raw_sub", "raw_pre", then=_SUBS + """, g as (select cik, arg_max(company, (filed, period_end, adsh)) as company, arg_max(sic, (filed, period_end, adsh)) filter (where sic is not null) as sic, min(period_end) as first_period, max(period_end) as last_period, min(filed) as first_filed, max(filed) as last_filed, count(*) as filings, count(distinct company) as names, string_agg(distinct form, ',' order by form) as forms from subs where cik is not null and cik <> '0000000000' and period_end is not null group by cik), n as (select max(last_period) as newest from g)
select g.*, case when newest - last_period <= 548 then 'filing' when last_filed >= newest - 548 then 'pending' else 'stopped' end as status from g, n"""),
    "latest_per_concept": with_relations("facts_long", then=_LATEST + "select * from latest"),
    "peer_sets": _peered("select *, peers_material * 2 < peers_banded as thinned from sets"),
    "peer_ladder_outcomes": _peered("select outcome, case when outcome = 'served' then sic_depth end as sic_depth, count(*) as filers from sets group by all"),
    "peer_alternatives": with_relations("facts_long", then=_LATEST + ", base as (select cik, sic, revenue, assets from latest where sic is not null and assets > 0), " + ", ".join(f"q{d} as (select a.cik, count(*) filter (where p.revenue > 0) as m0, count(*) filter (where p.revenue > 1000000) as m1, count(*) filter (where p.revenue > 10000000) as m10, count(*) filter (where p.revenue > 50000000) as m50 from base a join base p on p.sic // {10 ** (4 - d)} = a.sic // {10 ** (4 - d)} and p.cik <> a.cik and p.assets::double between a.assets::double / 3 and a.assets::double * 3 group by a.cik)" for d in (4, 3, 2)) + """,
j as (select b.cik, b.revenue, greatest(coalesce(q4.m0, 0), coalesce(q3.m0, 0), coalesce(q2.m0, 0)) as m0, greatest(coalesce(q4.m1, 0), coalesce(q3.m1, 0), coalesce(q2.m1, 0)) as m1, greatest(coalesce(q4.m10, 0), coalesce(q3.m10, 0), coalesce(q2.m10, 0)) as m10, greatest(coalesce(q4.m50, 0), coalesce(q3.m50, 0), coalesce(q2.m50, 0)) as m50 from base b left join q4 on q4.cik = b.cik left join q3 on q3.cik = b.cik left join q2 on q2.cik = b.cik)
""" + " union all ".join(f"select {m} as material, {n} as least, count(*) filter (where revenue > {m} and {c} >= {n}) as served from j" for m, n, c in ((0, 8, "m0"), (1000000, 8, "m1"), (10000000, 8, "m10"), (50000000, 8, "m50"), (1000000, 3, "m1"), (1000000, 12, "m1")))),
    "peer_median_value": with_relations("facts_long", then=_LATEST + ", base as (select cik, sic, assets from latest where sic is not null and assets > 0), having_v as (select b.*, l.operating_cash_flow::double / l.revenue::double as v from base b join latest l using (cik) where l.revenue > 0 and l.operating_cash_flow is not null), " + ", ".join(f"q{d} as (select a.cik, count(*) as n, median(p.v) as m from base a join having_v p on p.sic // {10 ** (4 - d)} = a.sic // {10 ** (4 - d)} and p.cik <> a.cik and p.assets::double between a.assets::double / 3 and a.assets::double * 3 group by a.cik)" for d in (4, 3, 2)) + """
select b.cik, case when q4.n >= 8 then 4 when q3.n >= 8 then 3 when q2.n >= 8 then 2 end as sic_depth, case when q4.n >= 8 then q4.n when q3.n >= 8 then q3.n when q2.n >= 8 then q2.n end as n, round(case when q4.n >= 8 then q4.m when q3.n >= 8 then q3.m when q2.n >= 8 then q2.m end, 6) as median_value from base b left join q4 on q4.cik = b.cik left join q3 on q3.cik = b.cik left join q2 on q2.cik = b.cik"""),
    "dcf_values": with_relations("facts_long", then=_VALUED + "select * from vals"),
    "dcf_substitutions": with_relations("facts_long", then=_VALUED + "select outcome, substitution, count(*) as filers from (select outcome, unnest(string_split(substitutions, ',')) as substitution from vals where outcome = 'valued') group by all"),
    "dcf_coverage": with_relations("facts_long", then=_VALUED + "select year(period_end) as year, quarter(period_end) as quarter, count(*) filter (where outcome = 'valued') as valued, count(*) as filers from vals where period_end is not null group by all"),
    "deal_identity": with_relations("facts_long", then=_IDENTITY + "select accession, cik10, filed_date, value_usd, pre_end, last_end, last_deal_filing, identity from identified"),
    "deal_multiples": with_relations("facts_long", then=_IDENTITY + """, figures as (select i.accession, max(case when f.concept = 'revenue' and f.status = 'stated' then f.value end) as revenue, max(case when f.concept = 'net_income' and f.status = 'stated' then f.value end) as net_income from identified i join fin f on f.cik10 = i.cik10 and f.period_end = i.pre_end group by 1)
select accession, cik10, filed_date, value_usd, pre_end, revenue, net_income, case when revenue > 0 then round(value_usd::double / revenue::double, 6) end as to_revenue, case when net_income > 0 then round(value_usd::double / net_income::double, 6) end as to_income
from identified join figures using (accession) where identity = 'acquired_whole' and revenue is not null"""),
    "deal_filers": f"with d as (select accession, max({_CIK10}) as cik10, max(filed_date) as filed_date from deals group by 1) select *, max(filed_date) over (partition by cik10) as last_filed, max(filed_date) over (partition by cik10) > filed_date as files_later from d",
    "sponsors_rollup": _plan(_SPONSORS, "select * from rolled"),
    "sponsors_resolved": _plan(_RESOLUTION, "select plan_year, ein, sponsor_name, ein_cik, exact_cik, exact_candidates, norm_cik, norm_candidates, by_ein, by_ein_listed, name_matched from history"),
    "plan_year_completeness": "with g as (select plan_year, count(*) as filings from entity_review group by 1) select plan_year, filings, round(filings / (select max(filings) from g), 6) as share from g",
    "trend_matched_plans": _plan(_TREND, "select * from trended"),
    "review_queue": _plan(_RESOLUTION, "select plan_year, ein, sponsor_name, coalesce(exact_cik, norm_cik) as matched_cik, case when exact_cik is not null then 'exact_name' else 'normalized_name' end as match_basis, coalesce(exact_candidates, norm_candidates) as candidates, least(participants_sum, 2147483647) as participants from history where not by_ein and name_matched"),
    "mature_population": _plan(_TREND, _funnel_sql("trended", _STAGES, _STAGE_NAMES)),
    "mature_targets": _plan(_TREND, "select ein, sponsor_name, active_max, trend, oldest_plan_eff from trended where " + " and ".join(f"({s})" for s in _STAGES)),
    "purchase_clusters": with_relations("buys", then="""days as (select issuer, role, day, list(distinct buyer) as buyers, sum(value) as value, count(*) as n, row_number() over (partition by issuer, role order by day) as i from buys group by issuer, role, day)
select issuer, role, first, max(day) as last, cast(count(distinct buyer) as int) as buyers, cast(max(n) as bigint) as buys, max(value) as value from (
  select c.issuer, c.role, c.first, c.day, c.n, c.value, unnest(c.bs) as buyer from (select w.*, flatten(list(buyers) over (partition by issuer, role, first)) as bs, sum(cnt) over (partition by issuer, role, first) as n, sum(val) over (partition by issuer, role, first) as value from (
    with recursive walk as (select issuer, role, day, day as first, i, buyers, value as val, n as cnt from days where i = 1 union all select d.issuer, d.role, d.day, case when d.day - w.first >= 3 then d.day else w.first end, d.i, d.buyers, d.value, d.n from walk w join days d on d.issuer = w.issuer and d.role = w.role and d.i = w.i + 1) select * from walk) w) c)
group by issuer, role, first having count(distinct buyer) >= 2 and max(value) >= case role when 'insider' then 100 else 200 end"""),
    "superseded_filings": "with f as (select o_orderkey as accession, case when o_orderkey % 5 = 0 then '4/A' else '4' end as form, o_custkey as issuer, o_orderpriority as owners, year(o_orderdate) as period from orders) select accession, form, issuer, period from f where form = '4/A' or not exists (select 1 from f a where a.form = '4/A' and a.issuer = f.issuer and a.owners = f.owners and a.period = f.period)",
    "promote_union": with_relations("sec_names", then=_PROMOTED + "select * from promoted"),
    "promote_gate": with_relations("sec_names", "facts_long", then=_VALUED + ", " + _PROMOTED + "select p.cik10, name, reasons, n_reasons, coalesce(v.outcome = 'valued', false) as passed, case when coalesce(v.outcome = 'valued', false) then null else coalesce(v.outcome, 'no_figures') end as reason from promoted p left join (select lpad('4' || lpad(cik, 7, '0'), 10, '0') as cik10, outcome from vals) v on v.cik10 = p.cik10"),
    "merge_latest": "select ticker, date, source, close, volume from (select *, row_number() over (partition by ticker, date, source order by ingested_at desc, close desc nulls last, volume desc nulls last) as rn from prices_eod_raw where ticker not like 'ZTEST%') where rn = 1",
    "upsert_missing_anti": "select distinct ticker, date from prices_eod_raw n where year(date) >= 2020 and not exists (select 1 from prices_eod_raw o where year(o.date) <= 2020 and o.ticker = n.ticker and o.date = n.date)",
    "upsert_macro": with_relations("macro", then="o as (select * from macro where obs_date < date '2024-01-20'), n as (select series_id, obs_date, case when day(obs_date) = 12 then null else cast(value + 1 as decimal(18,2)) end as value from macro where obs_date >= date '2024-01-10') select coalesce(n.series_id, o.series_id) as series_id, coalesce(n.obs_date, o.obs_date) as obs_date, coalesce(n.value, o.value) as value from o full join n on n.series_id = o.series_id and n.obs_date = o.obs_date"),
    "widen_ranges": "select cik, ticker, min(first_seen) as first_seen, max(last_seen) as last_seen, cast(sum(filings) as bigint) as filings, string_agg(distinct source, ' and ' order by source) as source from company_ticker_history group by all",
    "price_fate": """with own as (select cik, ticker, min(first_seen) as first_seen, max(last_seen) as last_seen from company_ticker_history group by all), span as (select ticker, min(date) as first_bar, max(date) as last_bar from prices_eod_raw group by 1)
select cik, own.ticker, first_seen, last_seen, first_bar, last_bar, case when first_bar <= last_seen and last_bar >= first_seen then 'usable' when last_seen < (select min(date) from prices_eod_raw) then 'before_our_history' when first_bar is null then 'not_in_file' else 'other_owner_bars' end as fate from own left join span on span.ticker = own.ticker""",
    "ticker_owner_count": "select ticker, count(distinct cik) as owners, string_agg(distinct cik, ',' order by cik) as ciks from company_ticker_history group by 1",
    "ticker_routes": "select source, count(*) as rows, count(distinct cik) as ciks, count(distinct ticker) as tickers from company_ticker_history group by 1",
    "macro_latest": with_relations("macro", then="select distinct on (series_id) series_id, obs_date, value from macro where value is not null order by series_id, obs_date desc"),
    "macro_change": with_relations("macro", then="n as (select series_id, max(obs_date) as obs_date, arg_max(value, obs_date) as value from macro where value is not null group by 1), j as (select n.series_id, k.days, n.value, max(m.obs_date) as then_date, arg_max(m.value, m.obs_date) as then_value from n cross join (select unnest([7, 20]) as days) k left join macro m on m.series_id = n.series_id and m.value is not null and m.obs_date <= n.obs_date - k.days::int group by all) select *, value - then_value as change from j"),
    "reconcile_universe": "select ticker, case when s = 3 then 'both' when s = 1 then 'left_only' else 'right_only' end as side from (select ticker, sum(s) as s from (select distinct ticker, 1 as s from prices_eod_raw union all select distinct ticker, 2 from company_ticker_history) where ticker is not null group by 1)",
    "name_norm": f"select {_name_key('sponsor_name')} as name_key, count(*) as names from (select distinct sponsor_name from entity_review where sponsor_name is not null) group by 1",
    "cik_norm": f"select {_CIK10} as cik10, count(*) as rows, count(distinct cik) as spellings from deals group by 1",
    "accession_norm": "select id, accession from deals",
    "json_payload": "select event_type, cast(props->>'$.k' as int) as k, count(*) as events from events group by all",
    "text_value_extract": r"""select doc_id, (select cast(max(a) as bigint) from (select round(cast(replace(regexp_extract(x, '\$ ?([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') as double) * case when x like '%thousand' then 1e3 when x like '%million' then 1e6 when x like '%billion' or x like '%bn' then 1e9 else 1 end) as a from (select unnest(regexp_extract_all(lower(text), '\$ ?[0-9][0-9,]*(?:\.[0-9]+)? ?(?:thousand|million|billion|bn)?')) as x)) where a between 1e4 and 5e11) as amount from documents""",
    "text_classify": _KINDS + "select kind as bucket, count(*) as documents from kinds group by 1",
    "text_deal_terms": _KINDS + f"""
select kind, case when {_said(deal_text.CASH)} and {_said(deal_text.STOCK)} then 'mixed' when {_said(deal_text.CASH)} then 'cash' when {_said(deal_text.STOCK)} then 'stock' else 'not_stated' end as consideration,
  case when {_said(deal_text.PROMISED)} then 'rule_305_promised' when {_said(deal_text.FIGURES)} then 'figures_in_filing' else 'none_disclosed' end as financials,
  case when kind = 'm_and_a' and {_said(deal_text.SHELL_COMPANY)} then 'spac' when kind = 'securitization' then 'securitization' when kind = 'm_and_a' and {_said(deal_text.DIVISION)} and not {_said(deal_text.WHOLE)} then 'division_sale' when kind = 'm_and_a' then 'operating' else 'unclassified' end as deal_type,
  count(*) as documents from kinds where text is not null group by all""",
    "proxy_checks": f"""
with names as (select accession, max(company) as company from deals group by 1), docs as (select accession, max(text) as text from documents group by 1),
f as (select p.field, p.quote, p.reference, n.company, d.text from proxy_figure p left join names n using (accession) left join docs d using (accession) where reason = 'stated' and quote is not null),
w as (select *, list_filter(regexp_extract_all(lower(coalesce(company, '')), '[a-z]+'), lambda w: length(w) > 2 and not list_contains({list(deal_text.NAME_NOISE)}, w)) as mine, list_filter(regexp_extract_all(lower(coalesce(reference, '')), '[a-z]+'), lambda w: length(w) > 2 and not list_contains({list(deal_text.NAME_NOISE)}, w)) as theirs from f)
select field, case when coalesce(reference, '') = '' then false when regexp_matches(reference, $${deal_text.NOT_THE_FILER}$$, 'i') then false when coalesce(company, '') = '' then true when len(mine) = 0 or len(theirs) = 0 then true else list_contains(theirs, mine[1]) or list_contains(mine, theirs[1]) end as own,
  coalesce(contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\\s+', ' ', 'g'))), false) as cited, count(*) as figures from w group by all""",
    "text_section_density": r"""with b as (select doc_id, k, len(regexp_extract_all(substr(text, k * 400 + 1, 400), '[0-9][0-9,.]*')) as n from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil(length(text) / 400) as bigint)))) as k from documents)) select doc_id, case when max(n) >= 3 then cast(arg_min(k, (-n, k)) * 400 as bigint) end as at from b group by doc_id""",
    "proxy_shape": "select *, case when prices > 1 then 'several_prices' when prices = 1 then 'one_price' else 'no_price' end as shape from (select accession, count(*) as figures, count(*) filter (where field = 'consideration_per_share' and reason = 'stated') as prices, count(*) filter (where field = 'premium_pct' and reason = 'stated') as premiums, count(*) filter (where field = 'termination_fee' and reason = 'stated') as fees from proxy_figure group by 1)",
    "projection_growth": "with y as (select accession, coalesce(scenario, '') as scenario, fiscal_year, max(revenue) as v from proxy_projection where revenue > 0 group by all), g as (select accession, scenario, count(*) as points, min(fiscal_year) as first_year, max(fiscal_year) as last_year, arg_min(v, fiscal_year) as a, arg_max(v, fiscal_year) as b from y group by all) select accession, scenario, points, first_year, last_year, round(case when last_year > first_year then pow(b::double / a::double, 1.0::double / (last_year - first_year)) - 1 end, 6) as cagr from g",
    "projection_coherence": "with w as (select *, lag(revenue) over (partition by accession, coalesce(scenario, '') order by fiscal_year, id) as prior from proxy_projection), y as (select id, case when revenue is null then 'no_revenue' when ebit > ebitda then 'ebit_above_ebitda' when not (ebitda::double / nullif(revenue::double, 0) between -2.0 and 0.7) then 'margin' when revenue::double / nullif(prior::double, 0) > 10 or revenue::double / nullif(prior::double, 0) < 0.1 then 'step' end as why from w) select id, why is null as coherent, why from y",
    "dataset_stats": "select 'prices' as dataset, count(*) as rows, strftime(max(date), '%Y-%m-%d') as newest from prices_eod_raw union all select 'deals', count(*), strftime(max(filed_date), '%Y-%m-%d') from deals union all select 'history', count(*), strftime(max(last_seen), '%Y-%m-%d') from company_ticker_history union all select 'documents', count(*), strftime(max(filed_date), '%Y-%m-%d') from documents",
    "overdue_jobs": "with l as (select event_type as job, max(ts) as last_run from events group by 1) select job, case when job < 'm' then 1 else 1000 end as due_every_hours, epoch(timestamp '2024-02-05 00:00:00') - floor(epoch(last_run)) > (case when job < 'm' then 1 else 1000 end) * 3600 as overdue from l",
})
ORACLE_SQL["stopped_filers"] = f"select cik, last_period from ({ORACLE_SQL['filer_universe']}) where status = 'stopped'"
