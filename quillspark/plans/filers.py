"""Plans over filed figures: resolution of tags, filer universe, peers, valuation, multiples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.exprs import cik_key
from quillspark.operators.bands import banded_ladder
from quillspark.operators.quality import funnel
from quillspark.session import checkpointed

# Statuses of a resolved figure.
STATED, ABSENT, UNMAPPED, NOT_USD, SEGMENT_ONLY, PERIOD_MISMATCH = "stated", "absent", "unmapped", "not_usd", "segment_only", "period_mismatch"
# Industry codes of companies whose figures are not comparable.
SIC_CLASSES = ((6000, 6199, "bank_credit"), (6200, 6299, "broker"), (6300, 6411, "insurance"), (6500, 6599, "real_estate"), (6700, 6799, "holding"))
#: First fiscal-year start of the current revenue standard.
ERA_START = date(2017, 12, 15)


@dataclass(frozen=True)
class Concept:
    """A figure and the tags that may carry it, best first; quarters 0 is a balance, 4 a year's flow."""

    name: str
    tags: tuple[str, ...]
    quarters: int
    unmapped_like: str | None = None


# The tags of each concept, in order of preference.
CONCEPTS = (
    Concept("revenue", ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "RegulatedAndUnregulatedOperatingRevenue", "RegulatedOperatingRevenue", "RevenueNotFromContractWithCustomer", "RevenueFromCollaborativeArrangementExcludingRevenueFromContractWithCustomer", "OperatingLeaseLeaseIncome", "SalesRevenueNet", "SalesRevenueGoodsNet"), 4, r"revenue|sales|fees|premium|interestincome"),
    Concept("net_income", ("NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"), 4),
    Concept("assets", ("Assets",), 0),
    Concept("liabilities", ("Liabilities",), 0),
    Concept("equity", ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"), 0),
    Concept("capex", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"), 4),
    Concept("operating_cash_flow", ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"), 4),
)


def sic_class(sic):
    """Class of an industry code: real-estate trusts first, then the financial ranges; none is unclassified."""
    named = F.when(sic.isNull(), "unclassified").when(sic == 6798, "reit")
    for low, high, name in SIC_CLASSES:
        named = named.when(sic.between(low, high), name)
    return named.otherwise("operating")


def typed_submissions(sub: DataFrame) -> DataFrame:
    """Submissions with types; the raw table is all text."""
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")
    typed = sub.select("adsh", cik_key("cik").alias("cik"), F.col("name").alias("company"), F.expr("try_cast(sic as int)").alias("sic"), "form", "fp", day("period").alias("period_end"), day("filed").alias("filed"))
    return typed.withColumn("sic_class", sic_class(F.col("sic")))


def _annual(subs: DataFrame):
    fiscal_start = F.date_add(F.add_months("period_end", -12), 1)
    return [("submissions", F.lit(True)), ("annual report", F.col("form") == "10-K"), ("full fiscal year", F.col("fp") == "FY"), ("classified", F.col("sic_class") != "unclassified"), ("operating company", F.col("sic_class") == "operating"), ("current era", fiscal_start >= F.lit(ERA_START))]


def population_funnel(sub: DataFrame) -> DataFrame:
    """The submissions, stage by stage, down to the filings that facts are resolved for."""
    subs = typed_submissions(sub)
    return funnel(subs, _annual(subs))


def population(sub: DataFrame) -> DataFrame:
    """The filings that facts are resolved for."""
    subs = typed_submissions(sub)
    for _, condition in _annual(subs):
        subs = subs.where(condition)
    return subs


def toplines(pre: DataFrame, pop: DataFrame) -> DataFrame:
    """``adsh, topline``: the tag that opens each filing's income statement, by (report, line, tag)."""
    rows = pre.where("stmt = 'IS' and inpth = '0'").select("adsh", "tag", F.expr("try_cast(report as int)").alias("report"), F.expr("try_cast(line as int)").alias("line")).where("report is not null and line is not null")
    return rows.join(pop.select("adsh"), "adsh", "left_semi").groupBy("adsh").agg(F.min(F.struct("report", "line", "tag")).alias("m")).select("adsh", F.col("m.tag").alias("topline"))


def resolve_facts(sub: DataFrame, num: DataFrame, pre: DataFrame, *, concepts: Sequence[Concept] = CONCEPTS, taxonomy: str = "us-gaap/%") -> DataFrame:
    """One row per filing and concept: ``adsh, cik, company, sic, concept, tag, value, status, unmapped_tag, period_end, filed``.

    All concepts go through one aggregation per (filing, concept): the fact rows join
    the small tag map once, the winner is the least (rank, tag) among rows in dollars,
    undimensioned, of the filer itself, for its own period and with a value; the same pass
    collects what speaks for each other status.  Precedence: stated; a nil tag at the
    period is absent; another period; segments only; another currency; a
    revenue-like topline that the map lacks is unmapped; else absent.
    """
    spark = sub.sparkSession
    pop = population(sub)
    mapping = F.broadcast(spark.createDataFrame([(c.name, t, i, c.quarters) for c in concepts for i, t in enumerate(c.tags)], "concept string, tag string, rank int, due_quarters int"))
    facts = num.where(F.col("version").like(taxonomy)).join(mapping, "tag").join(pop.select("adsh", "period_end"), "adsh")
    own_axis = (F.coalesce("coreg", F.lit("")) == "") & (F.coalesce("segments", F.lit("")) == "")
    facts = facts.select(
        "adsh", "concept", "tag", "rank", F.expr("try_cast(value as decimal(28,4))").alias("value"), (F.coalesce("value", F.lit("")) != "").alias("has"),
        (own_axis & F.coalesce(F.col("uom") == "USD", F.lit(False))).alias("plain"), (own_axis & F.coalesce(F.col("uom") != "USD", F.lit(False))).alias("foreign"), ((F.coalesce("coreg", F.lit("")) == "") & (F.coalesce("segments", F.lit("")) != "")).alias("segment"),
        F.coalesce((F.expr("try_cast(qtrs as int)") == F.col("due_quarters")) & (F.try_to_timestamp("ddate", F.lit("yyyyMMdd")).cast("date") == F.col("period_end")), F.lit(False)).alias("own"),
    )
    usable = F.col("plain") & F.col("own") & F.col("has")
    g = facts.groupBy("adsh", "concept").agg(
        F.min(F.when(usable, F.struct("rank", "tag", F.col("value").alias("v")))).alias("win"), F.bool_or(F.col("plain") & F.col("own") & ~F.col("has")).alias("nil"), F.bool_or(F.col("plain") & ~F.col("own") & F.col("has")).alias("other"),
        F.bool_or(F.col("segment") & F.col("has")).alias("dim"), F.bool_or(F.col("foreign") & F.col("has")).alias("ccy"),
    )
    like = F.broadcast(spark.createDataFrame([(c.name, c.unmapped_like) for c in concepts], "concept string, unmapped_like string"))
    every = pop.select("adsh", "cik", "company", "sic", "period_end", "filed").crossJoin(like).join(g, ["adsh", "concept"], "left").join(toplines(pre, pop), "adsh", "left")
    odd = F.coalesce(F.expr("rlike(topline, concat('(?i)', unmapped_like))"), F.lit(False))
    status = F.when(F.col("win").isNotNull(), STATED).when(F.col("nil"), ABSENT).when(F.col("other"), PERIOD_MISMATCH).when(F.col("dim"), SEGMENT_ONLY).when(F.col("ccy"), NOT_USD).when(odd, UNMAPPED).otherwise(ABSENT)
    return every.select("adsh", "cik", "company", "sic", "concept", F.col("win.tag").alias("tag"), F.col("win.v").alias("value"), status.alias("status"), F.when(F.col("unmapped_like").isNotNull(), F.col("topline")).alias("unmapped_tag"), "period_end", "filed")


def coverage_by_status(facts: DataFrame) -> DataFrame:
    """``concept, status, filings, filers``."""
    return facts.groupBy("concept", "status").agg(F.count("*").alias("filings"), F.countDistinct("cik").alias("filers"))


def coverage_matrix(facts: DataFrame) -> DataFrame:
    """``concept, year, quarter, filings, stated, share``: coverage by quarter of the year, never pooled over quarters."""
    g = facts.groupBy("concept", F.year("filed").alias("year"), F.quarter("filed").alias("quarter")).agg(F.count("*").alias("filings"), F.count_if(F.col("status") == STATED).alias("stated"))
    return g.withColumn("share", F.round(F.col("stated") / F.col("filings"), 6))


def coverage_drift(facts: DataFrame) -> DataFrame:
    """``concept, quarter, least, greatest, span``: the span of a concept's coverage within the same quarter of different years."""
    return coverage_matrix(facts).groupBy("concept", "quarter").agg(F.min("share").alias("least"), F.max("share").alias("greatest")).withColumn("span", F.round(F.col("greatest") - F.col("least"), 6))


def unmapped_queue(facts: DataFrame, *, top: int = 20) -> DataFrame:
    """The most frequent toplines that the map lacks, per concept (a top-k report)."""
    n = facts.where(F.col("status") == UNMAPPED).groupBy("concept", "unmapped_tag").agg(F.count("*").alias("filings"))
    w = Window.partitionBy("concept").orderBy(F.desc("filings"), "unmapped_tag")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def filer_universe(sub: DataFrame, *, stopped_days: int = 548) -> DataFrame:
    """One row per filer: name and code at the newest filing that has them, spans, counts, forms, and whether it still files."""
    s = typed_submissions(sub).where("cik is not null and period_end is not null")
    at = F.struct("filed", "period_end", "adsh")
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    g = s.groupBy("cik").agg(newest("company"), newest("sic"), F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"), F.count("*").alias("filings"), F.countDistinct("company").alias("names"), F.array_join(F.array_sort(F.collect_set("form")), ",").alias("forms"))
    whole = s.agg(F.max("period_end").alias("newest"))
    g = g.crossJoin(F.broadcast(whole))
    status = F.when(F.datediff("newest", "last_period") <= stopped_days, "filing").when(F.col("last_filed") >= F.date_sub("newest", stopped_days), "pending").otherwise("stopped")
    return g.withColumn("status", status).drop("newest")


def latest_figures(facts: DataFrame) -> DataFrame:
    """One row per operating filer with its newest figure of each concept; figures not stated are NULL.

    One fold per filer: rows in order of filers need neither a shuffle nor a sort.
    """
    at = F.struct("period_end", "filed", "adsh", "concept")
    newest = lambda c: F.max(F.when(F.col("concept") == c, F.struct("period_end", "filed", "adsh", F.when(F.col("status") == STATED, F.col("value")).alias("v"))))["v"].alias(c)
    return facts.where("sic_class = 'operating'").groupBy("cik").agg(F.max_by("company", at).alias("company"), F.max_by("sic", at).alias("sic"), F.max("period_end").alias("period_end"), *(newest(c) for c in ("revenue", "assets", "operating_cash_flow", "capex", "equity", "liabilities", "net_income")))


def _peer_pairs(base: DataFrame, peers: DataFrame, *, depth: int, band: float) -> DataFrame:
    """(filer, peer) rows of one industry depth within the size band.

    Sizes fall into log buckets as wide as the band, so peers lie in the own
    and the two neighbouring buckets: an equi-join on (industry, bucket) with the exact
    band as residual, not a join of whole industries.
    """
    div = 10 ** (4 - depth)
    bucket = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(float(band))))
    mine = base.select(F.col("cik").alias("a_cik"), F.col("assets").alias("a_size"), F.expr(f"sic div {div}").alias("ind"), F.explode(F.expr("sequence(-1, 1)")).alias("o")).withColumn("bucket", bucket(F.col("a_size")) + F.col("o"))
    theirs = peers.withColumn("ind", F.expr(f"sic div {div}")).withColumn("bucket", bucket(F.col("assets"))).withColumnsRenamed({"cik": "p_cik", "assets": "p_size"}).drop("sic", "company")
    size = F.col("p_size").cast("double")
    near = (size >= F.col("a_size").cast("double") / band) & (size <= F.col("a_size").cast("double") * band)
    return mine.join(theirs, ["ind", "bucket"]).where(near & (F.col("a_cik") != F.col("p_cik")))


def peer_sets(facts: DataFrame, *, material: int = 1_000_000, least: int = 8, band: float = 3.0, depths: Sequence[int] = (4, 3, 2)) -> DataFrame:
    """Peers of every operating filer by industry and size, with the ladder's answer.

    The first depth with enough material peers serves; counts and ratios all come from that depth.  Neither needs
    pairs, which would grow as the square of an industry: the filers of an industry of the least depth meet once, in
    one Arrow group with one row each, and ``banded_ladder`` reads counts and quartiles off their order of sizes.
    """
    base = latest_figures(facts).select("cik", "company", "sic", "revenue", "assets").withColumn("turnover", F.when((F.col("assets") > 0) & F.col("revenue").isNotNull(), F.col("revenue").cast("double") / F.col("assets").cast("double")))
    placeable = F.coalesce(F.col("cik").isNotNull() & F.col("sic").isNotNull() & (F.col("assets") > 0), F.lit(False))
    base = base.withColumns({"_size": F.when(placeable, F.col("assets").cast("double")), "_material": F.coalesce(F.col("revenue") > material, F.lit(False))})
    steps = sorted(depths, reverse=True)
    divisors = [10 ** (4 - d) for d in steps]

    def ladder(group: pa.Table) -> pa.Table:
        if group["_size"].null_count:  # the filers without a place
            return group.append_column("depth", pa.nulls(len(group), pa.int32())).append_column("banded", pa.nulls(len(group), pa.int64())).append_column("material", pa.nulls(len(group), pa.int64())).append_column("median", pa.nulls(len(group), pa.float64())).append_column("iqr", pa.nulls(len(group), pa.float64()))
        numbers = [group[c].to_numpy() for c in ("sic", "_size", "turnover", "_material")]
        step, banded, count, (q1, q2, q3) = banded_ladder(*numbers, band=band, least=least, divisors=divisors, shares=(0.25, 0.5, 0.75))
        none = step < 0
        for name, values, missing in (("depth", np.array(steps, np.int32)[step], none), ("banded", banded, none), ("material", count, none), ("median", q2, np.isnan(q2)), ("iqr", q3 - q1, np.isnan(q2))):
            group = group.append_column(name, pa.array(values, mask=missing))
        return group

    # filers without a place have no industry to meet in
    place = base.withColumns({"_industry": F.when(placeable, F.expr(f"sic div {divisors[-1]}")), "_spread": F.when(~placeable, F.pmod(F.xxhash64("cik"), F.lit(64)))})
    schema = T.StructType(place.schema.fields + [T.StructField("depth", T.IntegerType()), T.StructField("banded", T.LongType()), T.StructField("material", T.LongType()), T.StructField("median", T.DoubleType()), T.StructField("iqr", T.DoubleType())])
    out = place.groupBy("_industry", "_spread").applyInArrow(ladder, schema)

    depth = F.col("depth")
    outcome = F.when(F.col("sic").isNull() | F.coalesce(F.col("assets") <= 0, F.lit(True)), "unplaceable").when(F.coalesce(F.col("revenue") <= material, F.lit(True)), "immaterial").when(depth.isNull(), "too_few_peers").otherwise("served")
    got = out.select("cik", "company", "sic", "revenue", "assets", depth.alias("sic_depth"), F.coalesce("banded", F.lit(0)).alias("peers_banded"), F.coalesce("material", F.lit(0)).alias("peers_material"), F.round("median", 6).alias("turnover_median"), F.round("iqr", 6).alias("turnover_iqr"), F.round("turnover", 6).alias("turnover_self"), outcome.alias("outcome"))
    return got.withColumn("depth_fell_back", F.coalesce(F.col("sic_depth") < depths[0], F.lit(False))).withColumn("thinned", F.coalesce(F.col("peers_material") * 2 < F.col("peers_banded"), F.lit(False)))


def band_counts(base: DataFrame, peers: DataFrame, *, depth: int, band: float, measures: dict) -> DataFrame:
    """``cik`` and, per measure (a condition on peers), how many other filers of its industry and size band meet it.

    No pairs: peers and the two bounds of each filer lie in one order of sizes per
    industry, running sums are read off at the bounds, and their difference is the count.
    """
    div, size = 10 ** (4 - depth), F.col("assets").cast("double")
    ones = [F.coalesce(c, F.lit(False)).cast("bigint").alias(n) for n, c in measures.items()]
    points = peers.select(F.expr(f"sic div {div}").alias("ind"), size.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("cik"), *ones)
    none = [F.lit(0).cast("bigint").alias(n) for n in measures]
    bound = lambda at, kind: base.select(F.expr(f"sic div {div}").alias("ind"), at.alias("at"), F.lit(kind).alias("kind"), "cik", *none)
    order = points.unionByName(bound(size / band, 0)).unionByName(bound(size * band, 2))
    w = Window.partitionBy("ind").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = order.select("cik", "kind", *(F.sum(n).over(w).alias(n) for n in measures)).where("cik is not null")
    ends = run.groupBy("cik").agg(*(F.sum(F.when(F.col("kind") == 2, F.col(n)).otherwise(-F.col(n))).alias(n) for n in measures))
    own = peers.select("cik", *(o.alias(f"_{n}") for n, o in zip(measures, ones)))
    return ends.join(own, "cik", "left").select("cik", *((F.col(n) - F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in measures))


def _depth_choice(base: DataFrame, peers: DataFrame, *, depths: Sequence[int], band: float, measures: dict, deciding: str, least: int) -> DataFrame:
    """``cik, depth`` and the measures at the first depth where ``deciding`` reaches ``least``; filers without one are left out."""
    all_counts = None
    for d in depths:
        c = band_counts(base, peers, depth=d, band=band, measures=measures).select("cik", F.struct(F.lit(-d).alias("order"), F.lit(d).alias("depth"), *measures).alias("c"))
        all_counts = c if all_counts is None else all_counts.unionByName(c)
    return checkpointed(all_counts.where(F.col(f"c.{deciding}") >= least).groupBy("cik").agg(F.min("c").alias("c")).select("cik", "c.depth", *(f"c.{n}" for n in measures)))


def _at_depth(base: DataFrame, peers: DataFrame, choice: DataFrame, summary, *, depths: Sequence[int], band: float) -> DataFrame:
    """``summary`` of each filer's pairs at its own depth only: no filer meets the peers of a depth that does not serve it."""
    found = None
    for d in depths:
        mine = base.join(choice.where(F.col("depth") == d).select("cik"), "cik", "left_semi")
        got = summary(_peer_pairs(mine, peers, depth=d, band=band))
        found = got if found is None else found.unionByName(got)
    return found


def peer_outcomes(sets: DataFrame) -> DataFrame:
    """Filers by outcome and depth."""
    return sets.groupBy("outcome", F.when(F.col("outcome") == "served", F.col("sic_depth")).alias("sic_depth")).agg(F.count("*").alias("filers"))


def peer_alternatives(facts: DataFrame, *, choices: Sequence[tuple[int, int]] = ((0, 8), (1_000_000, 8), (10_000_000, 8), (50_000_000, 8), (1_000_000, 3), (1_000_000, 12)), band: float = 3.0, depths: Sequence[int] = (4, 3, 2)) -> DataFrame:
    """``material, least, served``: filers that other floors would serve, from one pass over the pairs of each depth."""
    base = checkpointed(latest_figures(facts).select("cik", "sic", "revenue", "assets").where("sic is not null and assets > 0"))
    counts = base
    for d in depths:
        measures = {f"d{d}_{m}": F.col("revenue") > m for m in sorted({m for m, _ in choices})}
        counts = counts.join(band_counts(base, base, depth=d, band=band, measures=measures), "cik", "left")
    served = [F.count_if((F.col("revenue") > m) & (F.greatest(*(F.coalesce(f"d{d}_{m}", F.lit(0)) for d in depths)) >= n)).alias(f"s{k}") for k, (m, n) in enumerate(choices)]
    rows = F.array(*(F.struct(F.lit(m).alias("material"), F.lit(n).alias("least"), F.col(f"s{k}").alias("served")) for k, (m, n) in enumerate(choices)))
    return counts.agg(*served).select(F.inline(rows))


def peer_median(facts: DataFrame, values: DataFrame, *, least: int = 8, band: float = 3.0, depths: Sequence[int] = (4, 3, 2)) -> DataFrame:
    """``cik, sic_depth, n, median_value``: the peers' median of any value per filer, at the first depth with enough peers that have one."""
    base = checkpointed(latest_figures(facts).select("cik", "sic", "assets").where("sic is not null and assets > 0"))
    having = checkpointed(base.join(values.select("cik", F.col("value").alias("_v")).where("_v is not null"), "cik"))
    choice = _depth_choice(base, having, depths=depths, band=band, measures={"n": F.lit(True)}, deciding="n", least=least)
    median = lambda pairs: pairs.groupBy("a_cik").agg(F.median(F.col("_v").cast("double")).alias("median")).withColumnRenamed("a_cik", "cik")
    got = base.select("cik").join(choice, "cik", "left").join(_at_depth(base, having, choice, median, depths=depths, band=band), "cik", "left")
    return got.select("cik", F.col("depth").alias("sic_depth"), "n", F.round("median", 6).alias("median_value"))


@dataclass(frozen=True)
class ValuationRates:
    """Rates and bounds of the discounted-cash-flow arithmetic."""

    risk_free: float = 0.0483
    premium: float = 0.0433
    flat: float = 0.095
    spread: float = 0.02
    tax: float = 0.21
    growth: float = 0.03
    long_growth: float = 0.025
    years: int = 10
    least_rate: float = 0.04


def present_value(cash, rate, growth, long_growth, years: int):
    """Closed form of ``years`` of growing cash and a growing perpetuity after them."""
    ratio = (1 + growth) / (1 + rate)
    explicit = F.when(F.abs(rate - growth) < 1e-9, cash * years).otherwise(cash * ratio * (1 - F.pow(ratio, F.lit(years))) / (1 - ratio))
    return explicit + cash * F.pow(1 + growth, F.lit(years)) * (1 + long_growth) / (rate - long_growth) / F.pow(1 + rate, F.lit(years))


#: Growth rates that every value is flexed at, by the name of its column.
FLEX_GROWTH = {"flex_0": 0.00, "flex_3": 0.03, "flex_6": 0.06, "flex_10": 0.10}
#: How far a filer's past growth may lie from the constant before its row says so.
GROWTH_BAND = 0.10


def past_growth(facts: DataFrame) -> DataFrame:
    """``cik, past``: yearly growth of revenue between the first and the last positive year stated."""
    rows = facts.where((F.col("concept") == "revenue") & (F.col("status") == STATED) & (F.col("value") > 0)).groupBy("cik", F.year("period_end").alias("y")).agg(F.max("value").alias("v"))
    g = rows.groupBy("cik").agg(F.min(F.struct("y", "v")).alias("a"), F.max(F.struct("y", "v")).alias("b")).where("b.y > a.y")
    return g.select("cik", F.round(F.pow(F.col("b.v").cast("double") / F.col("a.v").cast("double"), 1.0 / (F.col("b.y") - F.col("a.y"))) - 1, 9).alias("past"))


def valuations(facts: DataFrame, *, betas: DataFrame | None = None, peer_betas: DataFrame | None = None, growths: DataFrame | None = None, past: DataFrame | None = None, rates: ValuationRates = ValuationRates()) -> DataFrame:
    """One row per operating filer: free cash flow, discount rate, value, value at other growths, outcome, and the substitutions made.

    Pure column arithmetic.  A filer's own ``betas`` (``cik, beta``) holds before that of its peers
    (``peer_betas``: ``cik, beta, depth``), which is marked, and once more if a widened industry served; its own
    ``growths`` (``cik, growth``) before the constant, which is marked, and once more if its ``past``
    (``cik, past``) lies far from it.  Rate and substitutions are those of valued filers only.
    """
    f = latest_figures(facts)
    f = f.join(betas.select("cik", F.col("beta").cast("double").alias("own_beta")), "cik", "left") if betas is not None else f.withColumn("own_beta", F.lit(None).cast("double"))
    f = f.join(peer_betas.select("cik", F.col("beta").cast("double").alias("peer_beta"), "depth"), "cik", "left") if peer_betas is not None else f.withColumns({"peer_beta": F.lit(None).cast("double"), "depth": F.lit(None).cast("int")})
    f = f.join(growths.select("cik", F.col("growth").cast("double").alias("own_growth")), "cik", "left") if growths is not None else f.withColumn("own_growth", F.lit(None).cast("double"))
    f = f.join(past.select("cik", F.col("past").cast("double").alias("past")), "cik", "left") if past is not None else f.withColumn("past", F.lit(None).cast("double"))
    d = lambda c: F.col(c).cast("double")
    beta = F.coalesce("own_beta", "peer_beta")
    cash = F.when(F.col("operating_cash_flow").isNotNull(), (F.col("operating_cash_flow") - F.coalesce(F.abs("capex"), F.lit(0))).cast("double"))  # exact up to here
    equity_cost = F.when(beta.isNotNull(), rates.risk_free + beta * rates.premium).otherwise(F.lit(rates.flat))
    debt_cost = (rates.risk_free + rates.spread) * (1 - rates.tax)
    whole = F.coalesce(d("equity"), F.lit(0.0)) + F.coalesce(d("liabilities"), F.lit(0.0))
    rate = F.when(whole > 0, (F.coalesce(d("equity"), F.lit(0.0)) * equity_cost + F.coalesce(d("liabilities"), F.lit(0.0)) * debt_cost) / whole).otherwise(equity_cost)
    long_growth = min(rates.long_growth, rates.risk_free)
    growth = F.coalesce("own_growth", F.lit(rates.growth))
    v = f.withColumn("fcf", cash).withColumn("rate", rate).withColumn("g", growth)
    outcome = F.when(F.col("fcf").isNull(), "no_cash_flow").when(F.col("fcf") <= 0, "negative_fcf").when((F.col("rate") < rates.least_rate) | (F.lit(long_growth) >= F.col("rate")), "no_discount_rate").otherwise("valued")
    v = v.withColumn("outcome", outcome)
    valued = F.col("outcome") == "valued"
    of_peers = F.col("own_beta").isNull() & F.col("peer_beta").isNotNull()
    marks = {
        "peer_beta": of_peers, "comp_depth": of_peers & (F.col("depth") < 4), "absent_capex": F.col("operating_cash_flow").isNotNull() & F.col("capex").isNull(), "erp_constant": F.lit(True),
        "growth_constant": F.col("own_growth").isNull(), "growth_mismatch": F.col("own_growth").isNull() & (F.abs(F.col("past") - rates.growth) > GROWTH_BAND), "no_beta": beta.isNull(),
    }
    subs = F.array_compact(F.array(*(F.when(valued & condition, F.lit(name)) for name, condition in marks.items())))
    at = lambda g: F.round(F.when(valued, present_value(F.col("fcf"), F.col("rate"), g, F.lit(long_growth), rates.years)), 0)
    return v.select("cik", "company", "period_end", "fcf", F.round(F.when(valued, F.col("rate")), 8).alias("rate"), at(F.col("g")).alias("value"), *(at(F.lit(g)).alias(name) for name, g in FLEX_GROWTH.items()), "outcome", F.array_join(subs, ",").alias("substitutions"))


def valuation_coverage(valued: DataFrame) -> DataFrame:
    """``year, quarter, valued, filers`` by the quarter of the fiscal year's end, never pooled over quarters."""
    rows = valued.where("period_end is not null").groupBy(F.year("period_end").alias("year"), F.quarter("period_end").alias("quarter"))
    return rows.agg(F.count_if(F.col("outcome") == "valued").alias("valued"), F.count("*").alias("filers"))


#: What the filing record says of a deal's target.
ACQUIRED_WHOLE, KEPT_FILING, TOO_RECENT = "acquired_whole", "kept_filing", "too_recent"


def priced_deals(deals: DataFrame) -> DataFrame:
    """One row per accession, its newest delivery: operating deals of a stated value whose filer is not the buyer."""
    rest = [c for c in ("cik", "company", "filed_date", "value_usd", "consideration", "items", "deal_type", "filer_role") if c in deals.columns]
    one = deals.where("accession is not null").groupBy("accession").agg(F.max(F.struct("ingested_at", "id", *rest)).alias("d")).select("accession", *(f"d.{c}" for c in rest))
    return one.where("filer_role <> 'acquirer' and value_usd is not null and deal_type = 'operating'").withColumn("cik10", cik_key("cik"))


def deal_identity(deals: DataFrame, facts: DataFrame, universe: DataFrame | None, *, today, confirm_days: int = 548, by_facts: bool = False) -> DataFrame:
    """``priced_deals`` with ``pre_end, last_end, filer_status, last_deal_filing, identity``.

    ``identity`` is NULL without an annual figure before the deal; kept_filing if the filer reported a later
    period or filed a later deal; too_recent if less than ``confirm_days`` of record lie after it;
    else acquired_whole.  ``universe`` (``cik, last_period, status``) knows every filer; without it the
    caller must ask for the weaker test ``by_facts``, or it is an error.
    ``facts``: ``cik, period_end, ...``; keys are read in any spelling.
    """
    if universe is None and not by_facts:
        raise ValueError("no filer universe; by_facts=True asks for the weaker test by the figures alone")
    d = priced_deals(deals)
    periods = facts.select(cik_key("cik").alias("cik10"), "period_end").where("period_end is not null").distinct()
    if universe is None:
        known = periods.groupBy("cik10").agg(F.max("period_end").alias("last_end"), F.lit(None).cast("string").alias("filer_status"))
    else:
        known = universe.groupBy(cik_key("cik").alias("cik10")).agg(F.max("last_period").alias("last_end"), F.max_by("status", "last_period").alias("filer_status"))
    before = d.join(periods, "cik10").where("period_end < filed_date").groupBy("accession").agg(F.max("period_end").alias("pre_end"))
    later = deals.groupBy(cik_key("cik").alias("cik10")).agg(F.max("filed_date").alias("last_deal_filing"))
    coverage = facts.agg(F.max("period_end").alias("coverage_to"))
    m = d.join(before, "accession", "left").join(known, "cik10", "left").join(later, "cik10", "left").crossJoin(F.broadcast(coverage))
    recent = (F.datediff(F.lit(today).cast("date"), "filed_date") < confirm_days) | (F.datediff(F.coalesce("coverage_to", F.lit("1900-01-01").cast("date")), "filed_date") < confirm_days)
    identity = F.when(F.col("pre_end").isNull(), F.lit(None).cast("string")).when(F.col("last_end") > F.col("pre_end"), KEPT_FILING).when(F.col("last_deal_filing") > F.col("filed_date"), KEPT_FILING).when(recent, TOO_RECENT).otherwise(ACQUIRED_WHOLE)
    return m.withColumn("identity", identity).drop("coverage_to")


def deal_multiples(identified: DataFrame, facts: DataFrame) -> DataFrame:
    """Value over revenue and net income of the last annual figures before the deal, for targets acquired whole whose revenue is stated.

    Both figures and their tags are those at ``pre_end``; a ratio is NULL where its denominator is not above zero.
    """
    f = facts.where((F.col("status") == STATED) & F.col("concept").isin("revenue", "net_income")).select(cik_key("cik").alias("cik10"), F.col("period_end").alias("pre_end"), "concept", "value")
    pick = lambda c: F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c)
    whole = identified.where(F.col("identity") == ACQUIRED_WHOLE)
    at = f.join(whole.select("cik10", "pre_end").distinct(), ["cik10", "pre_end"], "left_semi").groupBy("cik10", "pre_end").agg(pick("revenue"), pick("net_income"))
    rows = whole.join(at, ["cik10", "pre_end"]).where("revenue is not null")
    ratio = lambda c: F.round(F.when(F.col(c) > 0, F.col("value_usd").cast("double") / F.col(c).cast("double")), 6)
    return rows.select("accession", "cik10", "filed_date", "value_usd", "pre_end", "revenue", "net_income", ratio("revenue").alias("to_revenue"), ratio("net_income").alias("to_income"))
