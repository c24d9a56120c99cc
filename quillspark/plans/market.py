"""Plans over daily bars: adjusted moves, audits, event studies, series.

Prices stay raw; splits and dividends come in at query time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.exprs import price_band, ratio6, tick_size
from quillspark.operators.actions import actions_between, month_no, months_of, split_or_one
from quillspark.operators.quality import funnel


@dataclass(frozen=True)
class MoveRules:
    """Thresholds of the move plan."""

    floor: float = 0.01
    most_gap_days: int = 30
    suspect_jump: float = 1.0
    suspect_fall: float = -0.6
    adv_sessions: int = 30
    liquid_volume: float = 5_000_000
    top: int = 10


def trailing_dollar_volume(bars: DataFrame, *, sessions: int = 30, partition: Sequence[str] = ("ticker", "listing_id")) -> DataFrame:
    """``bars`` with ``avg_dollar_volume DOUBLE`` and ``adv_sessions`` over the trailing sessions of each listing."""
    w = Window.partitionBy(*partition).orderBy("date").rowsBetween(-(sessions - 1), 0)
    dollars = F.sum((F.col("close") * F.col("volume").cast("decimal(19,0)")).cast("decimal(38,2)")).over(w)  # a decimal sum: its order is of no account
    return bars.withColumn("adv_sessions", F.count("*").over(w)).withColumn("avg_dollar_volume", dollars.cast("double") / F.col("adv_sessions"))


def moves(bars: DataFrame, actions: DataFrame, rules: MoveRules = MoveRules(), *, adjust_dividends: bool = False) -> DataFrame:
    """One row per bar with a prior bar of its listing: the split-adjusted move and its flags.

    Lag and trailing volume share one sort of (ticker, listing); actions join
    by ticker and month and touch only the bars that have any.  Flags
    (floor, gap, unexplained jump or fall) are columns, never filters.  A dividend counts as
    an action.  Bars without close or volume are no bars; a NULL listing is a listing.
    """
    px = bars.where("close is not null and volume is not null").select("ticker", "listing_id", "date", "close", "volume", "security_type", "exchange")
    w = Window.partitionBy("ticker", "listing_id").orderBy("date")
    seq = trailing_dollar_volume(px, sessions=rules.adv_sessions).withColumn("prev_close", F.lag("close").over(w)).withColumn("prev_date", F.lag("date").over(w)).where("prev_close is not null")
    acted = actions_between(seq.select("ticker", "listing_id", "date", "prev_date"), actions, after="prev_date", upto="date", keys=("ticker", "listing_id", "date"))
    acted = acted.select(F.col("ticker").alias("_t"), F.col("listing_id").alias("_l"), F.col("date").alias("_dt"), "split_factor", "div_cash", "n_actions")
    j = seq.join(acted, (F.col("ticker") == F.col("_t")) & F.col("listing_id").eqNullSafe(F.col("_l")) & (F.col("date") == F.col("_dt")), "left").drop("_t", "_l", "_dt")
    j = j.withColumn("split_factor", split_or_one()).withColumn("div_cash", F.coalesce("div_cash", F.lit(0).cast("decimal(18,6)"))).withColumn("n_actions", F.coalesce("n_actions", F.lit(0)))
    j = j.withColumn("adj_prev_close", ratio6(F.col("prev_close"), F.col("split_factor")))
    shown = (F.col("close") + F.col("div_cash")) if adjust_dividends else F.col("close")
    change = (shown - F.col("adj_prev_close")).cast("double")
    share = F.try_divide(change, F.col("adj_prev_close").cast("double"))
    gap = F.datediff("date", "prev_date")
    return j.select(
        "ticker", "date", "security_type", "exchange", price_band(F.col("adj_prev_close")).alias("band"), "close", "adj_prev_close",
        (share * 100).cast("decimal(24,6)").alias("pct_move"), (change / tick_size(F.col("adj_prev_close"))).cast("decimal(24,6)").alias("tick_move"),
        "volume", "avg_dollar_volume", "adv_sessions", "split_factor", "div_cash", (F.col("div_cash") > 0).alias("is_ex_div"), "listing_id", gap.alias("gap_days"),
        ((F.col("adj_prev_close") >= rules.floor) & (F.col("close") >= rules.floor)).alias("passes_floor"), (gap <= rules.most_gap_days).alias("within_gap"),
        ((F.col("n_actions") == 0) & F.coalesce(share > rules.suspect_jump, F.lit(False))).alias("action_suspect"),
        ((F.col("n_actions") == 0) & F.coalesce(share < rules.suspect_fall, F.lit(False))).alias("unexplained_fall"),
    )


def kept(moved: DataFrame) -> DataFrame:
    """The moves that a ranking may show."""
    return moved.where("passes_floor and within_gap and not action_suspect")


def is_liquid(rules: MoveRules = MoveRules()):
    return (F.col("avg_dollar_volume") > rules.liquid_volume) & (F.col("adv_sessions") >= rules.adv_sessions)


def top_moves(moved: DataFrame, rules: MoveRules = MoveRules(), *, per: Sequence[str] = ("date",)) -> DataFrame:
    """The top moves per type, band, liquidity and direction, for each day.

    The sign is filtered before ranking, so a gainers list never holds a
    loser; ties go by ticker and listing.  Each move enters the list of all and, if liquid, that of liquid names.
    """
    entry = kept(moved).where("pct_move <> 0").withColumn("direction", F.when(F.col("pct_move") > 0, "gainers").otherwise("losers"))
    entry = entry.withColumn("liquidity", F.explode(F.when(is_liquid(rules), F.array(F.lit("all"), F.lit("liquid"))).otherwise(F.array(F.lit("all")))))
    w = Window.partitionBy(*per, "security_type", "band", "liquidity", "direction").orderBy(F.abs("pct_move").desc(), F.col("ticker"), F.col("listing_id").asc_nulls_last())
    ranked = entry.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rules.top)
    return ranked.select("date", "security_type", "band", "liquidity", "direction", "rank", "ticker", "pct_move")


def move_counters(moved: DataFrame, rules: MoveRules = MoveRules()) -> DataFrame:
    """Per day what the flags removed or marked, in one aggregation."""
    ok = F.col("passes_floor") & F.col("within_gap")
    return moved.groupBy("date").agg(
        F.count("*").alias("moves"), F.count_if(~F.col("passes_floor")).alias("floor_excluded"), F.count_if(F.col("passes_floor") & ~F.col("within_gap")).alias("gap_excluded"), F.count_if(F.col("listing_id").isNull()).alias("unattributed"),
        F.count_if(ok & F.col("action_suspect")).alias("action_suspect"), F.count_if(ok & F.col("unexplained_fall")).alias("unexplained_falls"),
        F.count_if(ok & ~F.col("action_suspect") & (F.col("avg_dollar_volume") > rules.liquid_volume) & (F.col("adv_sessions") < rules.adv_sessions)).alias("thin_history"),
    )


def move_funnel(moved: DataFrame) -> DataFrame:
    """Population of the moves, stage by stage."""
    return funnel(moved, [("moves", F.lit(True)), ("above the floor", F.col("passes_floor")), ("no long gap", F.col("within_gap")), ("explained", ~F.col("action_suspect"))])


def new_names(today: DataFrame, prior: DataFrame, *, by: Sequence[str], name: str = "ticker") -> DataFrame:
    """Names of today's lists that the prior lists did not hold."""
    return today.select(*by, name).distinct().join(prior.select(*by, name).distinct(), [*by, name], "left_anti")


def unexplained_moves(bars: DataFrame, actions: DataFrame, *, jump: float = 1.0, fall: float = -0.6, floor: float = 0.01, most_gap_days: int = 30) -> DataFrame:
    """Moves of a ticker (over all its listings) that no action explains."""
    px = bars.where(F.col("close") >= floor).select("ticker", "date", "close")
    w = Window.partitionBy("ticker").orderBy("date")
    seq = px.withColumn("prev_close", F.lag("close").over(w)).withColumn("prev_date", F.lag("date").over(w)).where(F.datediff("date", "prev_date") <= most_gap_days)
    ratio = F.col("close").cast("double") / F.col("prev_close").cast("double")
    far = seq.withColumn("move", ratio - 1).where((F.col("move") >= jump) | (F.col("move") <= fall))
    act = actions.select(F.col("ticker").alias("_t"), "ex_date", month_no("ex_date").alias("_m"))
    placed = far.withColumn("_month", F.explode(months_of(F.date_add("prev_date", 1), F.col("date"))))
    met = placed.join(act, (F.col("ticker") == F.col("_t")) & (F.col("_month") == F.col("_m")) & (F.col("ex_date") > F.col("prev_date")) & (F.col("ex_date") <= F.col("date")), "left")
    bare = met.groupBy("ticker", "date", "prev_date", "prev_close", "close", "move").agg(F.count("_t").alias("acted")).where("acted = 0")
    return bare.select("ticker", "date", "prev_date", "prev_close", "close", ratio.cast("decimal(24,6)").alias("ratio"), F.when(F.col("move") > 0, "jump").otherwise("fall").alias("direction"))


def _sessions(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.where("close > 0").select("ticker", "date", "close").withColumn("i", F.row_number().over(w))


def event_anchors(events: DataFrame, bars: DataFrame, *, most_days: int = 30) -> DataFrame:
    """``event_id, ticker, event_date, base_i, base_date, base_close``: the last session strictly before each event, at most ``most_days`` before it."""
    s = _sessions(bars).select(F.col("ticker").alias("_t"), F.col("date").alias("_d"), F.col("close").alias("_c"), "i", month_no("date").alias("_m"))
    placed = events.withColumn("_month", F.explode(months_of(F.date_sub("event_date", most_days), F.date_sub("event_date", 1))))
    met = placed.join(s, (F.col("ticker") == F.col("_t")) & (F.col("_month") == F.col("_m")) & (F.col("_d") < F.col("event_date")) & (F.col("_d") >= F.date_sub("event_date", most_days)))
    return met.groupBy("event_id", "ticker", "event_date").agg(F.max(F.struct("i", "_d", "_c")).alias("b")).select("event_id", "ticker", "event_date", F.col("b.i").alias("base_i"), F.col("b._d").alias("base_date"), F.col("b._c").alias("base_close"))


def forward_returns(events: DataFrame, bars: DataFrame, actions: DataFrame, *, horizons: Sequence[int] = (1, 5, 30), benchmark: str = "SPY", suspect: float = 3.0, most_days: int = 30, anchors: DataFrame | None = None) -> DataFrame:
    """One row per event and horizon (in sessions after the anchor) with split-adjusted return and excess over the benchmark.

    A horizon without a bar gives no row.  The benchmark's closes are not split-adjusted;
    where it lacks either day the excess is NULL.  ``anchors``: those of ``event_anchors``, if they are at hand.
    """
    if not horizons:
        raise ValueError("no horizons")
    base = (anchors if anchors is not None else event_anchors(events, bars, most_days=most_days)).withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("fwd_i", F.col("base_i") + F.col("h"))
    s = _sessions(bars).select(F.col("ticker").alias("_t"), F.col("i").alias("_i"), F.col("date").alias("fwd_date"), F.col("close").alias("fwd_close"))
    paired = base.join(s, (F.col("ticker") == F.col("_t")) & (F.col("fwd_i") == F.col("_i"))).drop("_t", "_i")
    splits = actions_between(paired.select("event_id", "h", "ticker", "base_date", "fwd_date"), actions, after="base_date", upto="fwd_date", keys=("event_id", "h")).select("event_id", "h", "split_factor")
    paired = paired.join(splits, ["event_id", "h"], "left").withColumn("split_factor", split_or_one())
    bench = bars.where((F.col("ticker") == benchmark) & (F.col("close") > 0)).groupBy("date").agg(F.max("close").alias("c"))
    b0, b1 = bench.select(F.col("date").alias("base_date"), F.col("c").alias("b0")), bench.select(F.col("date").alias("fwd_date"), F.col("c").alias("b1"))
    paired = paired.join(b0, "base_date", "left").join(b1, "fwd_date", "left")
    ret = (F.col("fwd_close").cast("double") * F.col("split_factor").cast("double") / F.col("base_close").cast("double") - 1).cast("decimal(24,6)")
    bench_ret = (F.try_divide(F.col("b1").cast("double"), F.col("b0").cast("double")) - 1).cast("decimal(24,6)")
    out = paired.withColumn("ret", ret).withColumn("bench_ret", bench_ret).withColumn("excess", (F.col("ret") - F.col("bench_ret")).cast("decimal(24,6)"))
    return out.select("event_id", "ticker", "event_date", "h", "base_date", "fwd_date", "base_close", "fwd_close", "split_factor", "ret", "bench_ret", "excess", ((F.abs("ret") > suspect) & (F.col("split_factor") == 1)).alias("suspect_unadjusted"))


def run_up(events: DataFrame, bars: DataFrame, actions: DataFrame, *, sessions: int = 5, most_days: int = 30, anchors: DataFrame | None = None) -> DataFrame:
    """``event_id, run_up``: the split-adjusted return of the sessions before the anchor."""
    base = (anchors if anchors is not None else event_anchors(events, bars, most_days=most_days)).withColumn("from_i", F.col("base_i") - sessions)
    s = _sessions(bars).select(F.col("ticker").alias("_t"), F.col("i").alias("_i"), F.col("date").alias("from_date"), F.col("close").alias("from_close"))
    pair = base.join(s, (F.col("ticker") == F.col("_t")) & (F.col("from_i") == F.col("_i")))
    splits = actions_between(pair.select("event_id", "ticker", "from_date", "base_date"), actions, after="from_date", upto="base_date", keys=("event_id",)).select("event_id", "split_factor")
    pair = pair.join(splits, "event_id", "left")
    return pair.select("event_id", (F.col("base_close").cast("double") * split_or_one().cast("double") / F.col("from_close").cast("double") - 1).cast("decimal(24,6)").alias("run_up"))


def summarise_returns(results: DataFrame, *, label: str, run_ups: DataFrame | None = None) -> DataFrame:
    """Per label and horizon the distribution of returns, without suspected unrecorded splits (which are counted)."""
    if run_ups is not None:
        results = results.join(run_ups, "event_id", "left")
    else:
        results = results.withColumn("run_up", F.lit(None).cast("decimal(24,6)"))
    good = ~F.col("suspect_unadjusted")
    pick = lambda c: F.when(good, F.col(c).cast("double"))
    total = lambda c: F.sum(F.when(good, F.col(c)))  # noqa: E731  (decimal sums, so their order is of no account)
    g = results.groupBy(F.col(label).alias("label"), "h").agg(
        F.count_if(good).alias("n"), F.count_if(~good).alias("n_suspect"), F.median(pick("ret")).alias("median_ret"), F.try_divide(total("ret").cast("double"), F.count(pick("ret"))).alias("mean_ret"), F.median(pick("excess")).alias("median_excess"),
        F.try_divide(total("excess").cast("double"), F.count(pick("excess"))).alias("mean_excess"), F.try_divide(F.count_if(good & (F.col("excess") > 0)).cast("double"), F.count_if(good)).alias("win_rate"), F.median(pick("run_up")).alias("median_run_up"),
    )
    return g.select("label", "h", "n", "n_suspect", *(F.round(c, 9).alias(c) for c in ("median_ret", "mean_ret", "median_excess", "mean_excess", "win_rate", "median_run_up")))


def event_coverage(events: DataFrame, results: DataFrame) -> DataFrame:
    """``h, events, scored``: events in all and those with a return, per horizon."""
    return results.groupBy("h").agg(F.countDistinct("event_id").alias("scored")).crossJoin(F.broadcast(events.agg(F.count("*").alias("events")))).select("h", "events", "scored")


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Weekly or monthly bars: first open, greatest high, least low, last close, summed volume, stamped with the first session."""
    rows = bars.where("open is not null and high is not null and low is not null and close is not null and volume is not null")
    g = rows.groupBy("ticker", F.to_date(F.date_trunc(unit, "date")).alias("bucket")).agg(F.min("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("sessions"))
    return g.select("ticker", "date", "open", "high", "low", "close", "volume", "sessions")


def series_gaps(bars: DataFrame, *, over_days: int = 30) -> DataFrame:
    """``ticker, gap_from, gap_to, days``: neighbouring bars further apart than ``over_days``."""
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.select("ticker", "date").withColumn("gap_from", F.lag("date").over(w)).where(F.datediff("date", "gap_from") > over_days).select("ticker", "gap_from", F.col("date").alias("gap_to"), F.datediff("date", "gap_from").alias("days"))


def merged_spans(ranges: DataFrame, *, key: str, start: str, end: str, tolerance: int = 0) -> DataFrame:
    """Ranges of a key merged where they overlap or lie at most ``tolerance`` days apart (running greatest end)."""
    r = ranges.select(key, start, end).where(F.col(start) <= F.col(end)).groupBy(key, start).agg(F.max(end).alias(end))
    w = Window.partitionBy(key).orderBy(start)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("fresh", F.when(reach.isNull() | (F.col(start) > F.date_add(reach, tolerance + 1)), 1).otherwise(0)).withColumn("grp", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "grp").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("ranges")).drop("grp")


def latest_bars(bars: DataFrame, *, sessions: int = 252) -> DataFrame:
    """The newest ``sessions`` bars of each ticker."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sessions).drop("_rn")


def ols_beta(bars: DataFrame, *, benchmark: str, least_weeks: int = 52, bounds: tuple[float, float] = (-3.0, 5.0)) -> DataFrame:
    """``ticker, n, beta``: slope of weekly returns on the benchmark's; NULL without enough weeks, variance, or a plausible value."""
    weeks = bars.where("close > 0").groupBy("ticker", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.max_by("close", "date").alias("c"))
    w = Window.partitionBy("ticker").orderBy("week")
    prior, prior_week = F.lag("c").over(w), F.lag("week").over(w)
    rets = weeks.withColumn("p", prior).withColumn("pw", prior_week).where(F.datediff("week", "pw") == 7).select("ticker", "week", (F.col("c").cast("double") / F.col("p").cast("double") - 1).cast("decimal(18,6)").cast("double").alias("r"))
    bench = rets.where(F.col("ticker") == benchmark).select("week", F.col("r").alias("b"))
    g = rets.where(F.col("ticker") != benchmark).join(bench, "week").groupBy("ticker").agg(F.count("*").alias("n"), F.covar_pop("r", "b").alias("cov"), F.var_pop("b").alias("var"))
    beta = F.try_divide(F.col("cov"), F.col("var"))
    return g.select("ticker", "n", F.round(F.when((F.col("n") >= least_weeks) & (F.col("var") > 0) & beta.between(*bounds), beta), 6).alias("beta"))


def session_coverage(bars: DataFrame, *, trailing: int = 10) -> DataFrame:
    """``date, tickers, usual, share``: names of each session against the median of the ``trailing`` sessions before it."""
    per = bars.groupBy("date").agg(F.countDistinct("ticker").alias("tickers"))
    # one row per calendar day in all: a single ordered window is bounded by the number of days
    w = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-trailing, -1)
    per = per.withColumn("usual", F.expr("percentile(tickers, 0.5)").over(w))
    return per.select("date", "tickers", "usual", F.round(F.try_divide(F.col("tickers").cast("double"), F.col("usual")), 6).alias("share"))
