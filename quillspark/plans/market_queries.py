"""Queries over daily bars and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.actions import actions_between
from quillspark.plans import market as m
from quillspark.plans.adapters import relation, with_relations
from quillspark.session import checkpointed

BENCHMARK = "BMK1"


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "bars")


def _moves(spark: SparkSession, d: str) -> DataFrame:
    return m.moves(_bars(spark, d), relation(spark, d, "actions"))


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = checkpointed(_bars(spark, d).where("close > 0").select("ticker", "date", "close"))  # read three to five times below
    return relation(spark, d, "study_events"), bars, relation(spark, d, "actions")


def vol_moves(spark, d):
    """Every adjusted move with its flags."""
    return _moves(spark, d)


def vol_adv_trailing(spark, d):
    """Trailing dollar volume of each bar."""
    px = _bars(spark, d).where("close is not null and volume is not null")
    return m.trailing_dollar_volume(px).select("ticker", "listing_id", "date", "adv_sessions", "avg_dollar_volume")


def vol_topn_lists(spark, d):
    """The ranked lists of each day."""
    return m.top_moves(_moves(spark, d)).select("date", "security_type", "band", "liquidity", "direction", "rank", "ticker", "pct_move")


def vol_counters(spark, d):
    """What each day's flags removed or marked."""
    return m.move_counters(_moves(spark, d))


def vol_funnel(spark, d):
    """The population of moves, stage by stage."""
    return m.move_funnel(_moves(spark, d))


def vol_new_names(spark, d):
    """Names of each day's lists that the lists of the day before did not hold."""
    lists = checkpointed(m.top_moves(_moves(spark, d)))  # read three times below
    # one row a day in all: the ordered window is bounded by the number of days
    days = lists.select("date").distinct().withColumn("day_no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    tagged = lists.join(days, "date")
    by = ["day_no", "security_type", "band", "liquidity", "direction"]
    new = m.new_names(tagged.where("day_no > 1"), tagged.withColumn("day_no", F.col("day_no") + 1), by=by)
    return new.join(days, "day_no").select("date", *by[1:], "ticker")


def actions_range_product(spark, d):
    """Actions between neighbouring bars of a listing."""
    px = _bars(spark, d).where("close is not null and volume is not null").select("ticker", "listing_id", "date")
    spans = px.withColumn("prev_date", F.lag("date").over(Window.partitionBy("ticker", "listing_id").orderBy("date"))).where("prev_date is not null")
    return actions_between(spans, relation(spark, d, "actions"), after="prev_date", upto="date", keys=("ticker", "listing_id", "date"))


def action_audit(spark, d):
    """Moves that no action explains."""
    return m.unexplained_moves(_bars(spark, d), relation(spark, d, "actions"))


def audit_summary(spark, d):
    """Unexplained moves by year and direction."""
    return action_audit(spark, d).groupBy(F.year("date").alias("year"), "direction").agg(F.count("*").alias("moves"), F.countDistinct("ticker").alias("tickers"), F.max("ratio").alias("greatest"), F.min("ratio").alias("least"))


def outcome_anchor(spark, d):
    """The session each event is anchored on."""
    events, bars, _ = _events(spark, d)
    return m.event_anchors(events, bars)


def outcome_forward(spark, d):
    """Returns of each event and horizon."""
    return m.forward_returns(*_events(spark, d), benchmark=BENCHMARK)


def outcome_runup(spark, d):
    """Returns before each event's anchor."""
    return m.run_up(*_events(spark, d))


def outcome_summary(spark, d):
    """The distribution of returns by role and horizon."""
    events, bars, actions = _events(spark, d)
    events = checkpointed(events)
    anchors = checkpointed(m.event_anchors(events, bars))
    got = m.forward_returns(events, bars, actions, benchmark=BENCHMARK, anchors=anchors).join(events.select("event_id", "role"), "event_id")
    return m.summarise_returns(got, label="role", run_ups=m.run_up(events, bars, actions, anchors=anchors))


def outcome_coverage(spark, d):
    """How many events produced a return."""
    events, bars, actions = _events(spark, d)
    return m.event_coverage(events, m.forward_returns(events, bars, actions, benchmark=BENCHMARK))


def ohlc_weekly(spark, d):
    """Weekly bars."""
    return m.resample(_bars(spark, d), "week")


def ohlc_monthly(spark, d):
    """Monthly bars."""
    return m.resample(_bars(spark, d), "month")


def series_gaps(spark, d):
    """Long gaps in each ticker's bars."""
    return m.series_gaps(_bars(spark, d))


def listing_spans(spark, d):
    """Spans of each ticker's holdings, merged over gaps of up to thirty days."""
    from quillspark.sources.tables import table

    h = table(spark, d, "company_ticker_history")
    return m.merged_spans(h, key="ticker", start="first_seen", end="last_seen", tolerance=30)


def latest_bars(spark, d):
    """The newest year of sessions of each ticker."""
    return m.latest_bars(_bars(spark, d)).select("ticker", "date", "close", "volume")


def beta_ols(spark, d):
    """Weekly beta of each ticker against the benchmark."""
    return m.ols_beta(_bars(spark, d), benchmark=BENCHMARK)


def health_coverage_median(spark, d):
    """Names per session against the usual number."""
    return m.session_coverage(_bars(spark, d))


QUERIES = {f.__name__: f for f in (vol_moves, vol_adv_trailing, vol_topn_lists, vol_counters, vol_funnel, vol_new_names, actions_range_product, action_audit, audit_summary, outcome_anchor, outcome_forward, outcome_runup, outcome_summary, outcome_coverage, ohlc_weekly, ohlc_monthly, series_gaps, listing_spans, latest_bars, beta_ols, health_coverage_median)}

_MOVES = """
px as (select * from bars where close is not null and volume is not null),
seq as (select *, lag(close) over w as prev_close, lag(date) over w as prev_date,
  count(*) over (w rows between 29 preceding and current row) as adv_sessions,
  cast(sum(cast(close * volume as decimal(38,2))) over (w rows between 29 preceding and current row) as double) / count(*) over (w rows between 29 preceding and current row) as avg_dollar_volume
  from px window w as (partition by ticker, listing_id order by date)),
acted as (select s.ticker, s.listing_id, s.date, cast(product(cast(a.split_factor as double)) as decimal(38,12)) as split_factor, cast(sum(a.div_cash) as decimal(18,6)) as div_cash, count(*) as n_actions
  from seq s join actions a on a.ticker = s.ticker and a.ex_date > s.prev_date and a.ex_date <= s.date group by all),
j as (select s.* , coalesce(a.split_factor, 1) as split_factor, coalesce(a.div_cash, 0)::decimal(18,6) as div_cash, coalesce(a.n_actions, 0) as n_actions,
  cast(s.prev_close::double / coalesce(a.split_factor, 1)::double as decimal(18,6)) as adj
  from seq s left join acted a on a.ticker = s.ticker and a.listing_id is not distinct from s.listing_id and a.date = s.date where s.prev_close is not null),
moves as (select ticker, date, security_type, exchange, case when adj < 1 then 'sub_1' when adj < 10 then '1_to_10' else '10_plus' end as band, close, adj as adj_prev_close,
  case when adj <> 0 then cast((close - adj)::double / adj::double * 100 as decimal(24,6)) end as pct_move, cast((close - adj)::double / (case when adj < 1 then 0.0001::double else 0.01::double end) as decimal(24,6)) as tick_move,
  volume, avg_dollar_volume, adv_sessions, split_factor::decimal(38,12) as split_factor, div_cash, div_cash > 0 as is_ex_div, listing_id, cast(date - prev_date as int) as gap_days,
  adj >= 0.01 and close >= 0.01 as passes_floor, date - prev_date <= 30 as within_gap,
  n_actions = 0 and coalesce((close - adj)::double / nullif(adj::double, 0) > 1.0, false) as action_suspect, n_actions = 0 and coalesce((close - adj)::double / nullif(adj::double, 0) < -0.6, false) as unexplained_fall from j)
"""

_LISTS = (
    _MOVES
    + """,
entry as (select *, case when pct_move > 0 then 'gainers' else 'losers' end as direction, avg_dollar_volume > 5000000 and adv_sessions >= 30 as liquid from moves where passes_floor and within_gap and not action_suspect and pct_move <> 0),
both_lists as (select *, 'all' as liquidity from entry union all select *, 'liquid' as liquidity from entry where liquid),
lists as (select * from (select date, security_type, band, liquidity, direction, cast(row_number() over (partition by date, security_type, band, liquidity, direction order by abs(pct_move) desc, ticker, listing_id nulls last) as int) as rank, ticker, pct_move from both_lists) where rank <= 10)
"""
)

_RETURNS = """
sess as (select ticker, date, close, row_number() over (partition by ticker order by date) as i from bars where close > 0),
anchor as (select e.event_id, e.ticker, e.event_date, max(s.i) as base_i from study_events e join sess s on s.ticker = e.ticker and s.date < e.event_date and s.date >= e.event_date - 30 group by all),
based as (select a.*, s.date as base_date, s.close as base_close from anchor a join sess s on s.ticker = a.ticker and s.i = a.base_i),
paired as (select b.*, h.h, f.date as fwd_date, f.close as fwd_close from based b cross join (select unnest([1, 5, 30]) as h) h join sess f on f.ticker = b.ticker and f.i = b.base_i + h.h),
sp as (select p.event_id, p.h, cast(coalesce(product(a.split_factor::double), 1) as decimal(38,12)) as factor from paired p left join actions a on a.ticker = p.ticker and a.ex_date > p.base_date and a.ex_date <= p.fwd_date group by all),
bench as (select date, close from bars where ticker = 'BMK1' and close > 0),
priced as (select p.event_id, p.ticker, p.event_date, p.h, p.base_date, p.fwd_date, p.base_close, p.fwd_close, s.factor as split_factor, cast(p.fwd_close::double * s.factor::double / p.base_close::double - 1 as decimal(24,6)) as ret, cast(b1.close::double / b0.close::double - 1 as decimal(24,6)) as bench_ret
  from paired p join sp s on s.event_id = p.event_id and s.h = p.h left join bench b0 on b0.date = p.base_date left join bench b1 on b1.date = p.fwd_date),
results as (select *, cast(ret - bench_ret as decimal(24,6)) as excess, abs(ret) > 3.0 and split_factor = 1 as suspect_unadjusted from priced),
pre as (select a.event_id, a.ticker, p.date as from_date, p.close as from_close, a.base_date, a.base_close from based a join sess p on p.ticker = a.ticker and p.i = a.base_i - 5),
presp as (select p.event_id, cast(coalesce(product(a.split_factor::double), 1) as decimal(38,12)) as factor from pre p left join actions a on a.ticker = p.ticker and a.ex_date > p.from_date and a.ex_date <= p.base_date group by 1),
runups as (select p.event_id, cast(p.base_close::double * s.factor::double / p.from_close::double - 1 as decimal(24,6)) as run_up from pre p join presp s on s.event_id = p.event_id)
"""


def _moved(then: str) -> str:
    return with_relations("bars", "actions", then=_MOVES + then)


def _listed(then: str) -> str:
    return with_relations("bars", "actions", then=_LISTS + then)


def _returned(then: str) -> str:
    return with_relations("bars", "actions", "study_events", then=_RETURNS + then)


_OHLC = "select ticker, min(date) as date, min_by(open, date) as open, max(high) as high, min(low) as low, max_by(close, date) as close, cast(sum(volume) as bigint) as volume, count(*) as sessions from bars where open is not null and high is not null and low is not null and close is not null and volume is not null group by ticker, date_trunc('{unit}', date)"

ORACLE_SQL = {
    "vol_moves": _moved("select * from moves"),
    "vol_adv_trailing": _moved("select ticker, listing_id, date, adv_sessions, avg_dollar_volume from seq"),
    "vol_topn_lists": _listed("select * from lists"),
    "vol_counters": _moved("""select date, count(*) as moves, count(*) filter (where not passes_floor) as floor_excluded, count(*) filter (where passes_floor and not within_gap) as gap_excluded, count(*) filter (where listing_id is null) as unattributed,
  count(*) filter (where passes_floor and within_gap and action_suspect) as action_suspect, count(*) filter (where passes_floor and within_gap and unexplained_fall) as unexplained_falls,
  count(*) filter (where passes_floor and within_gap and not action_suspect and avg_dollar_volume > 5000000 and adv_sessions < 30) as thin_history from moves group by date"""),
    "vol_funnel": _moved(""", c as (select count(*) as a, count(*) filter (where passes_floor) as b, count(*) filter (where passes_floor and within_gap) as c, count(*) filter (where passes_floor and within_gap and not action_suspect) as d from moves)
select 0 as stage_no, 'moves' as stage, a as remaining, cast(0 as bigint) as removed, false as collapsed from c union all select 1, 'above the floor', b, a - b, b = 0 and a > 0 from c union all select 2, 'no long gap', c, b - c, c = 0 and b > 0 from c union all select 3, 'explained', d, c - d, d = 0 and c > 0 from c"""),
    "vol_new_names": _listed(""", d as (select date, row_number() over (order by date) as n from (select distinct date from lists)), t as (select lists.*, n from lists join d using (date))
select distinct date, security_type, band, liquidity, direction, ticker from t where n > 1 and not exists (select 1 from t p where p.n = t.n - 1 and p.security_type = t.security_type and p.band = t.band and p.liquidity = t.liquidity and p.direction = t.direction and p.ticker = t.ticker)"""),
    "actions_range_product": _moved("select * from acted"),
    "action_audit": with_relations("bars", "actions", then="""px as (select ticker, date, close from bars where close >= 0.01), seq as (select *, lag(close) over w as prev_close, lag(date) over w as prev_date from px window w as (partition by ticker order by date))
select ticker, date, prev_date, prev_close, close, cast(close::double / prev_close::double as decimal(24,6)) as ratio, case when close::double / prev_close::double > 1 then 'jump' else 'fall' end as direction from seq s
where date - prev_date <= 30 and (close::double / prev_close::double - 1 >= 1.0 or close::double / prev_close::double - 1 <= -0.6) and not exists (select 1 from actions a where a.ticker = s.ticker and a.ex_date > s.prev_date and a.ex_date <= s.date)"""),
    "outcome_anchor": _returned("select event_id, ticker, event_date, cast(base_i as int) as base_i, base_date, base_close from based"),
    "outcome_forward": _returned("select event_id, ticker, event_date, h, base_date, fwd_date, base_close, fwd_close, split_factor, ret, bench_ret, excess, suspect_unadjusted from results"),
    "outcome_runup": _returned("select * from runups"),
    "outcome_summary": _returned("""select role as label, h, count(*) filter (where not suspect_unadjusted) as n, count(*) filter (where suspect_unadjusted) as n_suspect, round(median(ret::double) filter (where not suspect_unadjusted), 9) as median_ret,
  round(sum(ret) filter (where not suspect_unadjusted)::double / nullif(count(ret) filter (where not suspect_unadjusted), 0), 9) as mean_ret, round(median(excess::double) filter (where not suspect_unadjusted), 9) as median_excess,
  round(sum(excess) filter (where not suspect_unadjusted)::double / nullif(count(excess) filter (where not suspect_unadjusted), 0), 9) as mean_excess,
  round(count(*) filter (where not suspect_unadjusted and excess > 0)::double / nullif(count(*) filter (where not suspect_unadjusted), 0), 9) as win_rate, round(median(run_up::double) filter (where not suspect_unadjusted), 9) as median_run_up
  from results r join study_events e using (event_id) left join runups using (event_id) group by role, h"""),
    "outcome_coverage": _returned("select h, (select count(*) from study_events) as events, count(distinct event_id) as scored from results group by h"),
    "ohlc_weekly": with_relations("bars", then=_OHLC.format(unit="week")),
    "ohlc_monthly": with_relations("bars", then=_OHLC.format(unit="month")),
    "series_gaps": with_relations("bars", then="select * from (select ticker, lag(date) over w as gap_from, date as gap_to, cast(date - lag(date) over w as int) as days from bars window w as (partition by ticker order by date)) where days > 30"),
    "listing_spans": """with r as (select ticker, first_seen as s, max(last_seen) as e from company_ticker_history where first_seen <= last_seen group by 1, 2),
o as (select *, max(e) over (partition by ticker order by s rows between unbounded preceding and 1 preceding) as reach from r),
g as (select *, sum(case when reach is null or s > reach + 31 then 1 else 0 end) over (partition by ticker order by s) as grp from o)
select ticker, min(s) as first_seen, max(e) as last_seen, count(*) as ranges from g group by ticker, grp""",
    "latest_bars": with_relations("bars", then="select ticker, date, close, volume from bars qualify row_number() over (partition by ticker order by date desc) <= 252"),
    "beta_ols": with_relations("bars", then="""weeks as (select ticker, date_trunc('week', date)::date as week, max_by(close, date) as c from bars where close > 0 group by all),
p as (select *, lag(c) over w as p, lag(week) over w as pw from weeks window w as (partition by ticker order by week)),
r as (select ticker, week, cast(c::double / p::double - 1 as decimal(18,6))::double as r from p where week - pw = 7),
g as (select r.ticker, count(*) as n, covar_pop(r.r, b.r) as cov, var_pop(b.r) as v from r join r b on b.ticker = 'BMK1' and b.week = r.week where r.ticker <> 'BMK1' group by 1)
select ticker, n, round(case when n >= 52 and v > 0 and cov / v between -3 and 5 then cov / v end, 6) as beta from g"""),
    "health_coverage_median": with_relations("bars", then="""per as (select date, count(distinct ticker) as tickers from bars group by 1), u as (select *, median(tickers) over (order by date rows between 10 preceding and 1 preceding)::double as usual from per)
select date, tickers, usual, round(tickers::double / usual, 6) as share from u"""),
}
ORACLE_SQL["audit_summary"] = f"select year(date) as year, direction, count(*) as moves, count(distinct ticker) as tickers, max(ratio) as greatest, min(ratio) as least from ({ORACLE_SQL['action_audit']}) group by 1, 2"
