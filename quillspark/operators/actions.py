"""Corporate actions between two days of a price series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_no(day: Column | str) -> Column:
    """The month of a day, counted from year 0."""
    return F.year(day) * 12 + F.month(day)


def months_of(first: Column, last: Column) -> Column:
    """All months of first..last; none if last comes before first."""
    return F.when(first <= last, F.sequence(month_no(first), month_no(last)))


def actions_between(spans: DataFrame, actions: DataFrame, *, after: str, upto: str, key: str = "ticker", keys: tuple[str, ...]) -> DataFrame:
    """Product of splits, sum of dividends and number of actions with after < ex_date <= upto.

    Result: ``keys, split_factor, div_cash, n_actions`` for the spans that have
    an action at all; join it back with a left join and ``no_action`` defaults.
    Spans meet actions by (key, month), a span once in each month that it covers, so a span
    meets the few actions of its own months only and not all of its key's.
    """
    act = actions.select(F.col(key).alias("_k"), F.col("ex_date").alias("_ex"), F.coalesce("split_factor", F.lit(1)).cast("double").alias("_f"), F.coalesce("div_cash", F.lit(0)).cast("decimal(18,6)").alias("_d"), month_no("ex_date").alias("_m")).where("_k is not null and _ex is not null")
    placed = spans.withColumn("_month", F.explode(months_of(F.date_add(after, 1), F.col(upto))))
    met = placed.join(act, (F.col(key) == F.col("_k")) & (F.col("_month") == F.col("_m")) & (F.col("_ex") > F.col(after)) & (F.col("_ex") <= F.col(upto)))
    return met.groupBy(*keys).agg(F.product("_f").cast("decimal(38,12)").alias("split_factor"), F.sum("_d").cast("decimal(18,6)").alias("div_cash"), F.count("*").alias("n_actions"))


def split_or_one(c: str = "split_factor") -> Column:
    """The split factor, one where there was no action."""
    return F.coalesce(F.col(c), F.lit(1).cast("decimal(38,12)"))
