"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cik_key(col: Column | str) -> Column:
    """A CIK as ten digits: digits only, leading zeros normalised; NULL without a non-zero digit."""
    digits = F.regexp_replace(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"\D", ""), r"^0+", "")
    return F.when(F.length(digits).between(1, 10), F.lpad(digits, 10, "0"))


def ratio6(a: Column, b: Column) -> Column:
    """a / b computed in double and rounded to DECIMAL(18,6); NULL when b is zero or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double")).cast("decimal(18,6)")


def max_by_nn(x: Column, key: Column) -> Column:
    """The x of the greatest key among rows whose x is not NULL."""
    return F.max_by(x, F.when(x.isNotNull(), key))


def min_by_nn(x: Column, key: Column) -> Column:
    """The x of the least key among rows whose x is not NULL."""
    return F.min_by(x, F.when(x.isNotNull(), key))


def price_band(price: Column) -> Column:
    """Band of a price: under 1, 1 to under 10, 10 and over."""
    return F.when(price < 1, "sub_1").when(price < 10, "1_to_10").otherwise("10_plus")


def tick_size(price: Column) -> Column:
    """Quote tick: a hundredth of a cent below one dollar, else a cent."""
    return F.when(price < 1, F.lit(0.0001)).otherwise(F.lit(0.01))


def iso(col: Column | str) -> Column:
    """A date as 'YYYY-MM-DD'."""
    return F.date_format(col, "yyyy-MM-dd")


def market_date(ts: Column | str) -> Column:
    """The US market's calendar date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))
