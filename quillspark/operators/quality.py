"""Contracts on relations: columns, freshness, no fan-out, population counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(RuntimeError):
    """A relation breaks a contract."""


def assert_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``df``, or an error that names the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise QualityError(f"missing columns {missing}; there are {df.columns}")
    return df


def assert_fresh(df: DataFrame, *, day: str, today: date, most_days: int, least_rows: int = 1, required: Sequence[str] = ()) -> dict:
    """Columns, then the row floor, then the age of the newest day; a day in the future is an error.

    One aggregation; returns ``{'rows', 'newest'}``.
    """
    assert_columns(df, [day, *required])
    row = df.agg(F.count("*").alias("n"), F.max(F.col(day).cast("date")).alias("newest")).first()
    if row["n"] < least_rows:
        raise QualityError(f"{row['n']} rows; at least {least_rows} are due")
    if row["newest"] is None:
        raise QualityError(f"no {day} at all")
    if row["newest"] > today:
        raise QualityError(f"{day} {row['newest']} lies in the future")
    if (today - row["newest"]).days > most_days:
        raise QualityError(f"the newest {day} is {row['newest']}, over {most_days} days ago")
    return {"rows": row["n"], "newest": row["newest"]}


def assert_closed_year(df: DataFrame, *, day: str, year: int, first_by: tuple[int, int] = (1, 8), last_from: tuple[int, int] = (12, 29)) -> dict:
    """A closed year's partition spans it: starts by 8 January, ends on 29 December or later, holds no other year."""
    row = df.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b")).first()
    a, b = row["a"], row["b"]
    if a is None or a.year != year or b.year != year:
        raise QualityError(f"days {a} to {b} are not those of {year}")
    if a > date(year, *first_by) or b < date(year, *last_from):
        raise QualityError(f"{year} is covered from {a} to {b} only")
    return {"first": a, "last": b}


def assert_no_fanout(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, or an error if a left join changed the number of rows."""
    n, m = before.count(), after.count()
    if n != m:
        raise QualityError(f"{n} rows became {m}")
    return after


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """``stage_no, stage, remaining, removed, collapsed`` of a cascade of conditions, in one pass.

    A row remains at a stage if it meets its condition and all earlier ones (NULL
    does not meet one).  ``collapsed`` marks a stage that removed everything.
    """
    held, counts = F.lit(True), []
    for no, (_, condition) in enumerate(stages):
        held = held & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(held).alias(f"c{no}"))
    row = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(no).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"c{no}").alias("remaining"), (F.col(f"c{no - 1}") - F.col(f"c{no}") if no else F.lit(0).cast("long")).alias("removed"), ((F.col(f"c{no}") == 0) & (F.col(f"c{no - 1}") > 0) if no else F.lit(False)).alias("collapsed")) for no, (name, _) in enumerate(stages)])
    return row.select(F.inline(rows))
