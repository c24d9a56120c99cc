"""Records of two tables paired by nearest time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_day(left: DataFrame, right: DataFrame, *, left_key: str, left_day: str, right_key: str, right_day: str, tolerance: int, out: str = "nearest_day") -> DataFrame:
    """``left_key, left_day, out``: for each distinct (entity, day) of ``left`` the nearest day of ``right``.

    Both tables are collapsed to distinct (entity, day) and put in one
    sequence per entity and day; the last and the next right-hand day are
    carried onto each left-hand row and the nearer one within ``tolerance``
    days is kept, the earlier of two equally near.  After the collapse an entity
    has at most one row a day on each side, however many records it has; join the
    result back on (entity, day).  Rows with a NULL entity or day take no part;
    left rows without a day in tolerance give no row; an empty table gives an
    empty result; other columns are not looked at.
    """
    side = lambda df, k, d, right_side: df.select(F.col(k).cast("string").alias("k"), F.col(d).cast("date").alias("d"), F.lit(right_side).alias("r")).where("k is not null and d is not null").distinct()
    events = side(left, left_key, left_day, 0)
    both = events.unionByName(side(right, right_key, right_day, 1))
    # one row per (entity, day): whether each side has it
    days = both.groupBy("k", "d").agg(F.max("r").alias("has_right"), F.min("r").alias("only_right"))
    own = F.when(F.col("has_right") == 1, F.col("d"))
    by_day = Window.partitionBy("k").orderBy("d")
    carried = days.withColumn("last_right", F.last(own, ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_right", F.first(own, ignorenulls=True).over(by_day.rowsBetween(0, Window.unboundedFollowing)))
    back, ahead = F.datediff("d", "last_right"), F.datediff("next_right", "d")
    pick = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("last_right")).otherwise(F.col("next_right"))
    near = carried.where("only_right = 0").select("k", "d", pick.alias("near")).where(F.abs(F.datediff("d", "near")) <= tolerance)
    return near.select(F.col("k").alias(left_key), F.col("d").alias(left_day), F.col("near").alias(out))
