"""Continuous periods and gaps of per-entity intervals (sweep line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def periods_and_gaps(df: DataFrame, *, key: str, start: str, end: str) -> DataFrame:
    """Merge the inclusive day ranges of each key and list the gaps between them.

    Every range becomes +1 on its first day and -1 on the day after its last.
    The deltas are summed per (key, day) before anything is sorted, so a key
    never carries more rows than it has distinct boundary days, however many
    ranges it has; the running sum of these is the number of open ranges.  A
    period starts where it leaves zero and ends where it returns to zero.

    Result: ``key, kind ('period'|'gap'), start_date DATE, end_date DATE``,
    bounds inclusive.  Ranges that overlap, nest, touch, or follow on the next
    day are one period.  Rows with a NULL key, a NULL bound, or start > end
    carry no range and are ignored; repeated rows change nothing; an empty
    table gives an empty result.  Other columns of ``df`` are not looked at.
    """
    ranges = df.select(F.col(key).alias("k"), F.col(start).cast("date").alias("s"), F.col(end).cast("date").alias("e"))
    ranges = ranges.where(F.col("k").isNotNull() & (F.col("s") <= F.col("e")))
    events = ranges.select("k", F.explode(F.array(F.struct(F.col("s").alias("day"), F.lit(1).cast("long").alias("delta")), F.struct(F.date_add("e", 1).alias("day"), F.lit(-1).cast("long").alias("delta")))).alias("ev"))
    deltas = events.select("k", "ev.day", "ev.delta").groupBy("k", "day").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    by_day = Window.partitionBy("k").orderBy("day")
    open_after = F.sum("delta").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    edges = deltas.withColumn("open_after", open_after).withColumn("open_before", F.col("open_after") - F.col("delta")).where("open_after = 0 or open_before = 0")
    spans = edges.withColumn("next_edge", F.lead("day").over(by_day))
    return spans.where("next_edge is not null").select(
        F.col("k").alias(key),
        F.when(F.col("open_after") > 0, "period").otherwise("gap").alias("kind"),
        F.col("day").alias("start_date"),
        F.date_sub("next_edge", 1).alias("end_date"),
    )
