"""Entity attributes as they were known at each event's time."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of both sides that one bucket should hold.
ROWS_PER_BUCKET = 200_000

# Per entity, the days on which some version starts or ends cut time into
# segments; each segment's current state is the open version that started
# last.  ASOF JOIN then finds the segment of each event.
_SQL = """
with bounds as (
  select distinct k, d from (select k, s as d from versions union all select k, e + 1 as d from versions)
), ranked as (
  select b.k, b.d as available, v.value,
         row_number() over (partition by b.k, b.d order by v.s desc nulls last) as rn
  from bounds b left join versions v on v.k = b.k and v.s <= b.d and b.d <= v.e
), states as (
  select k, available, value from ranked where rn = 1 order by k, available
)
select t.k, t.d, s.value
from events t asof left join states s on t.k = s.k and t.d >= s.available
"""


def _join_bucket(left: pa.Table, right: pa.Table) -> pa.Table:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
    try:
        con.register("events", left.select(["k", "d"]))
        con.register("versions", right.select(["k", "s", "e", "value"]))
        got = con.sql(_SQL).to_arrow_table()
    finally:
        con.close()
    return got.cast(pa.schema([("k", pa.string()), ("d", pa.int32()), ("value", pa.string())]))


def attribute_at(events: DataFrame, versions: DataFrame, *, event_key: str, event_day: str, key: str, first: str, last: str, value: str, buckets: int | None = None) -> DataFrame:
    """For each distinct (entity, day) of ``events`` the attribute valid on that day.

    Result: ``event_key, event_day, value``; the value is NULL where no
    version covers the day.  A version covers the days first..last; of several
    the one that started last holds, then the one that ends last, then the
    greatest value.  A version that starts after the event is never used.

    Both sides are collapsed before they meet: events to distinct (entity,
    day), versions to one per (entity, first day), the longest, so no entity
    carries more rows than there are days, however often it was delivered.  Entities are hashed into buckets of about
    ``ROWS_PER_BUCKET`` rows and each bucket pair goes through DuckDB's ASOF
    LEFT JOIN in an Arrow cogroup; join the result back on (entity, day).

    Events with a NULL entity or day and versions with a NULL entity, bound or
    value, or first > last, take no part; empty tables give empty results.
    """
    epoch = F.lit("1970-01-01").cast("date")
    ev = events.select(F.col(event_key).cast("string").alias("k"), F.datediff(F.col(event_day).cast("date"), epoch).alias("d")).where("k is not null and d is not null").distinct()
    ver = versions.select(F.col(key).cast("string").alias("k"), F.datediff(F.col(first).cast("date"), epoch).alias("s"), F.datediff(F.col(last).cast("date"), epoch).alias("e"), F.col(value).cast("string").alias("value"))
    ver = ver.where("k is not null and value is not null and s <= e").groupBy("k", "s").agg(F.max(F.struct("e", "value")).alias("x")).select("k", "s", "x.e", "x.value")
    if buckets is None:
        buckets = max(1, events.sparkSession.sparkContext.defaultParallelism, math.ceil((events.count() + versions.count()) / ROWS_PER_BUCKET))
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")
    left, right = ev.withColumn("b", bucket).groupBy("b"), ver.withColumn("b", bucket).groupBy("b")
    got = left.cogroup(right).applyInArrow(_join_bucket, "k string, d int, value string")
    return got.select(F.col("k").alias(event_key), F.date_add(epoch, F.col("d")).alias(event_day), F.col("value").alias(value))
