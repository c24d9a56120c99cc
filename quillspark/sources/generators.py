"""Relations made from parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Inline rows as a relation."""
    return spark.createDataFrame(list(rows), schema)


def each(spark: SparkSession, items: Sequence[int], name: str = "h") -> DataFrame:
    """One row per item."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, items))).alias(name))


def synthetic_bars(spark: SparkSession, *, tickers: int, days: int, start: str = "2024-01-01") -> DataFrame:
    """Deterministic bars of ``tickers`` symbols over ``days`` days, for self-tests at any size."""
    n = spark.range(tickers * days).withColumn("t", F.col("id") % tickers).withColumn("d", F.floor(F.col("id") / tickers))
    price = ((F.col("t") * 37 % 500 + 1) * (F.lit(100) + (F.col("d") * 7 + F.col("t") * 13) % 21) / 100).cast("decimal(18,6)")
    return n.select(F.concat(F.lit("T"), F.lpad(F.col("t").cast("string"), 6, "0")).alias("ticker"), F.date_add(F.lit(start).cast("date"), F.col("d").cast("int")).alias("date"), price.alias("close"), (F.col("t") * 1000 + F.col("d")).cast("bigint").alias("volume"))
