"""Relations of a database, by query push-down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_query(spark: SparkSession, url: str, query: str, *, driver: str | None = None, fetch_rows: int = 10_000, split: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """What ``query`` returns; the database runs it, Spark fetches in batches.

    ``split`` (column, low, high, parts) reads over as many connections, each a range of a number, day or time
    column; the bounds only place the cuts, no row is lost outside them.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_rows)
    if split is None:
        reader = reader.option("query", query)
    else:
        column, low, high, parts = split
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", parts)
    if driver:
        reader = reader.option("driver", driver)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
