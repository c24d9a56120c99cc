"""Structured Streaming shapes of the polling loaders: late data, duplicates, keyed merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.merge import insert_missing


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, *, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def first_deliveries(stream: DataFrame, *, at: str, keys: Sequence[str], lateness: str = "5 days") -> DataFrame:
    """The stream without repeats of a key that come within the lateness (the overlapping re-read of a poll)."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, *, at: str, by: Sequence[str], width: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """``window_start, by, events, total``: events per window; late ones count until the watermark passes."""
    g = stream.withWatermark(at, lateness).groupBy(F.window(at, width), *by).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), *by, "events", "total")


def append_missing(folder: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends only the keys which the folder lacks, so a replayed batch changes nothing."""

    def write(batch: DataFrame, _id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = insert_missing(spark.read.schema(batch.schema).parquet(folder), fresh, keys=keys)
        fresh.write.mode("append").parquet(folder)

    return write


def run_available(stream: DataFrame, writer: Callable[[DataFrame, int], None], *, checkpoint: str) -> None:
    """Run what is there to its end, with its progress in ``checkpoint``."""
    stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
