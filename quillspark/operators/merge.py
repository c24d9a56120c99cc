"""Keyed merges of stored and newly staged rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.quality import QualityError, assert_columns


def merge_latest(stored: DataFrame, staged: DataFrame, *, keys: Sequence[str], newest: Sequence[str], drop: Column | None = None) -> DataFrame:
    """Stored and staged rows, one per key: the greatest by ``newest`` and then by all other columns; rows that meet ``drop`` go first.

    Columns go by name; a staged column that the store lacks, or the other way round, is an error.
    NULL is less than any value.  The fold has a map-side part, so a key delivered very often does not gather its copies in one task.
    """
    if sorted(stored.columns) != sorted(staged.columns):
        raise QualityError(f"columns differ: {sorted(set(stored.columns) ^ set(staged.columns))}")
    rows = stored.unionByName(staged)
    if drop is not None:
        rows = rows.where(~F.coalesce(drop, F.lit(False)))
    rest = [c for c in rows.columns if c not in keys]
    order = [*newest, *(c for c in rest if c not in newest)]
    folded = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_row"))
    return folded.select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in stored.columns))


def insert_missing(stored: DataFrame, staged: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """The staged rows whose key is not stored (insert, do nothing on conflict)."""
    return staged.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def missing_after_write(stored: DataFrame, staged: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Keys that were staged and are still not stored; empty after a good write."""
    return staged.select(*keys).distinct().join(stored.select(*keys).distinct(), list(keys), "left_anti")


def upsert(stored: DataFrame, staged: DataFrame, *, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """One row per key: staged values over stored ones.

    A NULL staged value leaves the stored one; columns in ``keep_old`` are set
    on insert only.  Both sides must have each key once.
    """
    keys, rest = list(keys), [c for c in stored.columns if c not in keys]
    assert_columns(staged, [*keys, *rest])
    old, new = stored.select(*keys, F.struct(*rest).alias("_old")), staged.select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, keys, "full_outer")
    value = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in keep_old else F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}"))
    return both.select(*keys, *(value(c).alias(c) for c in rest))


def widen(stored: DataFrame, staged: DataFrame, *, keys: Sequence[str], low: str, high: str, total: str, label: str) -> DataFrame:
    """One row per key: least ``low``, greatest ``high``, summed ``total``, and all labels joined in order."""
    rows = stored.select(*keys, low, high, total, label).unionByName(staged.select(*keys, low, high, total, label))
    return rows.groupBy(*keys).agg(F.min(low).alias(low), F.max(high).alias(high), F.sum(total).alias(total), F.array_join(F.array_sort(F.collect_set(label)), " and ").alias(label))


def assert_no_shrink(old_rows: int, new_rows: int, *, restate: bool = False) -> None:
    """A merged partition may not hold fewer rows than before, unless it is restated."""
    if new_rows < old_rows and not restate:
        raise QualityError(f"the partition would shrink from {old_rows} to {new_rows} rows")


def publish_partition(spark, merged: DataFrame, path: str, *, restate: bool = False) -> int:
    """Write a merged partition beside the old one, check it, and swap it in; returns its rows.

    Uses the file system of ``path`` (any that Hadoop knows), so it works on shared storage.  The old
    partition is renamed before the new one takes its place, and deleted last; a run that dies in
    between leaves it beside the target (``recover_partition``, called first here).
    """
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + "._staged")
    fs = target.getFileSystem(hadoop)
    recover_partition(spark, path)
    old = spark.read.parquet(path).count() if fs.exists(target) else 0
    merged.write.mode("overwrite").option("compression", "zstd").parquet(path + "._staged")
    new = spark.read.parquet(path + "._staged").count()
    try:
        assert_no_shrink(old, new, restate=restate)
    except QualityError:
        fs.delete(temp, True)
        raise
    aside = jvm.org.apache.hadoop.fs.Path(path + "._replaced")
    fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(temp, target):
        if fs.exists(aside):
            fs.rename(aside, target)
        raise OSError(f"cannot move the new rows to {path}")
    fs.delete(aside, True)
    return new


def recover_partition(spark, path: str) -> None:
    """Put back what a ``publish_partition`` that died between its two renames had set aside."""
    jvm = spark.sparkContext._jvm
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + "._replaced")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(aside) and not fs.rename(aside, target):
        raise OSError(f"cannot put {path} back")


def write_years(df: DataFrame, path: str, *, day: str = "date") -> None:
    """Write by year folder, replacing only the years that ``df`` holds."""
    df.withColumn("year", F.year(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(path)


def write_ordered(df: DataFrame, path: str, *, order: Sequence[str], types: dict[str, str] | None = None) -> None:
    """Write in one order over all files (by ranges, so every task sorts its own), with columns cast to ``types`` first; NULLs first.

    A value that does not fit its type is an error, not a NULL.
    """
    assert_columns(df, [*order, *(types or {})])
    typed = df.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()})
    typed.sort(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)
