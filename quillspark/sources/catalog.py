"""A catalog of datasets: which partition of which dataset lies where."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Backends that may be published.
PUBLIC = ("local", "release")


class CatalogError(KeyError):
    """The catalog lacks a dataset or partition, or may not serve it."""


@dataclass(frozen=True)
class DatasetRef:
    """One partition of a dataset."""

    dataset: str
    partition: str
    location: str
    backend: str = "local"


@dataclass
class Catalog:
    """Datasets by (name, partition)."""

    refs: dict[tuple[str, str], DatasetRef] = field(default_factory=dict)

    @classmethod
    def from_toml(cls, text: str) -> Catalog:
        """``[[dataset]]`` tables with name, partition, location and, if not local, backend."""
        out = cls()
        for row in tomllib.loads(text).get("dataset", []):
            out.add(DatasetRef(row["name"], str(row["partition"]), row["location"], row.get("backend", "local")))
        return out

    def add(self, ref: DatasetRef) -> None:
        self.refs[ref.dataset, ref.partition] = ref

    def get(self, dataset: str, partition: str) -> DatasetRef:
        """The reference; an unknown one is an error, never None."""
        try:
            return self.refs[dataset, partition]
        except KeyError:
            have = sorted(p for d, p in self.refs if d == dataset)
            raise CatalogError(f"{dataset}/{partition} is not in the catalog; partitions of it: {have}") from None

    def partitions(self, dataset: str) -> list[str]:
        found = sorted(p for d, p in self.refs if d == dataset)
        if not found:
            raise CatalogError(f"no partition of {dataset}")
        return found

    def read(self, spark: SparkSession, dataset: str, partitions: Sequence[str] | None = None, *, schema: StructType | None = None) -> DataFrame:
        """The named partitions (all without names) in one relation, columns by name."""
        refs = [self.get(dataset, p) for p in (partitions if partitions is not None else self.partitions(dataset))]
        if bad := [r for r in refs if r.backend not in PUBLIC]:
            raise CatalogError(f"{bad[0].dataset} lies in {bad[0].backend}, which is not read as files")
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [reader.parquet(r.location) for r in refs])

    def read_recent_years(self, spark: SparkSession, dataset: str, year: int) -> DataFrame:
        """This and the year before: the first session of a year needs the last close of the one before it."""
        wanted = [p for p in self.partitions(dataset) if p in (str(year), str(year - 1))]
        if not wanted:
            raise CatalogError(f"{dataset} has neither {year} nor {year - 1}")
        return self.read(spark, dataset, wanted)

    def verify(self, spark: SparkSession) -> list[tuple[str, str, str]]:
        """(dataset, partition, 'ok' | 'missing' | 'skipped') of every location, by its file system."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for (d, p), ref in sorted(self.refs.items()):
            if ref.backend not in PUBLIC:
                out.append((d, p, "skipped"))
                continue
            path = jvm.org.apache.hadoop.fs.Path(ref.location)
            out.append((d, p, "ok" if path.getFileSystem(conf).exists(path) else "missing"))
        return out


def with_listing(bars: DataFrame) -> DataFrame:
    """``bars`` with a NULL ``listing_id`` where an old partition has none."""
    return bars if "listing_id" in bars.columns else bars.withColumn("listing_id", F.lit(None).cast("date"))


def may_publish(ref: DatasetRef, rows: int) -> DatasetRef:
    """``ref``, or an error if its backend is private or nothing would be published."""
    if ref.backend not in PUBLIC:
        raise CatalogError(f"{ref.dataset} lies in {ref.backend} and may not be published")
    if rows <= 0:
        raise CatalogError(f"{ref.dataset}/{ref.partition} is empty")
    return ref
