"""Delimited text files: all columns as text first, types after."""

from __future__ import annotations

import difflib
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.quality import QualityError


def read_text_table(spark: SparkSession, paths: str | Sequence[str], *, sep: str = "\t", required: Sequence[str] = (), skip_bad: bool = False) -> DataFrame:
    """Files with a header, every column a string; with ``skip_bad`` rows that do not parse are left out.

    A missing required column is an error that names the nearest present one.
    """
    reader = spark.read.option("columnPruning", not skip_bad)  # a row is bad by its whole line, whatever columns are read
    df = reader.csv(list(paths) if not isinstance(paths, str) else paths, sep=sep, header=True, inferSchema=False, mode="DROPMALFORMED" if skip_bad else "PERMISSIVE", quote="" if sep == "\t" else '"', multiLine=False)
    check_header(df.columns, required)
    return df


def check_header(columns: Sequence[str], required: Sequence[str]) -> None:
    """An error for each required column that is not there, with the nearest name that is."""
    missing = [c for c in required if c not in columns]
    if missing:
        hints = {c: difflib.get_close_matches(c, columns, 1) for c in missing}
        raise QualityError("; ".join(f"no column {c}" + (f", but {h[0]}" if h else "") for c, h in hints.items()))


def extract_members(archive: str, target: str, names: Sequence[str]) -> dict[str, str]:
    """Unpack members of a zip on the driver (Spark cannot split one) into a folder that the executors can read."""
    Path(target).mkdir(parents=True, exist_ok=True)
    out = {}
    with zipfile.ZipFile(archive) as z:
        have = {Path(n).name.lower(): n for n in z.namelist()}
        for name in names:
            if name.lower() not in have:
                raise QualityError(f"{archive} has no {name}")
            out[name] = str(Path(target, name))
            with z.open(have[name.lower()]) as src, open(out[name], "wb") as dst:
                while chunk := src.read(1 << 20):
                    dst.write(chunk)
    return out
