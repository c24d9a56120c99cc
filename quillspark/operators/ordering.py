"""Orders that callers choose by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_by(df: DataFrame, name: str, allowed: Mapping[str, Sequence[tuple[str, bool]]]) -> DataFrame:
    """``df`` in one of the allowed orders, each a list of (column, descending); NULLs go last, an unknown name is an error."""
    if name not in allowed:
        raise ValueError(f"no order {name!r}; there are {sorted(allowed)}")
    keys: list[Column] = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in allowed[name]]
    return df.orderBy(*keys)
