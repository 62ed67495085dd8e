"""Row-level helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns whose definitions later filters will not repeat.

    A filter on a plain computed column is pushed below it with the definition
    written out again, which for long text expressions multiplies the work. A one-row
    ``inline`` keeps the row count and stops that.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
