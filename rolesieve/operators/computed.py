"""Costly columns that are computed once, whatever is filtered on later."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add ``columns`` through a generator that yields exactly one row per row.

    A filter on an ordinary computed column is pushed below the projection with the whole expression copied
    into it, once per use, so parsing a page or scoring a text would run several times per row. A filter on
    a generated column stays above the generator; filters on other columns still reach the scan.
    """
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(values)))
