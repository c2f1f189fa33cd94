"""Computing wide row-local values once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns``, evaluated once per row.

    The optimizer merges projections and may repeat an array expression for every
    step of a lambda that refers to it. A one-element generator keeps the values
    apart without a shuffle.
    """
    once = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], once)
