"""Size checks that choose between two plans for the same result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Rows of one key that a single task may sort and stream through.
MAX_GROUP_ROWS = 2_000_000
# Rows of a dimension that may be broadcast.
MAX_BROADCAST_ROWS = 200_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest key; reads the key columns only and combines counts
    before the shuffle."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    return largest_group(df, keys) > (MAX_GROUP_ROWS if limit is None else limit)


def shuffled(df: DataFrame) -> DataFrame:
    """Keep ``df`` out of broadcasts. The optimizer takes rows that a generator or a Python task makes to be as few as those
    they are made from, and would send them all through the driver."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when it holds at most ``limit`` rows;
    otherwise leave the join strategy to the optimizer (shuffled, skew-split)."""
    bound = MAX_BROADCAST_ROWS if limit is None else limit
    if df.limit(bound + 1).count() <= bound:
        return F.broadcast(df)
    return df
