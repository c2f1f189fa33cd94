"""Ordered per-key scans: running totals, neighbours, forward and backward fill.

The plain plan is one window per key. When a key holds more rows than one task
should sort, the rows are range-partitioned by (key, order) instead, every
partition is scanned on its own, and one summary row per (key, partition)
carries the state across partitions. Both plans return the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .groups import has_hot_group
from .session import checkpointed

_CHUNK = "_chunk"


@dataclass(frozen=True)
class Scan:
    """One output column of an ordered scan."""

    name: str
    kind: str
    value: Column | None = None
    inclusive: bool = False


def number(name: str) -> Scan:
    """1-based position within the key."""
    return Scan(name, "number")


def running(name: str, how: str, value: Column, inclusive: bool = False) -> Scan:
    """``sum``, ``max`` or ``min`` of all earlier rows (and this one, when inclusive)."""
    if how not in ("sum", "max", "min"):
        raise ValueError(f"unsupported running aggregate: {how}")
    return Scan(name, how, value, inclusive)


def previous(name: str, value: Column) -> Scan:
    return Scan(name, "previous", value)


def following(name: str, value: Column) -> Scan:
    return Scan(name, "following", value)


def last_known(name: str, value: Column, inclusive: bool = False) -> Scan:
    """Latest earlier non-null value."""
    return Scan(name, "last_known", value, inclusive)


def next_known(name: str, value: Column, inclusive: bool = False) -> Scan:
    """Earliest later non-null value."""
    return Scan(name, "next_known", value, inclusive)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    *,
    max_group_rows: int | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Add one column per scan. ``order`` must be a total order within a key.

    ``hot`` tells whether a key may be too big for one task, where the caller
    knows it already; otherwise the rows per key are counted.
    """
    keys, order = list(keys), list(order)
    if hot is None:
        hot = has_hot_group(df, keys, max_group_rows)
    if hot:
        return _split_scan(df, keys, order, scans)
    return df.select("*", *[_local(s, keys, order).alias(s.name) for s in scans])


def _local(scan: Scan, keys: list[str], order: list[str]) -> Column:
    ahead = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    stop = 0 if scan.inclusive else -1
    frame = (Window.unboundedPreceding, stop)
    if scan.kind == "number":
        return F.row_number().over(ahead)
    if scan.kind in ("sum", "max", "min"):
        return getattr(F, scan.kind)(scan.value).over(ahead.rowsBetween(*frame))
    if scan.kind == "previous":
        return F.lag(scan.value).over(ahead)
    if scan.kind == "following":
        return F.lead(scan.value).over(ahead)
    if scan.kind == "last_known":
        return F.last(scan.value, ignorenulls=True).over(ahead.rowsBetween(*frame))
    if scan.kind == "next_known":
        return F.last(scan.value, ignorenulls=True).over(back.rowsBetween(*frame))
    raise ValueError(f"unknown scan: {scan.kind}")


def _summary(scan: Scan, order: list[str]) -> Column:
    at = F.struct(*order)
    if scan.kind == "number":
        return F.count(F.lit(1))
    if scan.kind in ("sum", "max", "min"):
        return getattr(F, scan.kind)(scan.value)
    if scan.kind == "previous":
        return F.max_by(scan.value, at)
    if scan.kind == "following":
        return F.min_by(scan.value, at)
    known = F.when(scan.value.isNotNull(), at)
    return F.max_by(scan.value, known) if scan.kind == "last_known" else F.min_by(scan.value, known)


def _carry(scan: Scan, keys: list[str]) -> Column:
    ahead = Window.partitionBy(*keys).orderBy(_CHUNK)
    back = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).desc())
    before = (Window.unboundedPreceding, -1)
    part = F.col(scan.name)
    if scan.kind in ("number", "sum"):
        return F.sum(part).over(ahead.rowsBetween(*before))
    if scan.kind in ("max", "min"):
        return getattr(F, scan.kind)(part).over(ahead.rowsBetween(*before))
    if scan.kind == "previous":
        return F.lag(part).over(ahead)
    if scan.kind == "following":
        return F.lead(part).over(ahead)
    if scan.kind == "last_known":
        return F.last(part, ignorenulls=True).over(ahead.rowsBetween(*before))
    return F.last(part, ignorenulls=True).over(back.rowsBetween(*before))


def _joined(scan: Scan, local: Column, carry: Column, first: Column, last: Column) -> Column:
    if scan.kind == "number":
        return (local + F.coalesce(carry, F.lit(0))).cast("int")
    if scan.kind == "sum":
        return F.coalesce(local + carry, local, carry)
    if scan.kind == "max":
        return F.greatest(local, carry)
    if scan.kind == "min":
        return F.least(local, carry)
    if scan.kind == "previous":
        return F.when(first, carry).otherwise(local)
    if scan.kind == "following":
        return F.when(last, carry).otherwise(local)
    return F.coalesce(local, carry)


def _split_scan(df: DataFrame, keys: list[str], order: list[str], scans: Sequence[Scan]) -> DataFrame:
    chunks = checkpointed(
        df.repartitionByRange(*keys, *order).withColumn(_CHUNK, F.spark_partition_id())
    )
    parts = chunks.groupBy(*keys, _CHUNK).agg(*[_summary(s, order).alias(s.name) for s in scans])
    # A partition border is crossed by at most one key, so the keys that span
    # several partitions leave at most two summary rows per partition.
    carries = (
        parts.select(
            *keys,
            _CHUNK,
            *[_carry(s, keys).alias(f"_c_{s.name}") for s in scans],
            F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_spans"),
        )
        .filter("_spans > 1")
        .drop("_spans")
    )
    local_keys = [*keys, _CHUNK]
    ahead = Window.partitionBy(*local_keys).orderBy(*order)
    scanned = chunks.select(
        "*",
        *[_local(s, local_keys, order).alias(f"_l_{s.name}") for s in scans],
        F.lag(F.lit(1)).over(ahead).isNull().alias("_first"),
        F.lead(F.lit(1)).over(ahead).isNull().alias("_last"),
    )
    joined = scanned.join(F.broadcast(carries), local_keys, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            _joined(
                s, F.col(f"_l_{s.name}"), F.col(f"_c_{s.name}"), F.col("_first"), F.col("_last")
            ).alias(s.name)
            for s in scans
        ],
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts_new: Column,
    name: str,
    **kwargs,
) -> DataFrame:
    """Number the runs of rows within a key; a run starts where ``starts_new`` holds."""
    flag = F.when(starts_new, 1).otherwise(0)
    return ordered_scan(df, keys, order, [running(name, "sum", flag, inclusive=True)], **kwargs)
