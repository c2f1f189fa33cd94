"""Interval joins on (key, time bucket).

Each side is put into the buckets it touches, the join is an equi-join on
(key, bucket), and a pair is kept only in the bucket where the later of the two
starts lies, so no pair appears twice and no plan needs a cartesian product. Both
inputs are read once, when the join runs; a bucket that is hot then is split by
adaptive execution, part by part of either side. Where that is switched off, or
rows are too small for its limits in bytes, ``max_bucket_rows`` counts the buckets
first and cuts the hot ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from .groups import MAX_BROADCAST_ROWS, shuffled


def bucket_of(position: Column, width: float) -> Column:
    return F.floor(position / F.lit(float(width))).cast("bigint")


def bucketed(df: DataFrame, start: Column, end: Column, width: float, name: str = "_bucket") -> DataFrame:
    """One row per bucket that [start, end] touches."""
    lo, hi = bucket_of(start, width), bucket_of(end, width)
    return df.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi))))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
    closed: bool = False,
    max_bucket_rows: int | None = None,
) -> DataFrame:
    """Pairs of equal keys whose spans overlap.

    Spans are half-open by default (touching ends do not overlap); ``closed``
    counts touching ends. Only the key columns may share names.
    """
    keys = list(keys)
    (ls, le), (rs, re_) = left_span, right_span
    lb = bucketed(left, F.col(ls), F.col(le), width)
    rb = bucketed(right, F.col(rs), F.col(re_), width)
    on = [*keys, "_bucket"]
    if max_bucket_rows is not None:
        lb, rb, on = _salted(lb, rb, on, max_bucket_rows)
    if closed:
        touch = (F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le))
    else:
        touch = (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    home = bucket_of(F.greatest(F.col(ls), F.col(rs)), width)
    pairs = lb.join(shuffled(rb), on).filter(touch & (F.col("_bucket") == home))
    return pairs.drop("_bucket", "_salt_l", "_salt_r")


def _salted(lb: DataFrame, rb: DataFrame, on: list[str], limit: int):
    """Cut buckets that hold more than ``limit`` rows of a side into parts of that side; every part meets every part of
    the other side once. Both sides are counted in one pass over their keys."""
    one = lambda df, left: df.select(*on, F.lit(int(left)).alias("_l"), F.lit(int(not left)).alias("_r"))
    parts = lambda c: F.ceil(F.sum(c) / limit).cast("int")
    hot = (
        one(lb, True).unionByName(one(rb, False)).groupBy(*on)
        .agg(F.greatest(parts("_l"), F.lit(1)).alias("_l"), F.greatest(parts("_r"), F.lit(1)).alias("_r"))
        .filter("_l > 1 or _r > 1")
    )
    n_hot = hot.limit(MAX_BROADCAST_ROWS + 1).count()
    if n_hot == 0:
        return lb, rb, on
    hot = F.broadcast(hot) if n_hot <= MAX_BROADCAST_ROWS else hot

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        flat = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
        mine = F.pmod(F.xxhash64(*flat), F.coalesce(F.col(own), F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        joined = df.join(hot, on, "left").withColumn("_salt" + own, mine)
        return joined.withColumn("_salt" + other, copies).drop(own, other)

    return spread(lb, "_l", "_r"), spread(rb, "_r", "_l"), [*on, "_salt_l", "_salt_r"]
