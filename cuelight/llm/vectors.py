"""Vectors that take part, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part: with an id, and neither null, empty nor all zero, nor with
    null or non-finite components. An id that occurs more than once has its least vector."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.filter(F.col(id_column).isNotNull() & v.isNotNull()).filter(~bad & F.exists(v, lambda x: x != 0))
            .groupBy(F.col(id_column).alias("vec_id")).agg(F.min(v).alias("embedding")))


def by_length(ids: pa.Array, vectors: pa.Array):
    """``(rows, ids, matrix)`` for each length of vector in a batch."""
    lengths = np.diff(vectors.offsets.to_numpy())
    start = vectors.offsets.to_numpy()[:-1] - vectors.offsets.to_numpy()[0]
    flat, ids = vectors.flatten().to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, ids[at].astype(np.int64), flat[start[at][:, None] + np.arange(n)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, added in the order of the components, so that equal vectors give
    equal products wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    out = a[:, 0] * b[:, 0]
    for k in range(1, a.shape[1]):
        out += a[:, k] * b[:, k]
    return out
