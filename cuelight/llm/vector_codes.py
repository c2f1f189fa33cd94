"""Vector code compression: integer product quantisation with distances by Walsh-Hadamard transforms.

Vectors become integers, are cut into parts, and every part is coded by the nearest entry of its own codebook. All
numbers are integers, so codes, errors and codebooks are the same on every machine and in every order of rows.

For a part ``x`` and an entry ``c``, both padded with zeros to a power of two ``p``, the transform ``H`` without scaling
gives ``|Hx - Hc|^2 = p |x - c|^2``. Its squared differences are added in the order of sequency (few sign changes first):
smooth parts have most of their difference there, and an entry whose sum so far is beyond the whole sum of a promising entry is
out. Sums are compared as integers, so nothing is lost and ties are seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored, with_totals

#: Rows compared at a time; bits of the limbs that sums are sent in; integers of a transform that sums of squares in 64
#: bits hold, by its width.
ROWS, LIMB, SAFE = 4096, 32, 1 << 30


def kept_vectors(vector_column: str) -> Column:
    """Whether a vector takes part: it is not null and holds no null, NaN or infinite component."""
    v = F.col(vector_column)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def sequency(width: int) -> np.ndarray:
    """The Hadamard matrix of ``width`` (a power of two), its rows by the number of sign changes."""
    matrix = np.ones((1, 1), dtype=np.int64)
    while len(matrix) < width:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((np.diff(matrix, axis=1) != 0).sum(axis=1), kind="stable")]


def to_integers(matrix: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale x)`` of finite numbers: as 64-bit integers where all of them are small, else as Python integers."""
    wide = matrix.astype(np.float64)
    if wide.size == 0 or np.abs(wide).max() < 2.0 ** 50 / scale:
        return np.floor(wide * scale).astype(np.int64)
    return np.array([floor(Fraction(float(x)) * scale) for x in wide.ravel()], dtype=object).reshape(wide.shape)


def nearest_entries(x: np.ndarray, entries: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, squared distance)`` of the nearest of ``entries`` to each row of ``x``, ties to the lower index.

    Both hold integers; ``matrix`` is the transform in sequency order, as wide as the padded parts.
    """
    width = len(matrix)
    most = max([abs(int(v)) for m in (x, entries) if m.size for v in (m.max(), m.min())], default=0)
    kind = np.int64 if most * width < SAFE else object

    def transform(m: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(m), width), dtype=kind)
        padded[:, :m.shape[1]] = m
        return padded.dot(matrix.T.astype(kind))

    own, other = transform(x), transform(entries)
    first = (own[:, :1] - other[None, :, 0]) ** 2
    promising = first.argmin(axis=1)
    bound = ((own - other[promising]) ** 2).sum(axis=1)
    row, entry = np.nonzero((first <= bound[:, None]).astype(bool))
    total = first[row, entry]
    for k in range(1, width):
        total = total + (own[row, k] - other[entry, k]) ** 2
        alive = (total <= bound[row]).astype(bool)
        row, entry, total = row[alive], entry[alive], total[alive]
    begins = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(total, begins)
    best = np.flatnonzero((total == least[row]).astype(bool))
    best = best[np.unique(row[best], return_index=True)[1]]  # entries of a row ascend: the first is the lowest
    return entry[best], least // width


class Codebooks:
    """The entries of every part as a ``(parts, entries, width)`` array of integers."""

    def __init__(self, entries: np.ndarray, scale: int):
        self.entries, self.scale = entries, scale
        self.parts, self.size, self.width = entries.shape

    def integers(self, vectors: pa.Array) -> np.ndarray:
        """A batch of vectors as ``(rows, parts, width)`` integers; those that are shorter end in zeros."""
        offsets = vectors.offsets.to_numpy().astype(np.int64)
        flat = vectors.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), self.parts * self.width), dtype=np.float64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row, place] = flat[offsets[0]:offsets[-1]]
        return to_integers(out, self.scale).reshape(-1, self.parts, self.width)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(codes, squared distances)``, both ``(rows, parts)``."""
        matrix = sequency(1 << max(0, self.width - 1).bit_length())
        found = [nearest_entries(x[:, p], self.entries[p], matrix) for p in range(self.parts)]
        return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: every entry in use is the mean, rounded down, of its parts. Tasks add up their own
    rows, and the sums of tasks are added in limbs, so they are exact however large."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((books.parts, books.size, books.width + 1), dtype=object)
        for batch in _slices(batches):
            x = books.integers(batch.column(0))
            codes, _ = books.assign(x)
            own = np.zeros(sums.shape, dtype=x.dtype)
            for p in range(books.parts):
                np.add.at(own[p, :, :-1], codes[:, p], x[:, p])
                np.add.at(own[p, :, -1], codes[:, p], 1)
            sums += own
        place, limb, value = [], [], []
        for i in np.flatnonzero(sums.ravel() != 0):
            left, n = int(sums.flat[i]), 0
            while True:
                small = -(1 << LIMB - 1) <= left < 1 << LIMB - 1
                place.append(i), limb.append(n), value.append(left if small else left & (1 << LIMB) - 1)
                if small:
                    break
                left, n = left >> LIMB, n + 1
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())],
                                         names=["place", "limb", "value"])

    parts = vectors.select("embedding").mapInArrow(add, "place long, limb int, value long")
    sums = np.zeros((books.parts, books.size, books.width + 1), dtype=object)
    for r in parts.groupBy("place", "limb").agg(F.sum("value").alias("value")).collect():  # as many as the codebooks have numbers
        sums.flat[r["place"]] += r["value"] << LIMB * r["limb"]
    moved = books.entries.astype(object)
    used = sums[:, :, -1] != 0
    moved[used] = sums[used][:, :-1] // sums[used][:, -1:]
    small = moved.size == 0 or max(abs(v) for v in moved.flat) < SAFE
    return Codebooks(moved.astype(np.int64) if small else moved, books.scale)


def fit_codebooks(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of ``vectors(vec_id, embedding)``: they begin as the parts of the ``size`` smallest ids (null ids last,
    ties by the vector) and move ``rounds`` times. None if there are no vectors."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return None
    each = max(1, -(-width // parts))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(size).collect()
    shape = Codebooks(np.zeros((parts, 1, each), dtype=np.int64), scale)
    kind = pa.list_(pa.float64())
    books = Codebooks(shape.integers(pa.array([r[0] for r in first], kind)).transpose(1, 0, 2), scale)
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Rows ``(vec_id, code, error, label)`` of ``vectors(vec_id, embedding, label)``; an error beyond a long is null."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes, distances = books.assign(books.integers(batch.column(1)))
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            error = [e if e < 1 << 63 else None for e in map(int, distances.astype(object).sum(axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(error, pa.int64()), batch.column(2)],
                                             names=["vec_id", "code", "error", "label"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec_id", "embedding", "label").mapInArrow(
        code, f"vec_id {kinds['vec_id']}, code string, error long, label {kinds['label']}")


def decode(codes: DataFrame, books: Codebooks, code_column: str = "code") -> DataFrame:
    """``codes`` with a further column ``approximate``: the entries that a code names, in the scale of the vectors. A null
    code gives null."""
    parts = []
    for i, entries in enumerate((books.entries.astype(np.float64) / books.scale).tolist()):
        table = F.array(*[F.array(*map(F.lit, e)) for e in entries])
        parts.append(F.element_at(table, F.conv(F.substring(code_column, 2 * i + 1, 2), 16, 10).cast("int") + 1))
    return codes.withColumn("approximate", F.when(F.col(code_column).isNotNull(), F.concat(*parts)))


def compress(rows: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256, id_column: str = "vec_id",
             vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Rows ``(vec_id, code, error, label, label_error, codebooks_sha256)``, one per row of ``rows`` whose vector takes part.

    A vector that is null or holds null or non-finite components is left out; a zero vector takes part. Vectors that are
    shorter than the longest, or whose length is no multiple of ``parts``, count as ending in zeros. Repeated rows stay
    and count as often as they occur; a null id is kept, and comes last where the first ids are asked for. Equal distances
    go to the lower index. ``code`` has two hexadecimal digits a part (so ``size`` is at most 256). An error beyond a long
    is null, as is the sum of a label that has such a row or is itself beyond a long. Null labels are one label. Other
    columns are not read. An empty table gives an empty one.
    """
    if not 1 <= size <= 256:
        raise ValueError("a code has two hexadecimal digits")
    vectors = rows.filter(kept_vectors(vector_column)).select(
        F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"), F.col(label_column).alias("label"))
    books = fit_codebooks(vectors, parts, size, rounds, scale)
    if books is None:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label",
                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    total = F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_cast(sum(cast(error as decimal(38, 0))) as long)"))
    coded = with_totals(stored(encode(vectors, books), "codes"), "label", {"label_error": total})
    return coded.withColumn("codebooks_sha256", F.lit(books.digest()))
