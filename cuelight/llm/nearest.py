"""Nearest neighbours by a block matrix join of int8 product tiles."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored
from .vectors import by_length, products, valid_vectors

#: Queries of a bucket, about; most queries and most candidates of a tile.
QUERIES, TILE, CANDIDATES = 8192, 1024, 4096
_BLOCK = "dim int, bucket int, ids binary, vectors binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, exponent, scale, length, and the length of the rounding error of each row, all but the codes after the row was brought
    into reach of double precision by a power of two, its exponent."""
    exponent = np.frexp(np.abs(x).max(axis=1))[1].astype(np.int64)
    x = np.ldexp(x.astype(np.float64), -exponent[:, None])
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, exponent, scale, np.sqrt((x * x).sum(axis=1)), np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


class Block:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        codes, self.exponent, self.scale, self.norm, self.error = quantise(vectors)
        # sums of int8 products are whole numbers, exact in float32 up to 2**24
        self.codes = codes.astype(np.float32 if codes.shape[1] * 127 ** 2 < 1 << 24 else np.float64)


class Best:
    """The best ``k`` candidates so far of each query of a block, nearest first, ties to the smaller id. A product that is no
    number, as both its sums of one sign are infinite, comes last."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        n = len(queries.ids)
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)  # of the k held, once there are so many

    def add(self, block: Block) -> None:
        """One tile. With ``q = q' + e`` and ``x = x' + f`` after quantisation, the true product is within
        ``|q'| |f| + |e| |x|`` of that of the codes; only pairs that can still be among the best are computed again."""
        q, k = self.queries, self.k
        near = (q.codes @ block.codes.T).astype(np.float64) * q.scale[:, None] * block.scale
        slack = (q.norm + q.error)[:, None] * block.error + q.error[:, None] * block.norm
        slack = slack * (1 + 1e-9) + 1e-12 * q.norm[:, None] * block.norm  # and the rounding of sums
        power = q.exponent[:, None] + block.exponent
        with np.errstate(over="ignore"):
            low, high = np.nextafter(np.ldexp(near - slack, power), -np.inf), np.nextafter(np.ldexp(near + slack, power), np.inf)
        own = q.ids[:, None] == block.ids
        low[own] = -np.inf
        bar = self.least
        if near.shape[1] > k:
            bar = np.maximum(bar, np.partition(low, -k, axis=1)[:, -k])
        row, col = np.nonzero((high >= bar[:, None]) & ~own)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = [products(q.vectors[row[i:i + 65536]], block.vectors[col[i:i + 65536]]) for i in range(0, len(row), 65536)]
        row = np.concatenate([self.row, row])
        ids = np.concatenate([self.id, block.ids[col]])
        score = np.concatenate([self.score, *scores])
        order = np.lexsort((ids, ranked(-score), row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.row, self.id, self.score = row[keep], ids[keep], score[keep]
        last = place == k - 1
        self.least[row[last]] = -ranked(-score[last])


def ranked(falling: np.ndarray) -> np.ndarray:
    """Negative scores with what is no number as infinite."""
    return np.where(np.isnan(falling), np.inf, falling)


def _blocks(size: int, kind: type):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column(2).to_numpy(zero_copy_only=False)
            rows = []
            for at, ids, matrix in by_length(batch.column(0), batch.column(1)):
                for b in np.unique(bucket[at]):
                    own = np.flatnonzero(bucket[at] == b)
                    for i in range(0, len(own), size):
                        part = own[i:i + size]
                        rows.append((matrix.shape[1], int(b), ids[part].tobytes(), matrix[part].astype(kind).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["dim", "bucket", "ids", "vectors"])

    return build


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: for each query its ``k`` candidates of largest inner product, in double
    precision on the given vectors, nearest first and ties to the smaller id; all candidates if they are fewer.

    Candidates are all vectors but the query's own id. The result is exact. Vectors that are null, empty or zero, or
    hold null or non-finite components, and rows without an id take no part; an id that occurs more than once has its
    least vector; vectors of another length than the query's are no candidates of it. Other columns are not read. An
    empty table, or no query, gives an empty one.

    Queries are dealt into buckets of about ``QUERIES``, candidates into blocks and the blocks into groups. A task takes
    a bucket and a group, holds the bucket and its best so far, and streams the group's blocks past them; what groups
    found is merged by heaps, ``k`` rows a query and group. Copies of one vector are spread over blocks like any others.
    """
    spark = rows.sparkSession
    vectors = stored(valid_vectors(rows, id_column, vector_column), "vectors")
    kind = {"float": np.float32}.get(vectors.schema["embedding"].dataType.elementType.simpleString(), np.float64)
    queries = vectors.filter(is_query if id_column == "vec_id" else F.col("vec_id").isNotNull() & is_query)
    buckets = max(1, -(-queries.count() // QUERIES))
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64))
    asked = (queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(buckets)).cast("int").alias("bucket"))
             .mapInArrow(_blocks(QUERIES, kind), _BLOCK)
             .select("*", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")))
    blocks = stored(vectors.select("vec_id", "embedding", F.lit(0).alias("bucket")).mapInArrow(_blocks(CANDIDATES, kind), _BLOCK), "blocks")
    offered = blocks.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "ids", "vectors", F.lit(1).alias("side"),
        F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"))
    keys = ["dim", "bucket", "group"]
    tiles = asked.unionByName(offered).repartition(*keys).sortWithinPartitions(*keys, "side")

    def block(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, dtype=np.int64)
        return ids, np.frombuffer(vectors, dtype=kind).reshape(len(ids), -1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, best = None, [], None  # best: of each tile of the bucket

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([b.queries.ids[b.row] for b in best])), pa.array(np.concatenate([b.id for b in best])),
                 pa.array(np.concatenate([b.score for b in best]))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("dim", "bucket", "group", "side", "ids", "vectors")}
                key = (row["dim"], row["bucket"], row["group"])
                if key != now:
                    if best is not None:
                        yield found()
                    now, waiting, best = key, [], None
                part = block(row["ids"], row["vectors"])
                if row["side"] == 0:
                    waiting.append(part)
                elif waiting or best is not None:
                    if best is None:
                        ids, vectors = (np.concatenate(x) for x in zip(*waiting, strict=True))
                        best = [Best(Block(ids[i:i + TILE], vectors[i:i + TILE]), k) for i in range(0, len(ids), TILE)]
                        waiting = []
                    candidates = Block(*part)
                    for b in best:
                        b.add(candidates)
        if best is not None:
            yield found()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        least = heapq.nsmallest(k, zip(ranked(-frame["score"].to_numpy()), frame["vec_id"], frame["score"], strict=True))
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "rank": np.arange(1, len(least) + 1, dtype=np.int32),
                             "vec_id": [i for _, i, _ in least], "score": [s for _, _, s in least]})

    partial = tiles.mapInArrow(multiply, "query_id long, vec_id long, score double")
    return partial.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
