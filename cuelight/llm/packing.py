"""Packing documents into fixed-width sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .chunks import rank_encoder
from .tables import stored


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences, each made of pieces of these lengths (longest first)."""

    lengths: tuple[int, ...]
    count: int


def pack_histogram(histogram: Mapping[int, int], width: int) -> list[Pattern]:
    """Patterns that hold every piece of ``histogram`` (length to number) exactly once.

    Lengths are placed longest first. A length goes to the emptiest packs first: all packs of one pattern take one
    piece each, a pattern with more packs than pieces is split, and new packs are opened when no pack has room. The
    work depends on the number of distinct lengths, not on the number of documents.
    """
    if any(not 0 < n <= width for n in histogram):
        raise ValueError(f"lengths must be from 1 to {width}")
    open_packs: list[tuple[int, int, tuple[int, ...], int]] = []  # used, tie-break, lengths, count
    done: list[Pattern] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and open_packs[0][0] + length <= width:
                used, _, lengths, count = heapq.heappop(open_packs)
            else:
                each = width // length
                used, lengths, count = 0, (), max(1, left // each)
            if count > left:
                serial += 1
                heapq.heappush(open_packs, (used, serial, lengths, count - left))
                count = left
            # emptiest-first puts pieces of one length side by side only while a pack stays the emptiest
            left -= count
            used, lengths = used + length, (*lengths, length)
            if used == width:
                done.append(Pattern(lengths, count))
            else:
                serial += 1
                heapq.heappush(open_packs, (used, serial, lengths, count))
    return done + [Pattern(lengths, count) for _, _, lengths, count in open_packs]


def slots(patterns: list[Pattern], width: int) -> pd.DataFrame:
    """Where the pieces of each length go: ranks ``rank`` to ``rank + count - 1`` of ``length`` take sequences
    ``sequence`` onwards at ``offset``. Bounded by the number of patterns, whatever the number of documents."""
    rows, taken, sequence = [], defaultdict(int), 0
    for p in patterns:
        offset = 0
        for length in p.lengths:
            rows.append((length, taken[length], p.count, sequence, offset))
            taken[length] += p.count
            offset += length
        sequence += p.count
    found = pd.DataFrame(rows, columns=["length", "rank", "count", "sequence", "offset"], dtype="int64")
    return found.sort_values(["length", "rank"], ignore_index=True)


PIECES = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, part int, pos long")


def cut_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, width: int,
                  id_column: str, text_column: str) -> DataFrame:
    """One row per piece: a document's ids (with ``end_id`` after them) cut at every ``width`` ids, so that only its
    last piece is shorter. ``part`` and ``pos`` rank pieces of one length: the task, and the number within it."""
    with open(vocabulary, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = rank_encoder(shipped.value, pattern)
        part, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            row, start, length, crc, total, pos = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                own = np.append(encode([text.as_py() or ""])[0], end_id).astype("<u4")
                for a in range(0, len(own), width):
                    piece = own[a:a + width]
                    row.append(i)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(len(own))
                    pos.append(ranks[len(piece)])
                    ranks[len(piece)] += 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row, pa.int64())),
                *[pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                pa.array([part] * len(row), pa.int32()), pa.array(pos, pa.int64()),
            ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "pos"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(pieces, PIECES.format(id=source.schema["doc_id"].dataType.simpleString()))


def pack(pieces: DataFrame, width: int) -> DataFrame:
    """Give every piece of ``cut_documents`` a sequence and an offset in it.

    Only the histogram (at most ``width`` rows) reaches the driver. A piece's rank among those of its length is its
    rank in its task plus the number in earlier tasks, so no length is ever gathered or sorted in one task.
    """
    counts = pieces.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = slots(pack_histogram(histogram, width), width)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    stride = max([1, *histogram.values()]) + 1
    key, rank, sequence, offset = (plan["length"] * stride + plan["rank"]).to_numpy(), *(
        plan[c].to_numpy() for c in ("rank", "sequence", "offset"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ranks = (f.pop("base") + f.pop("pos")).to_numpy()
            at = np.searchsorted(key, f["length"].to_numpy() * stride + ranks, side="right") - 1
            yield f.drop(columns="part").assign(sequence_id=sequence[at] + ranks - rank[at], offset=offset[at])

    out = [f for f in pieces.schema.fields if f.name not in ("part", "pos")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"
    return pieces.join(bases, ["part", "length"]).mapInPandas(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, width: int = 2048,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``width`` ids; one row per piece, with its place.

    A null or empty text is a document of one id, ``end_id``. Rows that repeat an id are packed like any other. A null
    id stays null. Other columns of ``docs`` are not read, so their names don't matter. An empty table has no pieces.
    ``vocabulary`` is a byte-level tokenizers file of a few MB, sent to the tasks, and ``pattern`` splits text before
    its merges; the ids are those the tokenizers library gives, added tokens included.
    """
    pieces = cut_documents(docs, vocabulary, pattern, end_id, width, id_column, text_column)
    return pack(stored(pieces, "pieces"), width)
