"""Order-dependent recurrences per key, streamed through sorted partitions.

A fold sees the rows of a key in order and keeps a small state (the last kept
event, the last cut). It never holds a whole key: rows arrive in Arrow batches
and leave as soon as they are decided.

The plain plan hashes by key, so one key is one sequential stream. When a key is
too big for that, rows are range-partitioned by (key, order); all partitions run
at once from the state their left neighbour ended with in the previous round,
and only partitions whose incoming state changed run again. The states settle
after a few rounds because a fold forgets its past at the first event it keeps
unchanged; the result is exact in every case.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .groups import has_hot_group
from .session import checkpointed

_CHUNK = "_chunk"


class Fold(Protocol):
    def start(self, row: tuple) -> Any:
        """State before the first row of a key, which is given."""

    def step(self, state: Any, row: tuple) -> tuple[Any, list[tuple]]:
        """Next state and the output rows now decided."""

    def finish(self, state: Any) -> list[tuple]:
        """Output rows left over at the end of a key."""


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    fold: Fold,
    schema: StructType,
    *,
    max_group_rows: int | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Run ``fold`` over ``values`` of every key, in ``order`` (a total order).

    The result has the key columns followed by ``schema``. ``hot`` as in
    ``ordered_scan``.
    """
    keys, order, values = list(keys), list(order), list(values)
    needed = list(dict.fromkeys([*keys, *order, *values]))
    rows = df.select(*needed)
    out = StructType([df.schema[k] for k in keys] + list(schema.fields))
    runner = _Runner(keys, values, fold, [f.name for f in out.fields])
    if hot is None:
        hot = has_hot_group(rows, keys, max_group_rows)
    if not hot:
        sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
        return sorted_rows.mapInPandas(runner.emit, out)

    chunks = checkpointed(
        rows.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(_CHUNK, F.spark_partition_id())
    )
    runner = _settle(chunks, runner)
    return chunks.mapInPandas(runner.emit, out)


def _settle(chunks: DataFrame, runner: "_Runner") -> "_Runner":
    """Find the state every partition starts from. The driver handles one small
    row per partition, never the data."""
    ends: dict[int, tuple] = {}
    todo: list[int] | None = None
    incoming: dict[int, tuple] = {}
    while True:
        part = chunks if todo is None else chunks.filter(F.col(_CHUNK).isin(todo))
        found = part.mapInPandas(
            runner.with_carry(incoming, frozenset()).summarize, "chunk int, ends binary"
        )
        for row in found.toLocalIterator():
            ends[row["chunk"]] = pickle.loads(row["ends"])
        ids = sorted(ends)
        after: dict[int, tuple] = {}
        continues = set()
        for left, right in zip(ids, ids[1:]):
            last_key, state = ends[left][1], ends[left][2]
            if last_key == ends[right][0]:
                after[right] = (last_key, state)
                continues.add(left)
        todo = [c for c in ids if after.get(c) != incoming.get(c)]
        incoming = after
        if not todo:
            return runner.with_carry(incoming, frozenset(continues))


class _Runner:
    def __init__(self, keys, values, fold, names, carry=None, continues=frozenset()):
        self.keys, self.values, self.fold, self.names = keys, values, fold, names
        self.carry, self.continues = carry or {}, continues

    def with_carry(self, carry, continues) -> "_Runner":
        return _Runner(self.keys, self.values, self.fold, self.names, carry, continues)

    def _walk(self, batches: Iterator[pd.DataFrame], ends: list | None):
        """Yield output rows batch by batch; record (first key, last key, state)."""
        fold, width = self.fold, len(self.keys)
        key, state, first, chunk = None, None, None, None
        for pdf in batches:
            out: list[tuple] = []
            if chunk is None and len(pdf):
                chunk = int(pdf[_CHUNK].iloc[0]) if _CHUNK in pdf.columns else -1
            for row in _rows(pdf, [*self.keys, *self.values]):
                new_key, row = row[:width], row[width:]
                if new_key != key:
                    if key is not None:
                        out.extend((*key, *o) for o in fold.finish(state))
                    known = self.carry.get(chunk) if first is None else None
                    if known is not None and known[0] == new_key:
                        state = pickle.loads(pickle.dumps(known[1]))
                    else:
                        state = fold.start(row)
                    key = new_key
                    first = key if first is None else first
                state, done = fold.step(state, row)
                out.extend((*key, *o) for o in done)
            yield out
        if key is None:
            return
        if ends is not None:
            ends.append((chunk, first, key, state))
        elif chunk not in self.continues:
            yield [(*key, *o) for o in fold.finish(state)]

    def emit(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in self._walk(batches, None):
            if out:
                yield pd.DataFrame(out, columns=self.names)

    def summarize(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: list[tuple] = []
        for _ in self._walk(batches, ends):
            pass
        for chunk, first, last, state in ends:
            yield pd.DataFrame({"chunk": [chunk], "ends": [pickle.dumps((first, last, state))]})


def _rows(pdf: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """Rows as plain tuples; missing values as None."""
    data = []
    for c in columns:
        series = pdf[c]
        values = series.tolist()
        if series.isna().any():
            values = [None if v is None or v != v else v for v in values]
        data.append(values)
    return zip(*data)
