"""Situations of events as a stream: runs that a pause or a change of mark ends, with what is still open given out at the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "source_id bigint, start timestamp, end timestamp, merged bigint, base_interest int, mark string"
_EVENT = "start bigint, end bigint, event_id bigint, base_interest int, mark string"
_RUN = "start bigint, end bigint, merged bigint, base_interest int, mark string, reach bigint"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def walk(run: tuple | None, events: list[tuple], gap: int) -> tuple[tuple | None, list[tuple]]:
    """The open run after events in order, and the runs that they ended. A run ends where an event begins more than ``gap`` after all
    before it have ended, or has another mark. The last field of a run is the latest end of its source so far."""
    ended = []
    for start, end, _, interest, mark in events:
        if run is not None and start <= run[5] + gap and mark == run[4]:
            run = (run[0], max(run[1], end), run[2] + 1, max(run[3], interest), mark, max(run[5], end))
        else:
            if run is not None:
                ended.append(run)
            run = (start, end, 1, interest, mark, end if run is None else max(run[5], end))
    return run, ended


def frame(key: int, runs: list[tuple]) -> pd.DataFrame:
    rows = [(key, pd.Timestamp(s, unit="us"), pd.Timestamp(e, unit="us"), n, i, m) for s, e, n, i, m, _ in runs]
    return pd.DataFrame(rows, columns=["source_id", "start", "end", "merged", "base_interest", "mark"])


class _Islands(StatefulProcessor):
    """Events wait until the watermark has passed their start, so they join the open run in the order of time however they
    arrived. A run is given out once it is ended by an event, or by the watermark."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.open = handle.getValueState("open", _RUN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in rows:
            fresh += list(zip(pdf["start"].astype("datetime64[us]").astype("int64").tolist(), pdf["end"].astype("datetime64[us]").astype("int64").tolist(),
                              pdf["event_id"].tolist(), pdf["base_interest"].tolist(), pdf["mark"].tolist()))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(e[0] for e in fresh) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        due, later = [e for e in held if e[0] < passed], [e for e in held if e[0] >= passed]
        run = tuple(self.open.get()) if self.open.exists() else None
        run, ended = walk(run, due, self.gap)
        if run is not None and run[5] + self.gap < passed:
            ended.append(run)
            run = None
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if run is None:
            self.open.clear()
        else:
            self.open.update(run)
        again = [later[0][0]] if later else []
        if run is not None:
            again.append(run[5] + self.gap)
        for at in (a // 1000 + 1 for a in again):
            self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([frame(key[0], ended)] if ended else [])

    def close(self) -> None:
        pass


def island_stream(events: DataFrame, gap_seconds: float, late: str = "2 minutes") -> DataFrame:
    """Runs of events per source: ``source_id, start, end, merged, base_interest, mark``, as ``merge_events`` makes them of a table,
    whatever the order of arrival. ``events``: ``source_id, event_id, start, end, base_interest, mark``, with timestamps.

    Events that begin more than ``late`` before the latest one are dropped. Runs that are still open, or wait for the watermark, when
    a query stops are in its state: ``open_islands`` gives them out. The state of a source holds its open run and the events of the
    last ``late``.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    timed = events.select("source_id", "event_id", "start", "end", "base_interest", "mark").withWatermark("start", late)
    return timed.groupBy("source_id").transformWithStateInPandas(
        _Islands(int(gap_seconds * 1_000_000)), OUT, outputMode="Append", timeMode="EventTime")


def open_islands(spark: SparkSession, checkpoint: str, gap_seconds: float) -> DataFrame:
    """The runs that a stopped ``island_stream`` left open in its state, as it would have given them out, had the time gone on."""
    gap = int(gap_seconds * 1_000_000)

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    began = state("open").select("key.*", F.lit(True).alias("run"), F.struct("value.*").alias("r"))
    held = state("waiting").select("key.*", F.lit(False).alias("run"), F.struct(
        "list_element.start", "list_element.end", F.col("list_element.event_id").alias("merged"), "list_element.base_interest",
        "list_element.mark", F.lit(None).cast("bigint").alias("reach")).alias("r"))
    rows = began.unionByName(held).select("source_id", "run", "r.*")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["start", "end", "merged", "base_interest", "mark"]
        run = next(pdf[pdf["run"]][[*columns, "reach"]].itertuples(index=False, name=None), None)
        events = sorted(pdf[~pdf["run"]][columns].itertuples(index=False, name=None))
        run, ended = walk(run, events, gap)
        return frame(pdf["source_id"].iloc[0], [*ended, *([run] if run is not None else [])])

    return rows.groupBy("source_id").applyInPandas(finish, OUT)
