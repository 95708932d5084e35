"""Runs of events that end when nothing came for a while, by the clock of the machine: no watermark, no late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What timers and their state need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RUN = "first_event timestamp, last_event timestamp, n long"


class _Quiet(StatefulProcessor):
    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", f"{RUN}, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N803
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        first, last, n, _ = self.run.get() if self.run.exists() else (None, None, 0, 0)
        for batch in rows:
            times = batch["ts"]
            first = times.min() if first is None else min(first, times.min())
            last = times.max() if last is None else max(last, times.max())
            n += len(batch)
        self.run.update((first, last, n, due))
        self.handle.registerTimer(due)  # earlier ones find that the run goes on
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        if not self.run.exists():
            return
        first, last, n, due = self.run.get()
        if expiredTimerInfo.getExpiryTimeInMs() < due and timerValues.getCurrentProcessingTimeInMs() < due:
            return
        self.run.clear()
        yield pd.DataFrame({"key": [key[0]], "first_event": [first], "last_event": [last], "n": [n]})

    def close(self) -> None:
        pass


def quiet_runs(events: DataFrame, gap_s: float = 2.0, key: str | None = None) -> DataFrame:
    """(key, first_event, last_event, n) of each run of a stream's events (ts), as soon as none came for ``gap_s`` seconds.

    A run may go on for as long as events come. Without a key all events are one run.
    """
    events.sparkSession.conf.set(*PROVIDER)
    rows = events.select((F.lit("") if key is None else F.col(key).cast("string")).alias("key"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(_Quiet(int(gap_s * 1000)), outputStructType=f"key string, {RUN}", outputMode="Append", timeMode="ProcessingTime")
