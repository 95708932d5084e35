"""Watching files: events by notification or polling, filtered, debounced, and one indexing run at a time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from trawl.functions.paths import is_watched, relative_to
from trawl.operators.changes import poll_diff
from trawl.streaming.notify import notified
from trawl.streaming.quiet import quiet_runs


def file_events(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (relative_path, mtime_ns, size) of files that appear under ``root``."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    path = relative_to(F.col("path"), root)
    return stream.select(path.alias("relative_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), F.col("modificationTime").alias("ts"))


def watched(events: DataFrame, extensions: list[str], skipped: list[str]) -> DataFrame:
    return events.where(is_watched(F.col("relative_path"), extensions, skipped))


def debounced(events: DataFrame, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """Runs of events without a ``gap`` between them: first_event, last_event, n. A stream needs ``late``, its watermark."""
    rows = events.withWatermark("ts", late) if late else events
    runs = rows.groupBy(F.session_window("ts", gap).alias("run"), *keys)
    return runs.agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("n")).drop("run")


class Coalescing:
    """Calls ``reindex`` once per micro-batch with events; batches are serial, so what arrives during a run makes one more."""

    def __init__(self, reindex: Callable[[], None]) -> None:
        self.reindex, self.runs, self.events, self.last_error = reindex, 0, 0, ""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        n = batch.count()
        if not n:
            return
        self.events += n
        try:
            self.reindex()
            self.runs, self.last_error = self.runs + 1, ""
        except Exception as e:  # the stream goes on; the status shows what happened
            self.last_error = str(e)


def watch(events: DataFrame, reindex: Callable[[], None], checkpoint: str, **trigger: object) -> tuple[StreamingQuery, Coalescing]:
    sink = Coalescing(reindex)
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start(), sink


@dataclass
class Counters:
    """How a watch stands: what a status shows while a run is going on."""

    active: bool = False
    indexing: bool = False
    events: int = 0
    pending: int = 0
    runs: int = 0
    failed_runs: int = 0
    last_event: float = 0.0
    last_run: float = 0.0
    last_error: str = ""
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def change(self, **values: object) -> None:
        with self.lock:
            for k, v in values.items():
                setattr(self, k, v)

    def seen(self, n: int, now: float) -> None:
        """Events that came in and wait for a run."""
        with self.lock:
            self.events, self.pending, self.last_event = self.events + n, self.pending + n, now

    def status(self) -> dict:
        with self.lock:
            return {k: v for k, v in vars(self).items() if k != "lock"}


class Listener(StreamingQueryListener):
    """Feeds the counters of one query from Spark's own reports of its progress."""

    def __init__(self, counters: Counters) -> None:
        self.counters, self.id = counters, None

    def onQueryStarted(self, event: object) -> None:
        if self.id in (None, str(event.id)):
            self.counters.change(active=True)

    def onQueryProgress(self, event: object) -> None:
        if str(event.progress.id) == self.id and event.progress.numInputRows > 0:
            self.counters.seen(event.progress.numInputRows, time.time())

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        if str(event.id) == self.id:
            self.counters.change(active=False, **({"last_error": str(event.exception)[:500]} if event.exception else {}))


class WorkspaceWatch:
    """A folder that is indexed again whenever its files have been quiet for a while.

    Events come from stored listings, so a restart repeats and loses none; a run starts
    ``quiet_s`` after the last of them, by the clock. What comes while a run is going on makes one
    more. A run that fails is counted, its error shown, and the watch goes on.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, reindex: Callable[[], object], extensions: list[str], skipped: list[str], quiet_s: float = 2.0, every: str = "1 second") -> None:
        self.spark, self.reindex, self.counters = spark, reindex, Counters()
        events = notified(spark, root, f"{folder}/listings", skipped=skipped)
        runs = quiet_runs(events.where(is_watched(F.col("relative_path"), extensions, skipped)), quiet_s)
        self.listener = Listener(self.counters)
        spark.streams.addListener(self.listener)
        self.query = runs.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
        self.listener.id = str(self.query.id)
        self.counters.change(active=True)

    def _batch(self, runs: DataFrame, batch_id: int) -> None:
        n = runs.agg(F.sum("n").alias("n")).first()["n"]
        if not n:
            return
        self.counters.change(indexing=True)
        c = self.counters
        try:
            self.reindex()
            c.change(runs=c.runs + 1, last_error="", last_run=time.time(), pending=max(0, c.pending - n))
        except Exception as e:  # the watch goes on; the status shows what happened
            c.change(failed_runs=c.failed_runs + 1, last_error=str(e)[:500], last_run=time.time())
        finally:
            c.change(indexing=False)

    def status(self) -> dict:
        return self.counters.status()

    def stop(self) -> None:
        self.query.stop()
        self.spark.streams.removeListener(self.listener)
        self.counters.change(active=False)


class Poller:
    """Events by comparing listings; the first listing is the base line and has none. Events can be read until the next but one poll."""

    def __init__(self, listing: Callable[[], DataFrame]) -> None:
        self.listing, self.before, self.oldest = listing, None, None

    def poll(self) -> DataFrame | None:
        now = self.listing().cache()
        now.count()
        before, self.before = self.before, now
        if self.oldest is not None:
            self.oldest.unpersist()  # what the events before the last were made from
        self.oldest = before
        if before is None:
            return None
        return poll_diff(before, now)
