"""A stream source of file events: what was created, modified or removed between two listings of a folder.

Each listing that differs from the one before is stored, and its number is the offset, so a
batch is the difference of two stored listings: it can be read again after a crash, by any
executor, and gives the same events. Stored listings go when Spark says that a batch is done.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from trawl.sources.walk import file_system, walk

NAME = "trawl_notify"
EVENT = "relative_path string, event string, mtime_ns long, size long, ts timestamp"
LISTING = pa.schema([("relative_path", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64())])


def listing(root: str, skipped: frozenset[str] = frozenset(), extensions: tuple[str, ...] = ()) -> tuple[pa.Table, list[str]]:
    """The files below ``root``, by path, and what could not be read; skipped folders are not gone into."""
    found = sorted(walk(root, [""], skipped, extensions), key=lambda r: r[0])
    rows = [r[:3] for r in found if r[3] is None]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), LISTING.types, strict=True)], schema=LISTING), [r[0] for r in found if r[3] is not None]


def changes(before: pa.Table, now: pa.Table) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(path, event, mtime_ns, size) of what differs; what was removed has neither."""
    old = dict(zip(before["relative_path"].to_pylist(), zip(before["mtime_ns"].to_pylist(), before["size"].to_pylist(), strict=True), strict=True))
    for path, mtime, size in zip(*(now[c].to_pylist() for c in LISTING.names), strict=True):
        was = old.pop(path, None)
        if was != (mtime, size):
            yield path, "created" if was is None else "modified", mtime, size
    for path in sorted(old):
        yield path, "removed", None, None


@dataclass
class Steps(InputPartition):
    """Listings after ``start`` up to ``end``, and which share of the paths."""

    start: int
    end: int
    share: int
    shares: int


class NotifyReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.state = options["path"], options["state"]
        self.skipped = frozenset(x for x in options.get("skipped", "").split(",") if x)
        self.extensions = tuple(f".{x.lower().lstrip('.')}" for x in options.get("extensions", "").split(",") if x)
        self.existing, self.shares = options.get("existing", "false").lower() == "true", int(options.get("shares", "1"))

    def _file(self, n: int) -> str:
        return f"{file_system(self.state)[1].rstrip('/')}/{n:012d}.parquet"

    def _numbers(self) -> list[int]:
        store, base = file_system(self.state)
        store.create_dir(base, recursive=True)
        return sorted(int(f.base_name[:12]) for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".parquet") and f.base_name[:12].isdigit())

    def _load(self, n: int) -> pa.Table:
        return pq.read_table(self._file(n), filesystem=file_system(self.state)[0])

    def _store(self, n: int, table: pa.Table) -> None:
        """Whole or not at all: the file gets its number by a rename."""
        store, base = file_system(self.state)
        own = f"{base.rstrip('/')}/.{uuid.uuid4().hex}"
        pq.write_table(table.replace_schema_metadata({"at": datetime.now(UTC).isoformat()}), own, filesystem=store)
        store.move(own, self._file(n))

    def initialOffset(self) -> dict:
        if not self._numbers():
            self._store(0, LISTING.empty_table() if self.existing else listing(self.root, self.skipped, self.extensions)[0])
        return {"listing": self._numbers()[0]}

    def latestOffset(self) -> dict:
        known = self._numbers()
        last = known[-1] if known else self.initialOffset()["listing"]
        now, _ = listing(self.root, self.skipped, self.extensions)
        if now.equals(self._load(last).replace_schema_metadata(None)):
            return {"listing": last}
        self._store(last + 1, now)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Steps]:
        return [Steps(start["listing"], end["listing"], k, self.shares) for k in range(self.shares)] if end["listing"] > start["listing"] else []

    def read(self, partition: Steps) -> Iterator[tuple]:
        before = self._share(self._load(partition.start), partition)
        for n in range(partition.start + 1, partition.end + 1):
            whole = self._load(n)
            at, now = datetime.fromisoformat(whole.schema.metadata[b"at"].decode()), self._share(whole, partition)
            for path, event, mtime, size in changes(before, now):
                yield path, event, mtime, size, at
            before = now

    @staticmethod
    def _share(table: pa.Table, p: Steps) -> pa.Table:
        if p.shares == 1:
            return table
        return table.filter(pc.equal(pa.array([zlib.crc32(x.encode()) % p.shares for x in table["relative_path"].to_pylist()], pa.int64()), p.share))

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["listing"]:
                file_system(self.state)[0].delete_file(self._file(n))


class NotifySource(DataSource):
    """Options: path; state, a folder of the stream's own that executors share; skipped and extensions, by comma; existing: whether files that are there at first are events; shares: tasks a batch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema: StructType) -> NotifyReader:  # noqa: ARG002
        return NotifyReader(self.options)


def notified(spark: SparkSession, root: str, state: str, **options: object) -> DataFrame:
    """The stream of (relative_path, event, mtime_ns, size, ts) of ``root``."""
    spark.dataSource.register(NotifySource)
    reader = spark.readStream.format(NAME).option("path", root).option("state", state)
    for k, v in options.items():
        reader = reader.option(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else v)
    return reader.load()
