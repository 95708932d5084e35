"""Tables as immutable versions with a pointer: readers never see a half-written one.

All files go through the session's file systems, so a store can lie anywhere Spark writes.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Seconds after which a lock that its holder does not write any more counts as left behind.
STALE = 600.0


class Files:
    """Small files and renames on the file system of a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}" if p else self.root)
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        s = self.fs.open(self._path(path))
        try:
            return bytes(s.readAllBytes()).decode()
        finally:
            s.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: a new file that takes the old one's place."""
        self.put(path + ".new", text)
        self._rename(path + ".new", path, "OVERWRITE")

    def publish(self, path: str, text: str) -> bool:
        """Writes a file that nobody has written yet, whole; false if somebody has."""
        own = f"{path}.{uuid.uuid4().hex}"
        self.put(own, text)
        try:
            self._rename(own, path, "NONE")
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.delete(own)
            return False
        return True

    def _rename(self, path: str, to: str, how: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        where = self.fs.makeQualified(self._path("")).toUri()  # the file system that all other calls go to
        context = hadoop.FileContext.getFileContext(where, self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = getattr(hadoop.Options.Rename, how)
        context.rename(self.fs.makeQualified(self._path(path)), self.fs.makeQualified(self._path(to)), options)

    def claim(self, path: str) -> bool:
        """Creates an empty file; false if there is one."""
        try:
            return self.fs.createNewFile(self._path(path))
        except Exception:  # another process was faster
            return False

    def put(self, path: str, text: str) -> None:
        """Writes in place, so that the file never goes away."""
        s = self.fs.create(self._path(path), True)
        s.write(bytearray(text.encode()))
        s.close()

    def age(self, path: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self.fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def rename(self, path: str, to: str) -> bool:
        return self.exists(path) and self.fs.rename(self._path(path), self._path(to))

    def delete(self, path: str, attempts: int = 3, pause: float = 0.05) -> None:
        """Tries again after a pause that grows, where a file system says no for a moment."""
        for attempt in range(1, attempts + 1):
            try:
                self.fs.delete(self._path(path), True)
                return
            except Py4JJavaError:
                if attempt == attempts:
                    raise
                time.sleep(pause * attempt)

    def sizes(self, path: str) -> list[int]:
        return [s.getLen() for s in self.fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")] if self.exists(path) else []

    def names(self, path: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(path))] if self.exists(path) else []

    def below(self, path: str) -> dict[str, int]:
        """Sizes of the data files below a folder, by their path from the root."""
        out, base = {}, self.fs.makeQualified(self._path("")).toString().rstrip("/") + "/"
        found = self.fs.listFiles(self._path(path), True) if self.exists(path) else None
        while found is not None and found.hasNext():
            s = found.next()
            if s.getPath().getName().startswith("part-"):
                out[s.getPath().toString().removeprefix(base)] = s.getLen()
        return out


class LostLock(Exception):
    """Another writer took the lock over, so what this one does must not count any more."""


class Locked:
    """A folder with one writer at a time."""

    files: Files
    owner = ""

    @contextmanager
    def lock(self, stale: float = STALE):  # noqa: ANN201
        """One writer at a time. The holder writes its name again and again; a lock that was not written for ``stale`` seconds is taken over."""
        me = uuid.uuid4().hex
        if not self.files.claim("LOCK") and not self._take_over(stale, me):
            raise RuntimeError("another writer holds the index")
        self.files.put("LOCK", me)
        self.owner, done = me, threading.Event()

        def hold() -> None:
            while not done.wait(stale / 10) and self.files.read("LOCK") == me:
                self.files.put("LOCK", me)

        holder = threading.Thread(target=hold, daemon=True)
        holder.start()
        try:
            yield
        finally:
            done.set()
            holder.join()
            self.owner = ""
            if self.files.read("LOCK") == me:
                self.files.delete("LOCK")

    def owned(self) -> None:
        """Raises if the lock that this writer took is another's by now."""
        if self.owner and self.files.read("LOCK") != self.owner:
            raise LostLock("another writer has taken the index over")

    def _take_over(self, stale: float, me: str) -> bool:
        """Moves a dead writer's lock away, which only one can do, and claims a new one."""
        seen = self.files.read("LOCK")
        if seen is not None and self.files.age("LOCK") <= stale:
            return False
        if seen is not None and self.files.rename("LOCK", f"LOCK.{me}"):
            if self.files.read(f"LOCK.{me}") != seen:  # somebody took it over in between
                self.files.rename(f"LOCK.{me}", "LOCK")
                return False
            self.files.delete(f"LOCK.{me}")
        return self.files.claim("LOCK")


class Store(Locked):
    """A table of one schema under a folder: ``v=<n>`` folders of Parquet and ``CURRENT`` with the one that counts."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str) -> None:
        self.spark, self.schema, self.key, self.files = spark, schema, key, Files(spark, root)

    def version(self) -> int:
        return int(self.files.read("CURRENT") or 0)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.files.root}/v={v}")

    def stage(self, df: DataFrame) -> int:
        """Writes a version without making it count."""
        taken = [int(n[2:]) for n in self.files.names() if n.startswith("v=")]
        v = max([0, *taken]) + 1
        df.select(*self.schema.fieldNames()).write.parquet(f"{self.files.root}/v={v}")
        return v

    def promote(self, version: int, keep_old: int = 1) -> None:
        """Makes a version count, in one rename; versions before the last ``keep_old`` go."""
        before = self.version()
        self.owned()
        self.files.write("CURRENT", str(version))
        for n in self.files.names():
            if n.startswith("v=") and int(n[2:]) != version and int(n[2:]) <= before - keep_old:
                self.files.delete(n)

    def discard(self, version: int) -> None:
        self.files.delete(f"v={version}")

    def replace(self, df: DataFrame) -> int:
        v = self.stage(df)
        self.promote(v)
        return v

    def upsert(self, rows: DataFrame) -> int:
        from trawl.operators.changes import upsert

        return self.replace(upsert(self.read(), rows, self.key))

    def delete(self, ids: DataFrame) -> int:
        from trawl.operators.changes import delete_by_id

        return self.replace(delete_by_id(self.read(), ids, self.key))

    def wipe(self) -> int:
        return self.replace(self.spark.createDataFrame([], self.schema))

    def compact(self, target_bytes: int = 128 << 20) -> bool:
        """Rewrites a version of many small files as few; false if there is nothing to gain."""
        sizes = self.files.sizes(f"v={self.version()}")
        wanted = max(1, -(-sum(sizes) // target_bytes))
        if len(sizes) < 2 * wanted:
            return False
        self.replace(self.read().repartition(wanted))
        return True


def write_json(files: Files, path: str, value: dict) -> None:
    files.write(path, json.dumps(value, sort_keys=True, indent=2))


def read_json(files: Files, path: str) -> dict | None:
    text = files.read(path)
    return json.loads(text) if text else None
