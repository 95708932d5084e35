"""Files found and read by executors: folders that are skipped are not gone into, what is unreadable is recorded, large files come in pieces."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that the driver wants to have seen before it deals their trees out.
SPREAD = 64
FOUND = "relative_path string, mtime_ns long, size long, error string"
FILES = f"{FOUND}, content_hash string, content string"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Of a path or an address, and the path on it."""
    store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store, base.rstrip("/") or "/"


def _contained(store: fs.FileSystem, base: str, path: str) -> bool:
    """Whether a path, links resolved, lies under the root; only local folders have links."""
    if not isinstance(store, fs.LocalFileSystem):
        return True
    real = os.path.realpath(base)
    return os.path.realpath(path) == real or os.path.realpath(path).startswith(real.rstrip("/") + "/")


def look_into(root: str, folder: str, skipped: frozenset[str], extensions: tuple[str, ...]) -> tuple[list[tuple], list[str]]:
    """The files of a folder below ``root`` as FOUND, with what went wrong, and the folders in it to go on with."""
    store, base = file_system(root)
    path = f"{base}/{folder}" if folder else base
    try:
        found = store.get_file_info(fs.FileSelector(path))
    except OSError as e:
        return [(folder, None, None, f"unreadable: {type(e).__name__}")], []
    files, folders = [], []
    for f in found:
        name = f"{folder}/{f.base_name}" if folder else f.base_name
        if f.type == fs.FileType.Directory and f.base_name in skipped:
            continue
        wanted = f.type == fs.FileType.Directory or (f.type == fs.FileType.File and (not extensions or f.base_name.lower().endswith(extensions)))
        if wanted and isinstance(store, fs.LocalFileSystem) and os.path.islink(f.path) and not _contained(store, base, f.path):
            files.append((name, None, None, "escapes workspace root"))
        elif wanted and f.type == fs.FileType.Directory:
            if not (isinstance(store, fs.LocalFileSystem) and os.path.islink(f.path)):  # what a link below the root leads to is met by itself
                folders.append(name)
        elif wanted:
            files.append((name, f.mtime_ns, f.size, None))
    return files, folders


def walk(root: str, folders: list[str], skipped: frozenset[str], extensions: tuple[str, ...]) -> Iterator[tuple]:
    todo = list(folders)
    while todo:
        files, more = look_into(root, todo.pop(), skipped, extensions)
        todo += more
        yield from files


def _endings(extensions: list[str] | None) -> tuple[str, ...]:
    return tuple(sorted({f".{e.lower().lstrip('.')}" for e in extensions or []}))


def planned_listing(spark: SparkSession, root: str, extensions: list[str] | None = None, skipped: list[str] | None = None, spread: int = SPREAD) -> DataFrame:
    """(relative_path, mtime_ns, size, error) of the files below ``root``; unreadable folders and links that lead out have an error.

    The driver lists level by level only until there are ``spread`` folders; executors go down
    from these, one tree after the other.
    """
    avoid, ends = frozenset(skipped or []), _endings(extensions)
    top, todo = [], [""]
    while todo and len(todo) < spread:
        found = [look_into(root, folder, avoid, ends) for folder in todo]
        top += [f for files, _ in found for f in files]
        todo = [f for _, folders in found for f in folders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(walk(root, [folder], avoid, ends))
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["relative_path", "mtime_ns", "size", "error"])

    out = spark.createDataFrame(top, FOUND)
    if todo:
        trees = spark.createDataFrame([(f,) for f in todo], "folder string").repartition(len(todo))
        out = out.unionByName(trees.mapInArrow(run, FOUND))
    return out


def read_listed(listed: DataFrame, root: str, max_bytes: int = 2 << 20) -> DataFrame:
    """The files of a listing with content_hash and content, UTF-8 read with replacement; one that is too large is not read, one that cannot be read has an error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(FILES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                raw = None
                if row["error"] is None and row["size"] > max_bytes:
                    row["error"] = "file too large for indexing"
                elif row["error"] is None:
                    try:
                        with store.open_input_stream(f"{base}/{row['relative_path']}") as f:
                            raw = f.read()
                    except OSError as e:
                        row["error"] = f"unreadable: {type(e).__name__}"
                row |= {"content_hash": None if raw is None else hashlib.sha256(raw).hexdigest(), "content": None if raw is None else raw.decode("utf-8", "replace")}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return listed.select("relative_path", "mtime_ns", "size", "error").mapInArrow(run, schema)


def planned_files(spark: SparkSession, root: str, extensions: list[str] | None = None, skipped: list[str] | None = None, max_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """(files as ``read_files`` gives them, what could not be read with its error). No byte of a skipped folder is read."""
    found = read_listed(planned_listing(spark, root, extensions, skipped), root, max_bytes)
    return found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select("relative_path", "error")


def pieces_of(listed: DataFrame, root: str, piece_bytes: int = 8 << 20) -> DataFrame:
    """(relative_path, piece, content binary): the files of a listing in pieces of ``piece_bytes``, each read by a task of its own."""
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / piece_bytes) - 1).cast("long"))
    places = listed.where("error IS NULL").select("relative_path", F.explode(cuts).alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        for batch in batches:
            for path, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{path}") as f:
                    raw = f.read_at(piece_bytes, piece * piece_bytes)
                yield pa.RecordBatch.from_pydict({"relative_path": [path], "piece": [piece], "content": [raw]})

    return places.repartition(F.xxhash64("relative_path", "piece")).mapInArrow(run, "relative_path string, piece long, content binary")
