"""Workspace files as a relation: from the version control's list or a walk, then read by Spark."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.paths import has_extension, in_skipped_dir, relative_to


def contained(root: str, path: str) -> bool:
    """Whether a path, links resolved, lies under the root."""
    base = Path(root).resolve()
    return base == (p := (base / path).resolve()) or base in p.parents


def git_files(root: str) -> list[str] | None:
    """Tracked and untracked files that are not ignored, without deleted ones; None where git does not answer."""
    def lines(*more: str) -> set[str]:
        found = subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", "ls-files", "-z", *more], capture_output=True, check=True, timeout=60)
        return {x for x in found.stdout.decode("utf-8", "surrogateescape").split("\0") if x}

    try:
        return sorted(lines("--cached", "--others", "--exclude-standard") - lines("--deleted")) or None
    except (OSError, subprocess.SubprocessError):
        return None


def read_files(spark: SparkSession, root: str, extensions: list[str] | None = None, skipped: list[str] | None = None, listed: list[str] | None = None) -> DataFrame:
    """relative_path, mtime_ns, size, content_hash, content of files under ``root``, UTF-8 read with replacement.

    ``listed`` restricts to a list, such as ``git_files`` gives.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:  # other files are left out when Spark lists, before a byte is read
        ends = ",".join(sorted({"".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in e.lstrip(".")) for e in extensions}))
        reader = reader.option("pathGlobFilter", f"*.{{{ends}}}")
    found = reader.load(root)
    path = relative_to(F.col("path"), root)
    rows = found.select(path.alias("relative_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    rows = rows.where(has_extension(F.col("relative_path"), extensions or []) & ~in_skipped_dir(F.col("relative_path"), skipped or []))
    if listed is not None:
        rows = rows.join(spark.createDataFrame([(p,) for p in listed], "relative_path string"), "relative_path", "left_semi")
    return rows


def workspace_files(spark: SparkSession, root: str, extensions: list[str] | None = None, skipped: list[str] | None = None) -> tuple[DataFrame, str]:
    """The files of a workspace and a warning, '' where version control lists them and else why all files were walked."""
    listed = git_files(root)
    if listed is not None:
        return read_files(spark, root, extensions, skipped, [p for p in listed if contained(root, p)]), ""
    return read_files(spark, root, extensions, skipped), "version control gave no list; all files below the root were walked"


class Journal:
    """What is going to be deleted, one list a JSON line, written before anything is, so that a run that was cut short is finished by the next."""

    def __init__(self, spark: SparkSession, path: str, column: str = "doc_id") -> None:
        self.spark, self.path, self.column = spark, path, column

    def append(self, ids: DataFrame) -> None:
        ids.select(F.array(self.column).alias(f"{self.column}s")).write.mode("append").json(self.path)

    def pending(self) -> DataFrame:
        """All ids of the journal; a broken line is an error."""
        found = self.spark.read.schema(f"{self.column}s array<string>").option("mode", "FAILFAST").json(self.path)
        return found.select(F.explode(f"{self.column}s").alias(self.column))

    def clear(self) -> None:
        from trawl.index.snapshot import Files

        Files(self.spark, self.path.rsplit("/", 1)[0]).delete(self.path.rsplit("/", 1)[1])
