"""Snapshots of files against a manifest: what is new, changed, unchanged or gone, and whose ids go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incremental_diff(files: DataFrame, manifest: DataFrame, hash_only: bool = False) -> DataFrame:
    """(relative_path, status) of all paths on either side, one shuffle of each.

    A file is unchanged if its row has equal time, size and a hash that is not empty and
    equal; with ``hash_only`` the hash alone decides.
    """
    f = files.select("relative_path", F.struct("mtime_ns", "size", "content_hash").alias("now"))
    m = manifest.select("relative_path", F.struct("mtime_ns", "size", "content_hash").alias("then"))
    same = (F.col("now.content_hash") == F.col("then.content_hash")) & (F.col("then.content_hash") != "")
    if not hash_only:
        same &= (F.col("now.mtime_ns") == F.col("then.mtime_ns")) & (F.col("now.size") == F.col("then.size"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return f.join(m, "relative_path", "full_outer").select("relative_path", status.alias("status"))


def removed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(files.select("relative_path"), "relative_path", "left_anti")


def existing_files(listed: DataFrame, deleted: DataFrame) -> DataFrame:
    return listed.join(deleted.select("relative_path"), "relative_path", "left_anti")


def not_among(ids: Column, others: Column) -> Column:
    """Elements of an array that another does not hold, in order, repeats included."""
    return F.filter(ids, lambda x: ~F.array_contains(others, x))


def stale_ids(old: Column, new: Column) -> Column:
    return not_among(old, new)


def rollback_ids(old: Column, new: Column) -> Column:
    return not_among(new, old)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete_by_id(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows but those with an id of ``ids``; ids may repeat or be missing."""
    return existing.join(ids.select(key).distinct(), key, "left_anti")


def delete_outcome(requested: DataFrame, remaining: DataFrame, key: str) -> DataFrame:
    """(key, deleted) of each requested id: one that is not there any more counts as deleted."""
    left = remaining.select(key, F.lit(True).alias("there")).distinct()
    return requested.select(key).distinct().join(left, key, "left").select(key, F.col("there").isNull().alias("deleted"))


def poll_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(relative_path, event) between two polls: created, modified or removed."""
    b = before.select("relative_path", F.struct("mtime_ns", "size").alias("then"))
    n = now.select("relative_path", F.struct("mtime_ns", "size").alias("now"))
    event = F.when(F.col("then").isNull(), "created").when(F.col("now").isNull(), "removed").when(~F.col("then").eqNullSafe(F.col("now")), "modified")
    return n.join(b, "relative_path", "full_outer").select("relative_path", event.alias("event")).where("event IS NOT NULL")
