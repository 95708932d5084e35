"""Counts over manifests and collections, consistency checks, progress and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"))


def all_ids(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("doc_ids").alias("doc_id")).where("doc_id <> ''").distinct()


def unique_id_count(manifest: DataFrame, approximate: bool = False) -> DataFrame:
    ids = manifest.select(F.explode("doc_ids").alias("doc_id")).where("doc_id <> ''")
    return ids.agg((F.approx_count_distinct("doc_id") if approximate else F.count_distinct("doc_id")).alias("unique_ids"))


def desync(manifest: DataFrame, collection: DataFrame) -> DataFrame:
    """One row: chunks, unique_ids, doc_count, missing, and whether manifest and collection are out of step."""
    ids = all_ids(manifest)
    missing = ids.join(collection.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    one = manifest_stats(manifest).crossJoin(unique_id_count(manifest)).crossJoin(collection.agg(F.count(F.lit(1)).alias("doc_count"))).crossJoin(missing)  # one row each
    differs = (F.col("unique_ids") != F.col("chunks")) | (F.col("doc_count") == 0) | (F.col("unique_ids") != F.col("doc_count")) | (F.col("missing") > 0)
    return one.select("chunks", "unique_ids", "doc_count", "missing", ((F.col("chunks") > 0) & differs).alias("desync"))


def diagnostics(chunks: Column, doc_count: Column, failed: Column, skipped: Column) -> Column:
    """What an index status warns of, in order."""
    found = F.array(
        F.when(doc_count > 2 * chunks, "collection_bloat"),
        F.when((chunks > 0) & (doc_count == 0), "empty_collection"),
        F.when(failed > 0, "failed_files"),
        F.when(skipped > 0, "skipped_paths"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def repeated_ids(chunks: DataFrame) -> DataFrame:
    """(relative_path, doc_id, n) of ids that are empty or repeat within a file."""
    return chunks.groupBy("relative_path", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id = ''")


def ids_in_order(chunks: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("chunk_index", "doc_id")))
    return chunks.groupBy("relative_path").agg(F.transform(pairs, lambda x: x["doc_id"]).alias("doc_ids"), F.count(F.lit(1)).cast("int").alias("chunk_count"))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.lit(100.0) * done / total, 1)).otherwise(F.lit(0.0))


def seconds_left(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when((done > 0) & (total > done), F.ceil(elapsed / done * (total - done))).otherwise(F.lit(0).cast("long"))


def failed_files(events: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` distinct paths by the time they failed: a top-k report."""
    return events.groupBy("relative_path").agg(F.min("seq").alias("seq")).orderBy("seq").limit(most)


def rolling_latency(samples: DataFrame, key: str | None = None, window: int = 20, least: int = 5, ratio: float = 2.0, slow_s: float = 5.0) -> DataFrame:
    """Each sample (seq, ms) with the median of its window, itself included, and whether search has become slow.

    ``key`` splits the samples in streams, each a partition of its own.
    """
    order = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy("seq").rowsBetween(1 - window, 0)
    n, median = F.count("ms").over(order), F.expr("percentile(ms, 0.5)").over(order)
    slow = F.col("ms") >= slow_s * 1000
    above = (F.col("n") >= least) & (F.col("median_ms") > 0) & (F.col("ms") > F.col("median_ms") * ratio)
    out = samples.withColumn("n", n).withColumn("median_ms", median)
    return out.withColumn("degraded", F.when(F.col("n") < least, slow).otherwise(above | slow)).withColumn("reason", F.when(above, "median_ratio").when(slow, "absolute_slow_threshold").otherwise(""))


def eviction_order(workspaces: DataFrame) -> DataFrame:
    """Idle workspaces (refs = 0), the one to evict first first."""
    idle = workspaces.where("refs = 0")
    return idle.withColumn("evict_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("last_used", "workspace_id")))


def median_of_last(samples: DataFrame, key: str, window: int = 20) -> DataFrame:
    """The median of each stream's last samples."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc()))
    return samples.withColumn("back", back).where(F.col("back") <= window).groupBy(key).agg(F.expr("percentile(ms, 0.5)").alias("median_ms"))


def present_ids(manifest: DataFrame, collection: DataFrame) -> DataFrame:
    """Per file the ids, in order, that the collection holds, and how many it lacks."""
    ids = manifest.select("relative_path", F.posexplode("doc_ids").alias("at", "doc_id"))
    there = collection.select("doc_id", F.lit(True).alias("there")).distinct()
    marked = ids.join(there, "doc_id", "left").groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "there"))).alias("all"))
    held = F.filter("all", lambda x: x["there"].isNotNull())
    return marked.select("relative_path", F.transform(held, lambda x: x["doc_id"]).alias("present"), (F.size("all") - F.size(held)).alias("missing"))
