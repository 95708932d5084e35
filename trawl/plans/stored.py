"""Queries over tables that are stored, changed and read again: the commit log, its deltas, and inverted lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.index import inverted
from trawl.index.log import Kind, Log
from trawl.operators.split_windows import split_line_windows
from trawl.plans.catalog import SQL, query
from trawl.plans.scratch import scratch
from trawl.plans.workspace import FILES_SQL, files, table

PLACED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *inverted.CODED])
ROW = T.StructType([T.StructField(n, t) for n, t in (("relative_path", T.StringType()), ("doc_id", T.LongType()), ("content_hash", T.StringType()))])


def _placed(spark, sf_dir):
    """All embeddings in cells of a stored table, in two commits, and where the cells are."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dims = rows.select(F.max(F.size("embedding"))).first()[0] or 1
    log = Log(spark, scratch(spark, "cells"), {"cells": Kind(PLACED, "array(vec_id)", key="vec_id", bucket="cell")})
    centroids = inverted.learn(rows, "vec_id", "embedding", dims)
    for some in ("vec_id % 3 <> 0", "vec_id % 3 = 0"):  # the second is an upsert into the cells of the first
        t = log.begin()
        t.radii = inverted.radii(t.insert("cells", inverted.assigned(rows.where(some), "embedding", centroids)))
        t.commit()
    state = log.state()
    return log, state, inverted.Cells(centroids, state.radii), rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


@query("k1_index_search", SQL["j9_knn_batch"])
def index_search(spark, sf_dir):
    """The five nearest of every twentieth vector, by the cells that can hold them: equal to the full scan."""
    log, state, cells, asked = _placed(spark, sf_dir)
    found = inverted.search(log.read("cells", state), asked, cells, 5)
    return found.select("query_id", "vec_id", "rank", (F.round("score", 6) + 0.0).alias("score"))


@query("k1_index_recall")
def index_recall(spark, sf_dir):
    """Per query how many of its ten nearest a search by codes finds, in as many cells as reach a recall of 0.95 on a sample, and the share of files that it reads."""
    log, state, cells, asked = _placed(spark, sf_dir)
    rows = log.read("cells", state)
    sample = asked.orderBy(F.xxhash64("query_id")).limit(200)
    probes, _ = inverted.tuned(rows, sample, cells)
    truth = inverted.search(rows, asked, cells, 10).select("query_id", "vec_id")
    found = inverted.search(rows, asked, cells, 10, probes, exact=False).select("query_id", "vec_id", F.lit(1).alias("hit"))
    share = min(probes, int((cells.radius >= 0).sum())) / max(1, int((cells.radius >= 0).sum()))
    return truth.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_found")).withColumns({"probes": F.lit(probes), "share_read": F.lit(share)})


@query("c3_split_windows", SQL["c2_line_windows"])
def split_windows(spark, sf_dir):
    """Line windows of all documents, which come in pieces of 997 bytes, cut wherever that falls."""
    d = files(spark, sf_dir).select("relative_path", F.col("content").cast("binary").alias("content"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length("content") - 1), F.lit(997))
    pieces = d.select("relative_path", F.posexplode(F.transform(starts, lambda k: F.substring("content", k + 1, F.lit(997)))).alias("piece", "content"))
    found = split_line_windows(pieces, window=12, overlap=4)
    return found.select("relative_path", "chunk_index", "start_line", "end_line", "start_byte", "end_byte", F.sha2("snippet", 256).alias("snippet_hash"))


@query("w6_row_deltas", f"WITH {FILES_SQL} SELECT relative_path, doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(content || '!') ELSE content_hash END AS content_hash FROM files WHERE doc_id % 7 <> 0")
def row_deltas(spark, sf_dir):
    """Documents as rows of a log: two thirds are stored, a fifth changed, the rest added, a seventh deleted, files packed in between."""
    rows = files(spark, sf_dir).select("relative_path", "doc_id", "content_hash", "content")
    log = Log(spark, scratch(spark, "deltas"), {"rows": Kind(ROW, "array(doc_id)")}, buckets=16)
    changed = rows.withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_hash")))
    first = log.begin()
    first.insert("rows", rows.where("doc_id % 3 <> 0"))
    first.commit()
    second = log.begin()
    second.delete("rows", rows.where("doc_id % 5 = 0").select("relative_path"))
    second.insert("rows", changed.where("doc_id % 5 = 0 OR doc_id % 3 = 0"))
    second.commit()
    log.pack()
    third = log.begin()
    third.delete("rows", rows.where("doc_id % 7 = 0").select("relative_path"))
    third.commit()
    return log.read("rows")


@query("a4_set_digests", f"WITH {FILES_SQL} SELECT count(*) AS ids, count(*) AS counted, true AS equal FROM files WHERE doc_id % 7 <> 0")
def set_digests(spark, sf_dir):
    """Whether the digest that a log carries through inserts and deletes is that of the rows that are there."""
    rows = files(spark, sf_dir).select("relative_path", "doc_id", "content_hash")
    log = Log(spark, scratch(spark, "digests"), {"rows": Kind(ROW, "array(doc_id)")}, buckets=8)
    first = log.begin()
    first.insert("rows", rows)
    first.commit()
    second = log.begin()
    second.delete("rows", rows.where("doc_id % 7 = 0").select("relative_path"))
    second.commit()
    state = log.state()
    carried, there = state.digests["rows"], log.digest("rows", log.read("rows", state))
    return spark.createDataFrame([(carried[0], there[0], list(carried) == list(there))], "ids long, counted long, equal boolean")


@query("m2_reindex", f"WITH {FILES_SQL} SELECT relative_path, CASE WHEN doc_id % 5 = 0 THEN sha256(content || '!') ELSE content_hash END AS content_hash FROM files WHERE doc_id % 7 <> 0 AND strlen(content) <= 2097152")
def reindex(spark, sf_dir):
    """All documents indexed by the engine in two runs, the second with changed, new and removed files: what the manifest names then."""
    from trawl.index.embed import HashEmbedder
    from trawl.index.engine import Engine

    rows = files(spark, sf_dir).select("doc_id", "relative_path", "mtime_ns", "size", "content_hash", "content")
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    later = rows.where("doc_id % 7 <> 0").withColumn("content", edited)
    later = later.withColumns({"content_hash": F.sha2("content", 256), "size": F.octet_length("content").cast("long")})
    engine = Engine(spark, scratch(spark, "engine"), "documents", HashEmbedder(16))
    engine.reindex(rows.where("doc_id % 3 <> 0").drop("doc_id"))
    engine.reindex(later.drop("doc_id"))
    return engine.manifest.read().select("relative_path", "content_hash")
