"""The driver's tables as a workspace: documents are files, embeddings a collection of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path, content, doc_id, size, mtime_ns and content_hash of each document."""
    d = table(spark, sf_dir, "documents")
    ext = F.get(F.array(*map(F.lit, (".md", ".txt", ".go", ".yaml"))), F.pmod("doc_id", F.lit(4)).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return d.select("doc_id", path.alias("relative_path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"), F.sha2("text", 256).alias("content_hash"))


FILES_SQL = """files AS (
  SELECT doc_id, source || '/' || lang || '/doc_' || doc_id::VARCHAR || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.go' ELSE '.yaml' END AS relative_path,
         text AS content, strlen(text)::BIGINT AS size, doc_id * 1000 AS mtime_ns, sha256(text) AS content_hash FROM documents)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files now, manifest of before): some files are new, some gone, some changed, some touched."""
    f = files(spark, sf_dir)
    now = f.where("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_hash")))
    now = now.withColumn("mtime_ns", F.when(F.col("doc_id") % 11 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")))
    return now, manifest(f.where("doc_id % 3 <> 0"))


def manifest(f: DataFrame) -> DataFrame:
    """A manifest row per file, with one to three ids by the document's number."""
    ids = F.transform(F.sequence(F.lit(0), F.pmod("doc_id", F.lit(3)).cast("int")), lambda i: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string")))
    return f.select("doc_id", "relative_path", "mtime_ns", "size", F.size(ids).alias("chunk_count"), ids.alias("doc_ids"), "content_hash")


SNAPSHOTS_SQL = f"""{FILES_SQL}, now AS (
  SELECT doc_id, relative_path, size, CASE WHEN doc_id % 11 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns,
         CASE WHEN doc_id % 5 = 0 THEN sha256(content || '!') ELSE content_hash END AS content_hash FROM files WHERE doc_id % 7 <> 0
), manifest AS (
  SELECT doc_id, relative_path, size, mtime_ns, (doc_id % 3 + 1)::INTEGER AS chunk_count,
         list_transform(range(0, doc_id % 3 + 1), lambda i: 'd' || doc_id::VARCHAR || '_' || i::VARCHAR) AS doc_ids, content_hash FROM files WHERE doc_id % 3 <> 0)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search hits with a score."""
    f = files(spark, sf_dir)
    symbol = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("HandleToken"), F.col("doc_id").cast("string"))).otherwise("")
    strategy = F.get(F.array(*map(F.lit, ("ast", "partial", "prose", "line_window"))), F.pmod("doc_id", F.lit(4)).cast("int"))
    return f.select(
        F.col("doc_id"),
        F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("docs/"), "relative_path")).when(F.col("doc_id") % 10 == 0, F.concat(F.lit("testdata/"), "relative_path")).otherwise(F.col("relative_path")).alias("path"),
        F.lit(1).cast("long").alias("start_line"),
        (F.size(F.split("content", "\n", -1))).cast("long").alias("end_line"),
        F.col("content").alias("snippet"),
        symbol.alias("symbol_name"),
        strategy.alias("chunk_strategy"),
        (F.pmod(F.col("doc_id") * 37, F.lit(1000)) / 1000.0).alias("score"),
    )


HITS_SQL = f"""{FILES_SQL}, hits AS (
  SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'docs/' || relative_path WHEN doc_id % 10 = 0 THEN 'testdata/' || relative_path ELSE relative_path END AS path,
         1::BIGINT AS start_line, len(string_split(content, chr(10)))::BIGINT AS end_line, content AS snippet,
         CASE WHEN doc_id % 5 = 0 THEN 'HandleToken' || doc_id::VARCHAR ELSE '' END AS symbol_name,
         CASE doc_id % 4 WHEN 0 THEN 'ast' WHEN 1 THEN 'partial' WHEN 2 THEN 'prose' ELSE 'line_window' END AS chunk_strategy,
         ((doc_id * 37) % 1000) / 1000.0::DOUBLE AS score FROM files), q AS (SELECT ['token', 'src1', 'handle', 'doc_12'] AS terms)"""
QUERY = "token src1 handle, token"
