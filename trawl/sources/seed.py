"""Seed collections: chunks on ten paths in turn, with one-hot vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seed_chunks(spark: SparkSession, n: int, dims: int) -> DataFrame:
    i = F.col("id")
    hot = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.when(k == i % dims, 1.0).otherwise(0.0).cast("float"))
    return spark.range(n).select(
        i.alias("i"),
        F.concat(F.lit("seed_"), i.cast("string")).alias("doc_id"),
        F.concat(F.lit("path_"), (i % 10).cast("string"), F.lit(".go")).alias("relative_path"),
        F.lit(1).cast("long").alias("start_line"),
        F.lit(1).cast("long").alias("end_line"),
        F.lit("code").alias("chunk_type"),
        F.concat(F.lit("seed chunk "), i.cast("string")).alias("snippet"),
        hot.alias("embedding"),
    )
