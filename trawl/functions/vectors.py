"""Vector expressions in double precision, and top-k over a collection of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors in a packed block: with 64 dimensions a pair of blocks is 256 KB, and Spark ends Arrow batches at 64 MB.
BLOCK = 256


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(doubles(v), lambda x: x / norm)).otherwise(doubles(v))


def literal_vector(values: list[float]) -> Column:
    return F.lit(np.asarray(values, dtype=np.float64).tolist())


def nearest(df: DataFrame, query: list[float], k: int, vector_col: str = "embedding", id_col: str = "vec_id", only: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine distance, ties by id; ``only`` is a filter below the top-k.

    A sort and limit that Spark runs as one top-k a partition and a merge of k rows each.
    Vectors that are null or zero take no part.
    """
    k = k if k > 0 else 10
    rows = df if only is None else df.where(only)
    q = np.asarray(query, np.float64)
    length = float(np.linalg.norm(q))
    v = F.col(vector_col)
    score = F.lit(1.0) - F.try_divide(dot(v, literal_vector(q / length if length else q)), F.sqrt(dot(v, v)))
    return rows.withColumn("score", score).where("score IS NOT NULL").orderBy("score", id_col).limit(k)


def _blocks(df: DataFrame, vector_col: str, id_col: str, prefix: str) -> DataFrame:
    """Rows of up to ``BLOCK`` ids and unit-length vectors each, as packed numbers; vectors without a direction are left out."""
    schema = T.StructType([T.StructField(prefix + "ids", T.BinaryType()), T.StructField(prefix + "vectors", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = np.array(batch.column(0).to_pylist(), np.int64), np.array(batch.column(1).to_pylist(), np.float64)
            length = np.linalg.norm(x, axis=1)
            sound = np.isfinite(length) & (length > 0)
            ids, x = ids[sound], x[sound] / length[sound, None]
            starts = range(0, len(ids), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k : k + BLOCK].tobytes() for k in starts], pa.binary()), pa.array([x[k : k + BLOCK].tobytes() for k in starts], pa.binary())], names=schema.names)

    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col).mapInArrow(pack, schema)


def nearest_batch(df: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest rows of each query, distances to nine digits, ties by id.

    ``queries`` holds query_id and the vector column. Both sides are packed into blocks, every
    block of queries meets every block of rows in one matrix product, and a task keeps its own k
    best of each query it sees. Spark broadcasts the blocks of queries while they are small and
    deals pairs of partitions otherwise, so no side must fit anywhere as a whole. Vectors that
    are null, zero or not finite take no part; no queries or no rows give an empty result.
    """
    if not isinstance(queries, DataFrame):
        queries = df.sparkSession.createDataFrame(queries, f"query_id long, {vector_col} array<double>")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for names, vectors, asked, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, n = np.frombuffer(names, np.int64), len(asked) // 8
                far = 1 - np.frombuffer(wanted, np.float64).reshape(n, -1) @ np.frombuffer(vectors, np.float64).reshape(len(ids), -1).T
                own = np.broadcast_to(ids, far.shape)
                if asked in held:
                    far, own = np.hstack([held[asked][0], far]), np.hstack([held[asked][1], own])
                at = np.lexsort((own, np.round(far, 9) + 0.0), axis=-1)[:, :k]
                held[asked] = np.take_along_axis(far, at, 1), np.take_along_axis(own, at, 1)
        for asked, (far, own) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(asked, np.int64), far.shape[1])), pa.array(own.ravel()), pa.array(far.ravel())], names=["query_id", id_col, "score"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
    pairs = _blocks(df, vector_col, id_col, "").crossJoin(_blocks(queries, vector_col, "query_id", "query_"))
    found = pairs.mapInArrow(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mean_pool(df: DataFrame, key: str, vector_col: str, mask: Column) -> DataFrame:
    """(key, pos, value): the unit-length mean of the unmasked vectors of each key."""
    cells = df.where(mask).select(key, F.posexplode(doubles(F.col(vector_col))).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    norms = means.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return means.join(norms, key).select(key, "pos", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")).alias("value"))
