"""Nearest neighbours by inverted lists: learnt centroids, a cell of rows for each, residual codes.

Centroids are learnt on a bounded sample; every row lies in the cell of its nearest centroid,
which is its partition in the stored table. A search reads the cells nearest to its query. It
may stop there (``probes`` cells, candidates by codes of one byte a dimension, then exact
distances), or go on to every cell that can hold a nearer row: a row of a cell is no nearer to
the query than the centroid is, less the cell's radius. Then it finds what a full scan finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.vectors import cosine_distance

#: Rows that centroids are learnt on at most, and numbers in these; centroids at most, and rounds of learning.
SAMPLE, NUMBERS, CELLS, ROUNDS = 65_536, 1 << 22, 4_096, 10
#: Candidates by codes for each neighbour asked for.
CANDIDATES = 8
#: Numbers of the vectors that a task holds of rows and of queries, numbers of a matrix, and rows that are held before only the best are kept.
PART, MATRIX, FOUND = 1 << 22, 1 << 20, 1 << 19
#: Parts that rows are dealt to at least, if these have so many rows.
SPREAD, LEAST = 16, 1024
#: Distances are compared to so many digits; radii and bounds get this much slack.
DIGITS, SLACK = 9, 1e-6


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows have a direction."""
    n = np.linalg.norm(x, axis=1)
    sound = np.isfinite(n) & (n > 0)
    return np.where(sound[:, None], x / np.where(sound, n, 1)[:, None], 0.0), sound


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow column; null ones, and those of another length or with nulls, are zero."""
    if not column.null_count and pc.all(pc.equal(pc.list_value_length(column), dims)).as_py() and not (flat := column.flatten()).null_count:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dims and None not in v:
            out[i] = v
    return out


def learn(df: DataFrame, id_col: str, vector_col: str, dims: int, cells: int = 0) -> np.ndarray:
    """Centroids of length 1 by spherical k-means on the rows whose ids have the least hashes: ``SAMPLE`` at most, of ``NUMBERS`` components in all.

    ``cells`` defaults to the square root of the number of rows, ``CELLS`` at most. No rows with
    a direction give one centroid.
    """
    rows = df.where(F.size(vector_col) == dims)
    cells = min(CELLS, cells or round(rows.count() ** 0.5))
    taken = rows.orderBy(F.xxhash64(id_col), id_col).limit(max(1, min(SAMPLE, NUMBERS // dims))).select(vector_col).collect()
    x, sound = _unit(np.array([[0.0 if c is None else c for c in r[0]] for r in taken], np.float64).reshape(-1, dims))
    x = x[sound]
    if not len(x):
        return np.eye(1, dims)
    rng = np.random.default_rng(7)
    found = x[rng.choice(len(x), min(len(x), max(1, cells)), replace=False)]
    for _ in range(ROUNDS):
        at = np.concatenate([(x[k : k + 4096] @ found.T).argmax(1) for k in range(0, len(x), 4096)])
        total = np.zeros_like(found)
        np.add.at(total, at, x)
        mean, some = _unit(total)
        found = np.where(some[:, None], mean, x[rng.integers(0, len(x), len(found))])
    return np.unique(found, axis=0)


CODED = [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("scale", T.DoubleType()), T.StructField("code", T.BinaryType())]


def assigned(df: DataFrame, vector_col: str, centroids: np.ndarray) -> DataFrame:
    """``df`` with the cell of each row, its distance from the centroid, and the residual as bytes times a scale. Vectors without a direction have cell -1."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, *CODED])
    arrow, sent, at = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(centroids), df.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x, sound = _unit(_matrix(batch.column(at), c.shape[1]))
            cell = np.concatenate([np.zeros(0, np.int64), *((x[r.start : r.stop] @ c.T).argmax(1) for r in _runs(len(x), len(c)))])
            rest = x - c[cell]
            scale = np.abs(rest).max(1, initial=0.0) / 127
            code = np.round(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            made = [np.where(sound, cell, -1).astype(np.int32), np.linalg.norm(rest, axis=1), scale]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made), pa.array([r.tobytes() for r in code], pa.binary())], schema=arrow)

    return df.mapInArrow(run, schema)


def radii(rows: DataFrame) -> dict[str, float]:
    """How far the rows of each cell are from its centroid at most: a number a cell."""
    return {str(r["cell"]): r["r"] for r in rows.where("cell >= 0").groupBy("cell").agg(F.max("away").alias("r")).collect()}


class Cells:
    """Where a collection's cells are: centroids, and for those that hold rows their radii."""

    def __init__(self, centroids: np.ndarray, radii: dict[str, float]) -> None:
        self.centroids = centroids
        self.radius = np.full(len(centroids), -np.inf)
        for cell, r in radii.items():
            if 0 <= int(cell) < len(centroids):
                self.radius[int(cell)] = r

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances of unit vectors from the centroids; empty cells are infinitely far."""
        d = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T))
        return np.where(np.isfinite(self.radius), d, np.inf)

    def nearest(self, x: np.ndarray, probes: int) -> list[np.ndarray]:
        """The cells to look in first for each vector."""
        d = self.away(x)
        return [r[np.isfinite(row[r])] for row, r in zip(d, np.argsort(d, axis=1, kind="stable")[:, :probes], strict=True)]

    def reach(self, x: np.ndarray, probes: int | np.ndarray) -> np.ndarray:
        """How far the last of the ``probes`` cells is that each vector looks in first."""
        last = np.broadcast_to(np.clip(probes, 1, len(self.centroids)) - 1, len(x))
        return np.sort(self.away(x), axis=1)[np.arange(len(x)), last]

    def within(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Vectors x cells: whether a cell that holds rows is within reach."""
        d = self.away(x)
        return np.isfinite(d) & (d <= reach[:, None] + 10.0**-DIGITS)

    def possible(self, x: np.ndarray, farthest: np.ndarray) -> np.ndarray:
        """Vectors x cells: whether a cell can hold a row of a cosine distance of ``farthest`` or less."""
        return self.away(x) - self.radius - SLACK <= np.sqrt(2 * np.maximum(0.0, farthest))[:, None]


class Parts:
    """Which part of the rows each cell lies in: cells of neighbouring numbers together, ``limit`` rows at most; a larger cell in several parts."""

    def __init__(self, counts: dict[int, int], cells: int, limit: int) -> None:
        self.first, self.times = np.zeros(cells, np.int64), np.ones(cells, np.int64)
        part = held = 0
        for c in sorted(counts):
            if held and held + counts[c] > limit:
                part, held = part + 1, 0
            self.first[c], self.times[c], held = part, max(1, -(-counts[c] // limit)), held + counts[c]
            if self.times[c] > 1:
                part, held = part + int(self.times[c]), 0
        self.count = part + 1
        in_use = sorted(counts)
        self.cells = [np.array([c for c in in_use if self.first[c] <= p < self.first[c] + self.times[c]], np.int64) for p in range(self.count)]

    def of(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[cell] + _mixed(ids, self.times[cell])


def _mixed(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Numbers below ``n`` by a hash of ids."""
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.asarray(n, np.uint64)).astype(np.int64)


def _asked(queries: DataFrame, cells: Cells, parts: Parts, shares: int, probes: int | str, vector_col: str, with_limit: bool) -> DataFrame:
    """Blocks (part, share, ids, vectors, limits) of queries for each part of the rows that has a cell to look in: the
    ``probes`` nearest, all within the distance ``limits``; or, with a ``limit`` of their own, all that can hold a row as near."""
    sent = queries.sparkSession.sparkContext.broadcast((cells, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, p = sent.value
        for batch in batches:
            for at in _runs(batch.num_rows, len(c.centroids)):
                some = batch.slice(at.start, len(at))
                x, sound = _unit(_matrix(some.column(1), c.centroids.shape[1]))
                given = some.column(2).to_numpy(zero_copy_only=False) if more else probes
                limit = given if with_limit else c.reach(x, given)
                wanted = (c.possible(x, limit) if with_limit else c.within(x, limit)) & sound[:, None]
                ids = some.column(0).to_numpy()
                share = _mixed(ids, shares)
                for part, own in enumerate(p.cells):
                    met = wanted[:, own].any(1)
                    for s in range(shares):
                        i = np.flatnonzero(met & (share == s))
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s], pa.int32()), *(pa.array([v[i].tobytes()], pa.binary()) for v in (ids, x, limit.astype(np.float64)))], names=["part", "share", "ids", "vectors", "limits"])

    more = ["limit"] if with_limit else [probes] if isinstance(probes, str) else []
    columns = [F.col("query_id").cast("long"), vector_col, *more]
    return queries.where("query_id IS NOT NULL").select(*columns).mapInArrow(run, "part int, share int, ids binary, vectors binary, limits binary")


def _runs(n: int, width: int) -> Iterator[range]:
    """Runs of rows that make up a matrix of ``MATRIX`` numbers at most, if they are ``width`` wide."""
    step = max(1, MATRIX // max(1, width))
    yield from (range(k, min(k + step, n)) for k in range(0, n, step))


def _dealt(rows: DataFrame, parts: Parts, dims: int, vector_col: str, id_col: str, coded: bool) -> DataFrame:
    """Blocks (part, cells, ids, data, scales) of rows, a part each; data are vectors of length 1 or, if ``coded``, codes."""
    sent = rows.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _runs(batch.num_rows, 16 * dims):
                some = batch.slice(at.start, len(at))
                cell, ids = some.column(0).to_numpy(), some.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                if coded:
                    data, scale = np.frombuffer(b"".join(some.column(2).to_pylist()), np.int8).reshape(len(ids), -1), some.column(3).to_numpy()
                else:
                    data, scale = _unit(_matrix(some.column(2), dims))[0], np.zeros(0)
                part = sent.value.of(cell, ids)
                for one in np.unique(part).tolist():
                    i = np.flatnonzero(part == one)
                    yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (cell[i].astype(np.int32), ids[i], data[i], scale[i] if coded else scale))], names=["part", "cells", "ids", "data", "scales"])

    columns = ["code", "scale"] if coded else [vector_col]
    return rows.where(F.col(id_col).isNotNull()).select("cell", F.col(id_col).cast("long"), *columns).mapInArrow(run, "part int, cells binary, ids binary, data binary, scales binary")


class Best:
    """The k nearest rows met of each query, ties by id, and how near a row must be to be among them."""

    def __init__(self, k: int, bound: np.ndarray) -> None:
        self.k, self.bound, self.held, self.n = k, bound, [], 0

    def add(self, who: np.ndarray, far: np.ndarray, ids: np.ndarray, cell: int) -> None:
        """Distances of queries (rows) and rows of a cell (columns)."""
        near = far <= self.bound[who][:, None] + 10.0**-DIGITS
        if far.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * len(who):
            kth = np.partition(far, self.k - 1, axis=1)[:, self.k - 1]
            near = far <= np.minimum(kth, self.bound[who])[:, None] + 10.0**-DIGITS
        i, j = np.nonzero(near)
        if len(i):
            self.held.append(self._cut(who[i], far[i, j], ids[j], np.full(len(i), cell, np.int32)))
            self.n += len(self.held[-1][0])
            if self.n > FOUND:
                self.found()

    def _cut(self, who: np.ndarray, far: np.ndarray, ids: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, np.round(far, DIGITS) + 0.0, who))
        own = who[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        last = order[rank == self.k - 1]
        self.bound[who[last]] = np.minimum(self.bound[who[last]], far[last])
        return tuple(v[order[rank < self.k]] for v in (who, far, ids, cell))

    def found(self) -> tuple[np.ndarray, ...]:
        if self.held:
            self.held = [self._cut(*(np.concatenate(v) for v in zip(*self.held, strict=True)))]
            self.n = len(self.held[0][0])
            return self.held[0]
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)


def _met(rows: DataFrame, asked: DataFrame, k: int, cells: Cells, parts: Parts, shares: int, coded: bool, with_limit: bool) -> DataFrame:
    """(query_id, id, cell, score): the k nearest of each query in each part of the rows; of codes scores are approximate.

    A task holds one part of the rows and one share of the queries, which are of bounded size both.
    """
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)]
        if held.num_rows and asking.num_rows:
            c, who = sent.value, joined(asking, "ids", np.int64)
            q, limit = joined(asking, "vectors", np.float64).reshape(len(who), -1), joined(asking, "limits", np.float64)
            cell, ids = joined(held, "cells", np.int32), joined(held, "ids", np.int64)
            data, scale = joined(held, "data", np.int8 if coded else np.float64).reshape(len(ids), -1), joined(held, "scales", np.float64)
            order = np.argsort(cell, kind="stable")
            own, start = np.unique(cell[order], return_index=True)
            best = Best(k, limit.copy() if with_limit else np.full(len(who), np.inf))
            for at in _runs(len(who), len(c.centroids)):
                x = q[at.start : at.stop]
                wanted = c.possible(x, limit[at.start : at.stop]) if with_limit else c.within(x, limit[at.start : at.stop])
                for one, a, b in zip(own.tolist(), start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
                    asks = at.start + np.flatnonzero(wanted[:, one])
                    for r in _runs(b - a if len(asks) else 0, q.shape[1]):
                        i = order[a + r.start : a + r.stop]
                        y = c.centroids[one] + data[i] * scale[i][:, None] if coded else data[i]
                        for s in _runs(len(asks), len(i)):
                            best.add(asks[s.start : s.stop], 1 - q[asks[s.start : s.stop]] @ y.T, ids[i], one)
            found = best.found()
            out = [who[found[0]], found[2], found[3], found[1]]
        return pa.table(dict(zip(("query_id", "id", "cell", "score"), map(pa.array, out), strict=True)))

    tasks = min(4096, 4 * parts.count * shares)
    left = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, "part", "share")
    return left.groupBy("part", "share").cogroup(asked.repartition(tasks, "part", "share").groupBy("part", "share")).applyInArrow(meet, "query_id long, id long, cell int, score double")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, cells: Cells, k: int, probes: int | str = 8, exact: bool = True, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest rows of each query, distances to nine digits, ties by id.

    ``rows`` are ``assigned`` ones, ``queries`` hold query_id and the vector column. Cells are
    put together to parts of bounded size, and a share of the queries, bounded too, meets a part
    in one task, which compares cell by cell and keeps k rows of a query. With ``exact``, the
    ``probes`` nearest cells tell how near the k-th row is at most, and then every cell that may
    hold a row as near is read; else codes choose ``CANDIDATES`` x k rows of the nearest cells,
    whose distances are then computed. ``probes`` may be a column of ``queries``. Vectors that are
    null, zero, not finite or of another length take no part.
    """
    sound, dims = rows.where(F.col("cell") >= 0), cells.centroids.shape[1]
    counts = {r["cell"]: r["count"] for r in sound.groupBy("cell").count().collect() if r["cell"] < len(cells.centroids)}
    parts = Parts(counts, len(cells.centroids), max(1, min(PART // dims, max(LEAST, sum(counts.values()) // SPREAD))))
    shares = max(1, -(-queries.count() * dims // PART))
    if not exact:
        asked = _asked(queries, cells, parts, shares, probes, vector_col, False)
        codes = _dealt(sound, parts, dims, vector_col, id_col, True)
        close = _first(_met(codes, asked, CANDIDATES * k, cells, parts, shares, True, False), CANDIDATES * k)
        wanted = close.select("query_id", "id", "cell").join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector_col).alias("asked")), "query_id")
        met = sound.select(F.col(id_col).cast("long").alias("id"), "cell", F.col(vector_col).alias("met")).join(wanted, ["cell", "id"])
        found = met.select("query_id", "id", cosine_distance(F.col("asked"), F.col("met")).alias("score"))
    else:
        dealt = _dealt(sound, parts, dims, vector_col, id_col, False)
        near = _first(_met(dealt, _asked(queries, cells, parts, shares, probes, vector_col, False), k, cells, parts, shares, False, False), k)
        kth = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(F.lit(4.0)).alias("limit"))
        again = queries.join(kth, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(4.0)))
        found = _met(dealt, _asked(again, cells, parts, shares, probes, vector_col, True), k, cells, parts, shares, False, True)
    return _first(found, k).select("query_id", F.col("id").alias(id_col), "score", "rank")


def tuned(rows: DataFrame, queries: DataFrame, cells: Cells, k: int = 10, target: float = 0.95, vector_col: str = "embedding", id_col: str = "vec_id") -> tuple[int, float]:
    """The fewest cells to look in, of 1, 2, 4, ..., with which a search by codes finds ``target`` of the true neighbours of ``queries``, a bounded sample; and the recall that was measured."""
    sample, levels = queries.select(F.col("query_id").cast("long"), vector_col).collect(), [1]
    while levels[-1] < len(cells.centroids):
        levels.append(min(2 * levels[-1], len(cells.centroids)))
    truth = {(r["query_id"], r[id_col]) for r in search(rows, queries, cells, k, vector_col=vector_col, id_col=id_col).collect()}
    # a query for each number of cells, so that one search answers for all of them
    each = [(i * len(levels) + j, r[1], n) for i, r in enumerate(sample) for j, n in enumerate(levels)]
    kind = T.StructType([T.StructField("query_id", T.LongType()), queries.schema[vector_col], T.StructField("probes", T.LongType())])
    found: list[set] = [set() for _ in levels]
    for r in search(rows, rows.sparkSession.createDataFrame(each, kind), cells, k, "probes", False, vector_col, id_col).collect():
        found[r["query_id"] % len(levels)].add((sample[r["query_id"] // len(levels)]["query_id"], r[id_col]))
    recall = [len(f & truth) / len(truth) if truth else 1.0 for f in found]
    at = next((i for i, r in enumerate(recall) if r >= target), len(levels) - 1)
    return levels[at], recall[at]
