"""Embedding near-duplicates by spherical-cap filters from random product codes.

After a random rotation a vector is cut in four blocks; each block has a code of random
unit directions, and a filter is one direction of each block. A vector is decoded to the
list of all filters whose inner product with it exceeds the cap's height; this is exact,
by sorting the sums of two blocks and searching the other two. Vectors that share a filter
meet, and their cosine is computed in double precision. The code grows with the largest
label, so that a filter is expected to hold a few vectors whatever the size.

Filters that begin with the same blocks are one cell, which a vector goes to once: as few
blocks as keep a cell at about ``CELL`` vectors, so that vectors are copied little. A cell
that holds many is joined in pairs of parts. A pair is counted in the first cell that both
vectors are in, and a cell returns counts and a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.shared import materialise, release, table, width
from trawl.llm.trie_join import Forest

#: Filters a random vector is decoded to, on average and at least; vectors a filter and a cell are expected to hold; most rows of one part of a cell; rows compared at once.
FILTERS, LEAST_FILTERS, HELD, CELL, BLOCK, ROWS = 24, 6, 8, 2048, 4096, 256
#: Cells that a random vector is in, by the number of blocks that make a cell (measured, at most).
CELLS = {1: 4, 2: 8, 3: 18, 4: FILTERS}


class ProductCode:
    """The filters for vectors of one dimension: ``size`` directions in each of four blocks."""

    def __init__(self, dim: int, size: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dim, size])
        self.size, self.quarter = size, max(1, -(-dim // 4))
        full = 4 * self.quarter
        self.turn = np.linalg.qr(rng.standard_normal((full, full)))[0][:dim]
        code = rng.standard_normal((4, size, self.quarter))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True)
        trial = rng.standard_normal((64, dim))
        halves = [self._halves(v) for v in trial / np.linalg.norm(trial, axis=1, keepdims=True)]
        low, high = 0.0, 2.0
        for _ in range(40):
            mid = (low + high) / 2
            found = sum(float(np.searchsorted(-b, a - mid, side="right").sum()) for (a, _), (b, _) in halves)
            low, high = (mid, high) if found > FILTERS * len(halves) else (low, mid)
        self.height = low

    def _halves(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sums of blocks 1+2 and of 3+4, descending, with the directions they are of."""
        blocks = (unit @ self.turn).reshape(4, self.quarter)
        s = np.einsum("kq,kcq->kc", blocks, self.code)
        out = []
        for k in (0, 2):
            sums = (s[k][:, None] + s[k + 1][None, :]).ravel()
            order = np.argsort(-sums, kind="stable")
            out.append((sums[order], order))
        return out

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Numbers of all filters beyond the cap's height; at least the ``LEAST_FILTERS`` nearest."""
        (a, ia), (b, ib) = self._halves(unit)
        n = np.searchsorted(-b, a - self.height, side="right")
        if n.sum() < LEAST_FILTERS:
            k = min(LEAST_FILTERS, len(a))
            sums = (a[:k, None] + b[None, :k]).ravel()
            best = np.argsort(-sums, kind="stable")[:LEAST_FILTERS]
            return ia[best // k] * self.size**2 + ib[best % k]
        rows = np.flatnonzero(n)
        within = np.concatenate([np.arange(n[r]) for r in rows])
        return np.repeat(ia[rows], n[rows]) * self.size**2 + ib[within]


def code_size(largest: int) -> int:
    return max(2, int(np.ceil((max(1, largest) * FILTERS / HELD) ** 0.25)))


def cell_blocks(largest: int, size: int) -> int:
    """How many of a filter's blocks make a cell."""
    return next((k for k in CELLS if largest * CELLS[k] <= CELL * size**k), 4)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _decoded(nodes: DataFrame, size: int, blocks: int, seed: int) -> DataFrame:
    """Rows (label, dim, cell, cells, node, n, vector packed) of each node's cells; ``cells`` are all of a node's, packed."""
    label, single = nodes.schema["label"].dataType, nodes.schema["vector"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                vectors = [np.array(v, np.float64) for v in part.column("vector").to_pylist()]
                found = []
                for v in vectors:
                    if len(v) not in codes:
                        codes[len(v)] = ProductCode(len(v), size, seed)
                    scaled = v / np.abs(v).max()  # squares neither overflow nor vanish
                    filters = codes[len(v)].decode(scaled / np.linalg.norm(scaled))
                    found.append(np.unique(filters // size ** (4 - blocks)).astype(np.int64))
                pick = pa.array(np.repeat(np.arange(len(vectors)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(pick),
                        pa.array([len(v) for v in vectors], pa.int32()).take(pick),
                        pa.array(np.concatenate(found), pa.int64()),
                        pa.array([f.tobytes() for f in found], pa.binary()).take(pick),
                        part.column("node").take(pick),
                        part.column("n").take(pick),
                        pa.array([v.astype(kind).tobytes() for v in vectors], pa.binary()).take(pick),
                    ],
                    names=["label", "dim", "cell", "cells", "node", "n", "vector"],
                )
        release()

    return nodes.select("label", "node", "n", "vector").mapInArrow(run, f"label {label.simpleString()}, dim int, cell long, cells binary, node long, n long, vector binary")


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def _verified(cosine: float):
    """The step from rows sorted by cell to rows (a, m, b): how many rows a cell's links lead to from node a, or a link of its forest from a to b."""

    def links(cell: int, alone: bool, rows: list[tuple]) -> pa.RecordBatch | None:
        side, node, n, raw, cells = zip(*rows, strict=True)
        dim = len(raw[0])
        x = np.frombuffer(b"".join(raw), np.float32 if dims[0] * 4 == dim else np.float64).reshape(len(rows), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        side, node, n = np.array(side), np.array(node), np.array(n)
        a = np.flatnonzero(~side)
        b = a if alone else np.flatnonzero(side)
        if not len(a) or not len(b):
            return None
        norms, earlier = np.sqrt((x * x).sum(axis=1)), _padded([f[f < cell] for f in (np.frombuffer(c, np.int64) for c in cells)])
        order = np.argsort(node)
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        forest, m = Forest(len(node)), np.zeros(len(node), np.int64)
        for start in range(0, len(a), ROWS):
            own = a[start : start + ROWS]
            near = x[own] @ x[b].T / (norms[own][:, None] * norms[b][None, :]) >= cosine
            u, v = np.nonzero(near)
            u, v = own[u], b[v]
            if alone:
                u, v = u[u < v], v[u < v]
            for k in range(0, len(u), 1 << 16):
                p, q = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
                met = np.zeros(len(p), bool)  # in an earlier cell
                for c in range(earlier.shape[1]):
                    mine = earlier[p, c]
                    met |= (mine >= 0) & (earlier[q] == mine[:, None]).any(axis=1)
                p, q = p[~met], q[~met]
                np.add.at(m, p, n[q])
                np.add.at(m, q, n[p])
                forest.add(rank[p], rank[q])
        i, j = forest.pairs()
        some = np.flatnonzero(m)
        if not len(some):
            return None
        nulls = lambda k: pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[some], node[order][i]])),
                pa.concat_arrays([pa.array(m[some]), nulls(len(i))]),
                pa.concat_arrays([nulls(len(some)), pa.array(node[order][j])]),
            ],
            names=["a", "m", "b"],
        )

    dims: list[int] = [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                dims[0] = key[1]
                if found := links(key[2], key[3] == key[4], rows):
                    yield found

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "dim", "cell", "i", "j", "side", "node", "n", "vector", "cells")]
            for *mine, side, node, n, vector, cells in zip(*columns, strict=True):
                if mine != key:
                    yield from out()
                    key, rows = mine, []
                rows.append((side, node, n, vector, cells))
        yield from out()
        release()

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, seed: int = 7) -> DataFrame:
    """Per row of ``df``: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows are compared when labels are equal and not null. Vectors that are null, zero or
    hold null or non-finite components link with nothing, and vectors of other lengths
    do not link. Equal vectors of a label are one node with a count.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    usable = F.coalesce(F.col("label").isNotNull() & _usable(F.col("vector")), F.lit(False))
    good = rows.where(usable)
    nodes = good.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest = nodes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    size = code_size(largest)
    found = _decoded(nodes, size, cell_blocks(largest, size), seed)
    cell = ["label", "dim", "cell"]
    hot = materialise(found.groupBy(*cell).count().where(F.col("count") > BLOCK).withColumn("parts", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"), "hot")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = found.join(hot, cell, "left").withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "node", "n", "vector", "cells")
    cell = [*cell, "i", "j"]
    met = materialise(dealt.repartition(width(spark), *cell).sortWithinPartitions(*cell).mapInArrow(_verified(cosine), "a long, m long, b long"), "links")
    roots = components(met.where("b IS NOT NULL").select("a", "b"))
    counts = met.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("m"))
    known = nodes.join(counts, "node", "left").join(roots, "node", "left")
    known = materialise(known.select("label", "vector", "least", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    least = materialise(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = materialise(known.join(least, "root").select("label", "vector", "n_links", "component_id"), "known")
    linked = good.join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked at cosine 0.98 within their label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_cap_filters": op1_cap_filters}

ORACLE_SQL = {
    "op1_cap_filters": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach AS (
  SELECT a AS x, a AS y FROM links
  UNION
  SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.m, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.m, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = e.vec_id
"""
}
