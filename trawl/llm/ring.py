"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``CELLS`` equal cells; ``vnodes`` virtual nodes per shard are
hashed onto it, and a cell belongs to the next virtual node clockwise. A row's ring
point is the hash of its text, so equal texts start in the same cell and stay
neighbours. A shard takes the rows of its own cells up to its capacity; rows beyond it
continue clockwise to the next shard that has room. With ``spare=0`` the capacities are
the floor and ceiling of rows/shards, so that row counts differ by one at most.

Only numbers per cell (``CELLS`` of them, however many rows there are) reach the driver,
where they become the ring plan: which ranks of which cell go to which shard. Rows are
ranked inside a cell by small numbered parts, so a cell that holds a third of all rows
is ranked by many tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.llm.shared import materialise, table

CELL_BITS = 12
CELLS = 1 << CELL_BITS
#: At most this many parts of cells besides one a cell, and rows in a part of a small table.
PARTS, LEAST_PART = 20_000, 512


def cell_owners(shards: int, vnodes: int) -> list[int]:
    """The shard that owns each cell; adding a shard only takes cells for it."""
    placed: dict[int, tuple[bytes, int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=12).digest()
            at = int.from_bytes(digest[:4], "big") % CELLS
            placed[at] = min(placed.get(at, (digest, s)), (digest, s))
    owner = placed[min(placed)][1]
    owners = [0] * CELLS
    for c in reversed(range(CELLS)):
        owner = placed[c][1] if c in placed else owner
        owners[c] = owner
    return owners


def capacities(rows: int, shards: int, spare: float) -> list[int]:
    """Rows each shard may hold: exact shares at ``spare=0``, else a common bound."""
    if spare > 0:
        return [int(-(-rows * (1 + spare) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def ring_plan(counts: dict[int, int], shards: int, vnodes: int = 64, spare: float = 0.0) -> list[dict]:
    """Segments ``(cell, lo, hi, shard, slot)``: ranks lo..hi-1 of the cell get the shard's slots from slot on."""
    owners, room = cell_owners(shards, vnodes), capacities(sum(counts.values()), shards, spare)
    filled, over, out = [0] * shards, {}, []

    def give(cell: int, lo: int, most: int, shard: int) -> int:
        n = min(most, room[shard] - filled[shard])
        if n > 0:
            out.append({"cell": cell, "lo": lo, "hi": lo + n, "shard": shard, "slot": filled[shard]})
            filled[shard] += n
        return max(n, 0)

    for cell in sorted(counts):
        kept = give(cell, 0, counts[cell], owners[cell])
        if kept < counts[cell]:
            over[cell] = (kept, counts[cell])
    carried: deque[tuple[int, int, int]] = deque()
    for step in range(2 * CELLS):
        cell = step % CELLS
        while carried and (n := give(carried[0][0], carried[0][1], carried[0][2] - carried[0][1], owners[cell])):
            origin, lo, hi = carried.popleft()
            if lo + n < hi:
                carried.appendleft((origin, lo + n, hi))
        if step < CELLS and cell in over:
            carried.append((cell, *over[cell]))
        if step >= CELLS and not carried:
            break
    for origin, lo, hi in carried:  # shards without any cell of their own
        for shard in range(shards):
            lo += give(origin, lo, hi - lo, shard)
    return out


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal, without any Python on executors."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, vnodes: int = 64, spare: float = 0.0, overhead: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot.

    A null text counts as empty; a null id is an id like any other. Repeated rows each
    get a slot. An empty table gives an empty result. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("point"),
    ).withColumn("cell", F.shiftrightunsigned("point", 64 - CELL_BITS).cast("int"))
    base = materialise(base, "ring")
    counts = {r["cell"]: r["count"] for r in base.groupBy("cell").count().collect()}  # CELLS rows at most
    total = sum(counts.values())
    part = max(LEAST_PART, total // PARTS)
    plan = F.broadcast(_rows(spark, ring_plan(counts, shards, vnodes, spare), "cell:int,lo:bigint,hi:bigint,shard:int,slot:bigint"))  # two rows a cell and shard at most
    parts = F.broadcast(_rows(spark, [{"cell": c, "parts": 1 + n // part} for c, n in counts.items()], "cell:int,parts:int"))
    rows = base.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id", "point", F.lit(8)), F.col("parts")).cast("int"))
    before = Window.partitionBy("cell").orderBy("part")
    starts = rows.groupBy("cell", "part").count().withColumn("start", F.sum("count").over(before) - F.col("count"))  # CELLS + PARTS rows at most
    within = Window.partitionBy("cell", "part").orderBy("point", "id", "size", "crc")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(starts.drop("count")), ["cell", "part"]).withColumn("rank", F.col("rank") + F.col("start"))
    placed = ranked.join(plan, (ranked["cell"] == plan["cell"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"]))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"))


def op8_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, row counts one apart at most."""
    rows = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_ring": op8_ring}
