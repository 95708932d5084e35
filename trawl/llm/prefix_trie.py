"""The trie of conversations by shared first turns: which prefixes occur, who has them, what sharing them saves.

1. ``scanned`` sorts turns into ranges, so that a conversation of any length lies in as many
   tasks as it needs, and numbers them with a rolling polynomial fingerprint of the turns so far.
2. Equal depth and fingerprint make a candidate node. Every member's last turn is compared
   with that of the representative, which has the smallest id; members that differ are split
   off, with all that follows. Since a fingerprint and its last turn give the one before, turns
   that agree at each depth are prefixes that agree.
3. Counts roll up to parents in two sums: a node's worth goes to its representative, is summed
   along this conversation from its end, and then over the members of each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import materialise, struct, table, width

#: Two primes below 2^31, so that products fit in 64 bits, and the bases of the polynomials.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_220_703_125)
#: Ids of one piece of a list of members, and depths of one block of a sum, as powers of two.
PIECE, BLOCK = 12, 16
NODE = ["depth", "f", "path"]


# ---- 1: positions and fingerprints


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1)."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def scan(key: np.ndarray, hashes: np.ndarray, before: tuple[int, list[int]], primes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Position of each row in its run of equal keys, and sums of hash x base^position up to it, for each prime.

    ``before`` has the length and sums of the run that the first row goes on with.
    """
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    within = np.arange(len(key)) - starts[run]
    first, sums = run == 0, []
    for prime, base, held in zip(primes, BASES, before[1], strict=True):
        p = np.uint64(prime)
        terms = hashes % p * _powers(base, prime, int(within.max()) + 1)[within] % p
        terms = np.where(first, terms * np.uint64(pow(base, before[0], prime)) % p, terms)
        total = np.cumsum(terms)
        total = (total - np.concatenate([[np.uint64(0)], total])[starts][run]) % p
        sums.append(np.where(first, (total + np.uint64(held)) % p, total))
    return within + np.where(first, before[0], 0) + 1, sums


def _packed(parts: list[Column]) -> Column:
    return F.shiftleft(parts[0], 31).bitwiseOR(parts[1])


def scanned(turns: DataFrame, order: str, ties: list[str], primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``turns`` (conv, role, text, ``order``) with depth from 1, f and before: fingerprints with and without the turn.

    Rows are dealt in ranges of conversation and ``order`` (null first) and sorted by ``ties`` as
    well. Ranges begin within a conversation where it is long; what the earlier ranges hold of
    it, one row a range, is added afterwards.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in turns.schema.fields if f.name != order]
    schema = T.StructType([*kept, *struct(part="long", pos="long", a="long", b="long", hash="long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, (0, [0, 0])
        for batch in batches:
            if not batch.num_rows:
                continue
            key, hashes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("conv", "hash"))
            pos, sums = scan(key, hashes.view(np.uint64), held if key[0] == last else (0, [0, 0]), primes)
            last, held = key[-1], (int(pos[-1]), [int(s[-1]) for s in sums])
            numbers = [np.full(len(key), part), pos, *sums, hashes]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(x.astype(np.int64)) for x in numbers)], schema=arrow)

    spark = turns.sparkSession
    sorted_ = turns.withColumn("hash", F.xxhash64("role", "text")).repartitionByRange(width(spark), F.col("conv"), F.asc_nulls_first(order))
    sorted_ = sorted_.sortWithinPartitions("conv", F.asc_nulls_first(order), *ties)
    local = materialise(sorted_.mapInArrow(run, schema), "turns")
    # the end of each range's last conversation, and the conversation that it begins with: a row a range
    ends = local.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos", "a", "b")).alias("last")).collect()
    carried, open_ = [], None
    for e in sorted(ends):
        if open_ is not None and open_[0] != e["first"]:
            open_ = None
        if open_ is not None:
            carried.append((e["part"], *open_, *(pow(b, open_[1], p) for b, p in zip(BASES, primes, strict=True))))
        at = e["last"]
        if open_ is None or at["conv"] != open_[0]:
            open_ = (at["conv"], at["pos"], at["a"], at["b"])
        else:
            open_ = (at["conv"], open_[1] + at["pos"], *((open_[2 + k] + pow(BASES[k], open_[1], primes[k]) * at["ab"[k]]) % primes[k] for k in (0, 1)))
    carry = spark.createDataFrame(carried, "part long, conv long, n long, ca long, cb long, pa long, pb long")
    rows = local.join(F.broadcast(carry), ["part", "conv"], "left")  # a row a range at most
    depth = F.col("pos") + F.coalesce("n", F.lit(0))
    sums = [F.when(F.col("n").isNull(), F.col(x)).otherwise((F.col(f"c{x}") + F.col(f"p{x}") * F.col(x)) % p) for x, p in zip("ab", primes, strict=True)]
    power = [_power(depth - 1, b, p) for b, p in zip(BASES, primes, strict=True)]
    found = rows.select(*[f.name for f in kept if f.name != "hash"], depth.alias("depth"), *(s.alias(x) for s, x in zip(sums, "ab", strict=True)), *(x.alias(f"p{k}") for x, k in zip(power, "ab", strict=True)), "hash")
    term = [_unsigned_mod(F.col("hash"), p) * F.col(f"p{x}") % p for x, p in zip("ab", primes, strict=True)]
    earlier = [F.pmod(F.col(x) - t, F.lit(p)) for x, t, p in zip("ab", term, primes, strict=True)]
    return found.select(*[f.name for f in kept if f.name != "hash"], "depth", _packed([F.col("a"), F.col("b")]).alias("f"), _packed(earlier).alias("before"))


def _unsigned_mod(h: Column, prime: int) -> Column:
    """A long's 64 bits as an unsigned number, modulo ``prime``."""
    return (F.shiftrightunsigned(h, 32) % prime * ((1 << 32) % prime) + h.bitwiseAND(0xFFFFFFFF) % prime) % prime


def _power(n: Column, base: int, prime: int) -> Column:
    """base^n mod prime, eight bits of n at a time."""
    out = F.lit(1).cast("long")
    for k in range(0, 40, 8):
        digits = F.array(*(F.lit(pow(base, d << k, prime)) for d in range(256)))
        out = out * F.get(digits, F.shiftrightunsigned(n, k).bitwiseAND(255).cast("int")) % prime
    return out


# ---- 2: verification


def verified(turns: DataFrame) -> DataFrame:
    """``turns`` of ``scanned`` as (conv, chars, depth, f, path, before, before_path), where depth, f and path tell nodes apart.

    ``path`` is empty but for members that were split from their representative: it then names
    each depth at which they differ and how.
    """
    last = turns.groupBy("depth", "f", "role", "text").agg(F.min("conv").alias("first"))  # copies meet before they are shuffled
    seen = materialise(last, "turn-variants")
    several = seen.groupBy("depth", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("depth", "f")
    by_first = Window.partitionBy("depth", "f").orderBy("first", "role", "text")
    differ = seen.join(several, ["depth", "f"], "left_semi").withColumn("split", F.row_number().over(by_first) - 1).where("split > 0")
    differ = materialise(differ.select("depth", "f", "role", "text", "split"), "collisions", share=16)
    split = turns.join(differ, ["depth", "f", "role", "text"]).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "split"))).alias("splits"))
    split = materialise(split, "split-members", share=16)
    rows = turns.select("conv", F.char_length("text").cast("long").alias("chars"), "depth", "f", "before").join(split, "conv", "left")

    def path(depth: Column) -> Column:
        there = F.filter("splits", lambda x: x["depth"] <= depth)
        return F.coalesce(F.array_join(F.transform(there, lambda x: F.concat_ws(":", x["depth"], x["split"])), ","), F.lit(""))

    return rows.select("conv", "chars", "depth", "f", path(F.col("depth")).alias("path"), "before", path(F.col("depth") - 1).alias("before_path"))


# ---- 3: rollup


def _along(chains: DataFrame) -> DataFrame:
    """``chains`` with saved and leaves summed over a representative's nodes from the deepest up to each; blocks of depths first, so that no task has a whole long conversation."""
    blocks = chains.withColumn("block", F.shiftright("depth", BLOCK))
    below = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    totals = totals.select("conv_id", "block", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in "sl"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = blocks.select("*", *(F.sum(c).over(within).alias(f"{c}_within") for c in ("saved", "leaves")))
    return own.join(totals, ["conv_id", "block"]).withColumns({"saved": F.col("saved_within") + F.col("s_below"), "leaves": F.col("leaves_within") + F.col("l_below")})


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, f, path, ends_sha256) of the ids that end at each node, ascending and joined by commas: pieces are sorted by themselves, then hashed as they come."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(ends.schema[c] for c in NODE), T.StructField("ends_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            out = []
            for *at, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if key is not None:
                        out.append([*key, h.hexdigest()])
                    key, h = at, hashlib.sha256(piece.encode())
                else:
                    h.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=arrow)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in [*key, h.hexdigest()]], schema=arrow)

    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = ends.groupBy(*NODE, F.shiftright("conv", PIECE).alias("at")).agg(F.array_join(ids, ",").alias("piece"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "at").select(*NODE, "piece")
    return dealt.mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, conversations: DataFrame, order: str, ties: list[str] = (), primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for every distinct sequence of first turns (role, text) of ``turns`` (conv, role, text, ``order``), the empty one included.

    conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_children,
    n_leaves (nodes without children in the subtree), saved_tokens (over the subtree, members
    but one times code points of the last text) and ends_sha256 (of the ids of members that end
    here). ``conversations`` (conv) has all members, those without turns as well.

    Null ids are no conversations, null roles and texts are empty ones; equal ``order`` is decided
    by ``ties``, and rows that repeat are turns of their own. Texts may be of any length.
    No conversations, no nodes.
    """
    rows = turns.where("conv IS NOT NULL").select(F.col("conv").cast("long").alias("conv"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), order)
    members = materialise(verified(scanned(rows, order, list(ties), primes)), "members")
    everyone = materialise(conversations.where("conv IS NOT NULL").select(F.col("conv").cast("long").alias("conv")).distinct(), "conversations")
    root = everyone.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    none = {"depth": F.lit(0).cast("long"), "f": F.lit(0).cast("long"), "path": F.lit("")}
    root = root.withColumns(none | {"chars": F.lit(0).cast("long"), "before": F.lit(None).cast("long"), "before_path": F.lit(None).cast("string")})
    counted = members.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"), F.first("before").alias("before"), F.first("before_path").alias("before_path"))
    nodes = materialise(counted.unionByName(root), "nodes")

    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("before").alias("f"), F.col("before_path").alias("path"))
    children = up.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("before"), F.col("path").alias("before_path"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, NODE, "left").join(parents, ["depth", "before", "before_path"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    worth = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("chars"), "leaves": (F.col("n_children") == 0).cast("long")})
    worth = materialise(_along(worth).select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "saved", "leaves"), "chains")

    # a representative's nodes go on to its end; above the first of them others represent, which get all of it
    whole = worth.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("saved").alias("saved"), F.max("leaves").alias("leaves")).withColumnRenamed("conv_id", "conv")
    above = members.join(whole, "conv").where(F.col("depth") < F.col("top"))
    at_root = whole.where("top > 0").select(*(v.alias(k) for k, v in none.items()), "saved", "leaves")
    above = above.select(*NODE, "saved", "leaves").unionByName(at_root).groupBy(*NODE).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))

    ends = members.groupBy("conv").agg(F.max(F.struct(*NODE)).alias("end")).select("conv", *(f"end.{c}" for c in NODE))
    turnless = everyone.join(ends.select("conv"), "conv", "left_anti").select("conv", *(v.alias(k) for k, v in none.items()))
    ends = _end_hashes(ends.unionByName(turnless))
    out = worth.join(above, NODE, "left").join(ends, NODE, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("more", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


# ---- the query


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, role, text, pos): the first h turns of conversation c - c % 100, then the own ones after the first h; h = crc32(c) % 6."""
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = materialise(scanned(rows, "turn", ["role", "text"]).select("conv", "role", "text", F.col("depth").alias("pos")), "numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    asked = rows.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % 100).alias("head"), h.alias("h"))
    heads = rows.where((F.col("pos") < 6) & (F.col("conv") % 100 == 0)).select(F.col("conv").alias("head"), "role", "text", "pos")
    lent = asked.join(heads, "head").where("pos <= h").select("conv", "role", "text", "pos")
    return rows.where(F.col("pos") > h).unionByName(lent)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, each rebuilt to share the beginning of another."""
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie(rebuilt(turns), turns.select(F.col("conv_id").alias("conv")), "pos")


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {
    "op13_prefix_trie": """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), convs AS (  -- h: CRC-32 of the decimal digits, bit by bit
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
         lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT convs.c, pos, role, text FROM convs JOIN turns ON turns.c = convs.c - convs.c % 100 AND pos <= h
  UNION ALL SELECT convs.c, pos, role, text FROM convs JOIN turns ON turns.c = convs.c AND pos > h
), sequences AS (SELECT convs.c, coalesce(s, []) AS s FROM convs LEFT JOIN (SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS s FROM rebuilt GROUP BY c) r ON r.c = convs.c
), members AS (SELECT c, s[1:d] AS s, d, len(s) AS n FROM sequences, unnest(range(0, len(s) + 1)) AS x(d)
), nodes AS (SELECT s, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM members GROUP BY s, d
), linked AS (SELECT x.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes y WHERE y.d = x.d + 1 AND y.s[1:x.d] = x.s) AS n_children FROM nodes x LEFT JOIN nodes p ON p.d = x.d - 1 AND p.s = x.s[1:x.d - 1]
), tops AS (SELECT s[1:k] AS s, k AS d, (n_convs - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(s[d].text) END) AS saved, (n_children = 0)::BIGINT AS leaf FROM linked, unnest(range(0, d + 1)) AS x(k)
), sums AS (SELECT s, d, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM tops GROUP BY s, d)
SELECT conv_id, l.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM linked l JOIN sums ON sums.d = l.d AND sums.s = l.s"""
}
