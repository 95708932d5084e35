"""Hamming self-join of fingerprints by traversing pairs of binary trie nodes together.

A fingerprint's bits are cut in ``errors + 1`` blocks. Two that differ in ``errors`` bits at
most are equal in one block at least, so each fingerprint stands in ``errors + 1`` tries, each
of the bits with one block drawn to the front, whatever the number of rows. What lies below
one value of the front block is a cell: it is joined with itself by going down the trie in
pairs of nodes that carry the number of bits in which their paths differ; pairs beyond the
error budget are dropped, and the frontier is cut in pieces so that memory is bounded. A pair
that is equal in several blocks is taken where the first of them is in front.

Cells are dealt out to buckets, packed, and a bucket is one task's group. A cell of more than
``CELL`` rows is dealt out to parts, and its pairs of parts are cells. A bucket returns a
spanning forest of the links it found, not the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import release, width

#: Rows of a cell that is not parted, and of a bucket, about; node pairs held at once; element pairs of two nodes
#: that are compared at once instead of going further down.
CELL, HELD, LEAF = 1 << 18, 1 << 17, 32
#: Links in doubt that are held before only a nearest spanning forest of them is kept.
KEPT = 1 << 19
#: Rows that are dealt out at once; buckets for each shuffle partition at least, so that hashed buckets lie evenly.
DEALT, BUCKETS_EACH = 8192, 4


def sub_prints(lanes: np.ndarray, table: int, bits: int) -> np.ndarray:
    """Bits ``table*bits`` .. of each row of ``lanes`` (n x words, uint64), at the top of an uint64."""
    first, shift = divmod(table * bits, 64)
    out = lanes[:, first] << np.uint64(shift)
    if shift and shift + bits > 64:
        out = out | lanes[:, first + 1] >> np.uint64(64 - shift)
    return out & np.uint64(((1 << bits) - 1) << (64 - bits))


def block_ends(bits: int, errors: int) -> list[int]:
    """Where blocks start and end: ``errors + 1`` blocks of nearly equal length."""
    return [bits * k // (errors + 1) for k in range(errors + 2)]


def _top(x: np.ndarray, n: int) -> np.ndarray:
    return x & np.uint64(((1 << n) - 1) << (64 - n)) if n else np.zeros_like(x)


def block_first(prints: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of bits from ``start`` to ``stop``, as numbers, and the other bits in their order, at the top."""
    block = (prints << np.uint64(start)) >> np.uint64(64 - (stop - start))
    after = (prints << np.uint64(stop)) >> np.uint64(start) if stop < 64 else np.zeros_like(prints)
    return block.astype(np.int64), _top(prints, start) | after


class Forest:
    """Spanning forest of links among n nodes, fed in bulk."""

    def __init__(self, n: int) -> None:
        self.label, self.links = np.arange(n), []

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((v, u, low, high))
            first = np.concatenate([[True], np.diff(high[order]) != 0])
            take = order[first]  # each root hooks onto one lower root: no circles
            self.links.append((u[take], v[take]))
            label[high[take]] = low[take]
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
            self.label = label

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(x[k] for x in self.links)]) for k in (0, 1))


Pieces = Iterator[tuple[np.ndarray, np.ndarray]]


def near_pairs(prints: np.ndarray, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], bits: int, errors: int, same: Callable[[int, int, int, int], bool] | None = None) -> Pieces:
    """Index pairs u < v of ``prints`` that differ in ``errors`` bits at most, in pieces.

    ``first``, ``second``: where the nodes that the traversal starts with start and stop, pair by
    pair: the same node, or one that lies before the other; prints are sorted within each.
    ``same`` tells of two large nodes whether all their pairs may be passed over from now on.
    """
    ones: dict[int, np.ndarray] = {}

    def middle(start: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
        """Where the prints of each node begin that have a 1 next."""
        if depth not in ones:
            bit = (prints >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
        return stop - (ones[depth][stop] - ones[depth][start])

    sa, ea, sb, eb = (np.asarray(x, np.int32) for x in (*first, *second))
    stack = [(0, sa, ea, sb, eb, np.zeros(len(sa), np.int8))]
    while stack:
        d, *front = stack.pop()
        if len(front[0]) > HELD:
            for i in range(0, len(front[0]), HELD // 2):
                stack.append((d, *(x[i : i + HELD // 2] for x in front)))
            continue
        sa, ea, sb, eb, err = front
        n = (ea - sa).astype(np.int64) * (eb - sb)
        leaf = n <= LEAF if d < bits else np.ones(len(n), bool)
        if leaf.any():
            yield from _leaves(prints, sa[leaf], ea[leaf], sb[leaf], eb[leaf], errors, same)
        sa, ea, sb, eb, err = (x[~leaf] for x in (sa, ea, sb, eb, err))
        if not len(sa):
            continue
        ma, mb = middle(sa, ea, d), middle(sb, eb, d)
        own, spare = sa == sb, err < errors
        parts = []
        for x0, x1, y0, y1, ok, more in ((sa, ma, sb, mb, True, 0), (ma, ea, mb, eb, True, 0), (sa, ma, mb, eb, spare, 1), (ma, ea, sb, mb, spare & ~own, 1)):
            ok = ok & (x1 > x0) & (y1 > y0)
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], err[ok] + np.int8(more)))
        stack.append((d + 1, *(np.concatenate([p[k] for p in parts]) for k in range(5))))


def _leaves(prints: np.ndarray, sa: np.ndarray, ea: np.ndarray, sb: np.ndarray, eb: np.ndarray, errors: int, same: Callable[[int, int, int, int], bool] | None) -> Pieces:
    """Pairs of leaf pairs that are near enough; a large leaf pair row by row, first one row, then as many as are held."""
    ca, cb = (ea - sa).astype(np.int64), (eb - sb).astype(np.int64)
    n = ca * cb
    large = n > HELD
    for s, e, t, f in zip(sa[large].tolist(), ea[large].tolist(), sb[large].tolist(), eb[large].tolist(), strict=True):
        i, step = s, 1
        while i < e and not (same and same(s, e, t, f)):
            rows = np.arange(i, min(i + step, e))
            u, v = (x.ravel() for x in np.meshgrid(rows, np.arange(t, f), indexing="ij"))
            yield _near(prints, u, v, errors)
            i, step = i + step, max(1, HELD // (f - t))
    sa, sb, cb, n = sa[~large], sb[~large], cb[~large], n[~large]
    piece = np.cumsum(n) // HELD
    for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(piece)) + 1):
        if len(cut):
            k = n[cut]
            within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            wide = np.repeat(cb[cut], k)
            yield _near(prints, np.repeat(sa[cut], k) + within // wide, np.repeat(sb[cut], k) + within % wide, errors)


def _near(prints: np.ndarray, u: np.ndarray, v: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    ok = u < v
    u, v = u[ok], v[ok]
    ok = np.bitwise_count(prints[u] ^ prints[v]) <= errors
    return u[ok], v[ok]


class Shape:
    """What fingerprints are compared by: ``tables`` ranges of ``bits`` bits, ``errors`` of a range, limits in all bits."""

    def __init__(self, words: int, errors: int, tables: int = 1, bits: int = 64, most: tuple[int, ...] = ()) -> None:
        self.words, self.errors, self.tables, self.bits, self.most = words, errors, tables, bits, most
        self.ends = block_ends(bits, errors)
        self.blocks = errors + 1
        self.copies = tables * self.blocks
        self.wide = max(b - a for a, b in zip(self.ends, self.ends[1:], strict=False))
        self.entry = np.dtype([("cell", "<u4"), ("own", "<u2"), ("i", "<u2"), ("j", "<u2"), ("node", "<i8"), ("label", "<i8"), ("size", "<u4"), ("lanes", "<u8", (words,))])
        if (self.copies << self.wide) > 1 << 32:
            raise ValueError("fingerprints have too many blocks, or too long ones")

    def cells(self, lanes: np.ndarray) -> np.ndarray:
        """Numbers of the cells of each row, rows x copies."""
        out = np.empty((len(lanes), self.copies), np.uint32)
        for t in range(self.tables):
            sub = sub_prints(lanes, t, self.bits)
            for k in range(self.blocks):
                c = t * self.blocks + k
                out[:, c] = block_first(sub, self.ends[k], self.ends[k + 1])[0] + (c << self.wide)
        return out

    def rest(self, lanes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The bits that a cell's rows may differ in."""
        out, which = np.zeros(len(lanes), np.uint64), cell.astype(np.int64) >> self.wide
        for c in np.unique(which).tolist():
            at, k = np.flatnonzero(which == c), c % self.blocks
            out[at] = block_first(sub_prints(lanes[at], c // self.blocks, self.bits), self.ends[k], self.ends[k + 1])[1]
        return out

    def first_met(self, lanes: np.ndarray, rest: np.ndarray, cell: np.ndarray, u: np.ndarray, v: np.ndarray, tables: bool) -> np.ndarray:
        """Whether no earlier block, nor with ``tables`` an earlier table, brings the pairs together, too."""
        which = cell[u].astype(np.int64) >> self.wide
        block, x, ok = which % self.blocks, rest[u] ^ rest[v], np.ones(len(u), bool)
        for k in range(self.blocks - 1):
            a, b = self.ends[k], self.ends[k + 1]
            ok &= ~((block > k) & ((x << np.uint64(a)) >> np.uint64(64 - (b - a)) == 0))
        for t in range(self.tables - 1 if tables else 0):
            later = np.flatnonzero(ok & (which // self.blocks > t))
            if len(later):
                apart = np.bitwise_count(sub_prints(lanes[u[later]], t, self.bits) ^ sub_prints(lanes[v[later]], t, self.bits))
                ok[later[apart <= self.errors]] = False
        return ok


def _sets(raw: bytes, size: np.ndarray) -> list[np.ndarray]:
    return np.split(np.frombuffer(raw, np.uint64), np.cumsum(size.astype(np.int64))[:-1])


def _bucket_links(shape: Shape, rows: np.ndarray, sets: list[np.ndarray] | None, alike: Callable[[np.ndarray, np.ndarray], bool] | None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket's rows: a spanning forest, of near links first. With ``sets`` only links that ``alike`` confirms."""
    side = rows["own"] != rows["i"]
    rest = shape.rest(rows["lanes"], rows["cell"])
    order = np.lexsort((rows["node"], rest, side, rows["j"], rows["i"], rows["cell"]))
    rows, rest, side = rows[order], rest[order], side[order]
    lanes, cell = rows["lanes"], rows["cell"]
    key = rows["cell"].astype(np.int64) << 32 | rows["i"].astype(np.int64) << 16 | rows["j"]
    group = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(side) != 0)]))
    stop = np.append(group[1:], len(rows))
    alone = rows["i"][group] == rows["j"][group]
    cross = np.flatnonzero(~alone[:-1] & ~alone[1:] & (key[group[:-1]] == key[group[1:]])) if len(group) > 1 else np.zeros(0, np.int64)
    one, two = np.concatenate([np.flatnonzero(alone), cross]), np.concatenate([np.flatnonzero(alone), cross + 1])

    known, mine = np.unique(rows["label"] if sets else rows["node"], return_inverse=True)  # links join nodes, or what is joined already
    close, least = Forest(len(known)), (shape.most or (0,))[0]
    doubt = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int64)]
    confirmed: list[tuple[int, int]] = []

    def same(s: int, e: int, t: int, f: int) -> bool:
        one_label = close.label[mine[s]]
        return bool((close.label[mine[s:e]] == one_label).all() and (close.label[mine[t:f]] == one_label).all())

    def nearest(u: np.ndarray, v: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of links in doubt a spanning forest beyond the sure ones, nearer ones first; or those confirmed, one by one."""
        if sets is not None:
            for k in np.lexsort((v, u, far)).tolist():
                a, b = int(u[k]), int(v[k])
                if close.label[mine[a]] != close.label[mine[b]] and alike(sets[order[a]], sets[order[b]]):
                    close.add(mine[[a]], mine[[b]])
                    confirmed.append((a, b))
            return u[:0], v[:0], far[:0]
        held = Forest(len(known))
        held.label = close.label.copy()
        out, below = [], -1
        where = np.full(len(known), -1)
        where[mine] = np.arange(len(mine))
        for limit in shape.most:
            at = (far > below) & (far <= limit)
            before = len(held.links)
            held.add(mine[u[at]], mine[v[at]])
            new = [np.concatenate([x[k] for x in held.links[before:]]) if held.links[before:] else np.zeros(0, np.int64) for k in (0, 1)]
            out.append((where[new[0]], where[new[1]], np.full(len(new[0]), limit)))
            below = limit
        return tuple(np.concatenate([x[k] for x in out]) for k in range(3))

    for u, v in near_pairs(rest, (group[one], stop[one]), (group[two], stop[two]), shape.bits - min(b - a for a, b in zip(shape.ends, shape.ends[1:], strict=False)), shape.errors, same):
        apart = close.label[mine[u]] != close.label[mine[v]]
        u, v = u[apart], v[apart]
        if len(u):
            at = shape.first_met(lanes, rest, cell, u, v, False)
            u, v = u[at], v[at]
        far = np.zeros(len(u), np.int64)
        if shape.most and len(u):
            for w in range(shape.words):
                far += np.bitwise_count(lanes[u, w] ^ lanes[v, w])
            at = far <= shape.most[-1]
            u, v, far = u[at], v[at], far[at]
        if sets is not None and len(u):
            at = shape.first_met(lanes, rest, cell, u, v, True)  # each pair is confirmed in one cell of all
            u, v, far = u[at], v[at], far[at]
            sure = np.zeros(len(u), bool)
        else:
            sure = far <= least
        close.add(mine[u[sure]], mine[v[sure]])
        if not sure.all():
            doubt = [np.concatenate([x, y[~sure]]) for x, y in zip(doubt, (u, v, far), strict=True)]
            if len(doubt[0]) > KEPT or sets is not None:
                doubt = list(nearest(*doubt))
    if len(doubt[0]):
        doubt = list(nearest(*doubt))
    if sets is not None:
        u, v = (np.array([p[k] for p in confirmed], np.int64) for k in (0, 1))
        return rows["node"][u], rows["node"][v]
    u, v = close.pairs()
    a, b = np.concatenate([known[u], known[mine[doubt[0]]]]), np.concatenate([known[v], known[mine[doubt[1]]]])
    return np.minimum(a, b), np.maximum(a, b)


def _parts(prints: DataFrame, shape: Shape, rows: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells that weigh more than ``limit``, sorted, and the parts they are dealt to. Cells are as many as blocks have values:
    262,144 for 64 bits and 3 errors; a row weighs 1, or as many as its set has members."""
    if rows <= limit:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shape.cells(_lanes(batch.column(0), shape.words))
            found, at = np.unique(cells, return_inverse=True)
            weight = np.bincount(at.ravel(), np.repeat(batch.column(1).to_numpy(), shape.copies))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(weight.astype(np.int64))], names=["cell", "weight"])

    weighed = prints.select("lanes", F.greatest(F.lit(1), F.coalesce("size", F.lit(1))).cast("long")).mapInArrow(run, "cell long, weight long")
    hot = weighed.groupBy("cell").agg(F.sum("weight").alias("weight")).where(F.col("weight") > limit).orderBy("cell").collect()
    return np.array([r["cell"] for r in hot], np.uint32), np.array([min(60_000, -(-2 * r["weight"] // limit)) for r in hot], np.int64)


def _lanes(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def trie_links(prints: DataFrame, rows: int, shape: Shape, alike: Callable[[np.ndarray, np.ndarray], bool] | None = None) -> DataFrame:
    """Links (a, b) that join the same nodes as all links of ``prints`` do.

    ``prints``: node long, lanes binary (big-endian 64-bit words), size int (may be null), from a
    written table of ``rows`` rows. Two nodes are linked if in any of the shape's tables they
    differ in its errors at most, and, if ``most`` is given, in all bits in its last limit at
    most. Links within its first limit come first, then nearer ones before others.

    With ``alike``, ``prints`` also has a label (long) and a set (binary, ``size`` numbers of 64 bits):
    only links between different labels are looked for, each of them is put to ``alike``, and
    none is passed over unless links that it confirmed join the two labels already. ``rows`` is
    then the size of all sets.
    """
    limit = lot_limit() if alike else CELL
    hot, parts = _parts(prints, shape, rows, limit)
    buckets = max(BUCKETS_EACH * width(prints.sparkSession), -(-rows * shape.copies // limit))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.cumsum(batch.column(2).to_numpy().astype(np.int64)) // (limit // shape.copies) if alike else np.arange(batch.num_rows) // DEALT
            cuts = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield pack(batch.slice(a, b - a))
        release()

    def pack(part: pa.RecordBatch) -> pa.RecordBatch:
        node = part.column(0).to_numpy()
        lanes = _lanes(part.column(1), shape.words)
        cells = shape.cells(lanes)
        at, cell = np.repeat(np.arange(len(node)), shape.copies), cells.ravel()
        own = i = j = np.zeros(len(at), np.int64)
        if len(hot):
            found = np.searchsorted(hot, cell)
            found[found == len(hot)] = 0
            times = np.where(hot[found] == cell, parts[found], 1)
            salt = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            own = (salt[at] % times.astype(np.uint64)).astype(np.int64)
            other = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            at, cell, own = np.repeat(at, times), np.repeat(cell, times), np.repeat(own, times)
            i, j = np.minimum(own, other), np.maximum(own, other)
        entries = np.zeros(len(at), shape.entry)
        entries["cell"], entries["own"], entries["i"], entries["j"] = cell, own, i, j
        entries["node"], entries["lanes"] = node[at], lanes[at]
        raw: list[bytes] = []
        if alike:
            raw = part.column(4).to_pylist()
            entries["size"] = part.column(2).to_numpy()[at]
            entries["label"] = part.column(3).to_numpy()[at]
        mixed = (cell.astype(np.uint64) << np.uint64(32) | (i << 16 | j).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, cuts = np.unique(bucket[order], return_index=True)
        packed, sets = [], []
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            packed.append(entries[order[x:y]].tobytes())
            sets.append(b"".join([raw[r] for r in at[order[x:y]].tolist()]) if alike else None)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(packed, pa.binary()), pa.array(sets, pa.binary())], names=["bucket", "packed", "sets"])

    def bucket(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group["packed"].to_pylist()), shape.entry)
        sets = _sets(b"".join(group["sets"].to_pylist()), rows["size"]) if alike else None
        a, b = _bucket_links(shape, rows, sets, alike)
        out = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        del rows, sets, group
        if len(a) > 1000:
            release()
        return out

    names = ["node", "lanes", F.col("size").cast("int"), *(["label", "set"] if alike else [])]
    dealt = prints.select(*names).mapInArrow(deal, "bucket long, packed binary, sets binary")
    return dealt.groupBy("bucket").applyInArrow(bucket, "a long, b long")


def lot_limit() -> int:
    """Members of all sets that one task joins, about: 8 bytes each."""
    return 16 * CELL


def lot_links(prints: DataFrame, members: int, shape: Shape, alike: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """As ``trie_links`` with ``alike``, within lots: ``prints`` also has ``lot`` (long), each of at most ``lot_limit`` of the ``members`` of all sets. Rows are not copied."""
    buckets = max(BUCKETS_EACH * width(prints.sparkSession), -(-2 * members // lot_limit()))

    def bucket(group: pa.Table) -> pa.Table:
        node, label, lot = (group[c].to_numpy() for c in ("node", "label", "lot"))
        sets = [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
        lanes = _lanes(group["lanes"].combine_chunks(), shape.words)
        found = [(node[:0], node[:0])]
        for one in np.unique(lot).tolist():
            own = np.flatnonzero(lot == one)
            at = np.repeat(own, shape.copies)
            rows = np.zeros(len(at), shape.entry)
            rows["cell"], rows["node"], rows["label"], rows["lanes"] = shape.cells(lanes[own]).ravel(), node[at], label[at], lanes[at]
            found.append(_bucket_links(shape, rows, [sets[i] for i in at.tolist()], alike))
        release()
        return pa.table({"a": pa.array(np.concatenate([x for x, _ in found]), pa.int64()), "b": pa.array(np.concatenate([x for _, x in found]), pa.int64())})

    dealt = prints.select("node", "lanes", "size", "label", "set", "lot", F.pmod(F.xxhash64("lot"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(bucket, "a long, b long")
