"""Documents as chunks of word numbers, and the way of words to whatever knows them.

A chunk is a run of documents of one input partition with its own dictionary of distinct
words, numbered by falling frequency. Two shuffles of packed rows replace a row for each
word of each document:

1. ``split_words`` deals out both the words of a chunk, by word bucket, and its documents as
   word numbers (sequences or frequencies), by chunk. Both readers below use this one shuffle.
2. ``distinct_words``: a bucket's rows meet; each distinct word comes out once, with the
   places (chunk, number) where it is wanted. A word has one place a chunk at most, so
   the commonest word is no hot key. ``sender`` packs what became of the words by chunk.
3. ``by_chunk`` brings this to the chunk's documents, which lie there already.

Chunks are bounded in words, buckets by the session's shuffle width. A chunk's id holds a
hash of its dictionary, so that documents never meet a dictionary of other numbering, should
an input without fixed order be read again after an executor was lost: this raises.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trawl.llm.shared import release, width

#: A chunk ends when it has so many words, or distinct words.
CHUNK_WORDS, CHUNK_DISTINCT = 4_000_000, 250_000
#: Documents in a packed row, and words after which it is full.
PACK_DOCS, PACK_WORDS = 1_000, 250_000
#: Buckets for each shuffle partition, so that hashed buckets lie evenly.
BUCKETS_EACH = 4


def squeeze(*parts: np.ndarray | bytes) -> bytes:
    """Arrays as planes of like bytes, since these compress, then zstd."""
    out = []
    for p in parts:
        if isinstance(p, np.ndarray):
            raw = np.ascontiguousarray(p)
            p = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes() if len(raw) else b""
        out.append(p)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


class Unsqueezed:
    """Reads what ``squeeze`` packed, part by part."""

    def __init__(self, blob: bytes) -> None:
        self.raw, self.at = zstandard.ZstdDecompressor().decompress(blob), 0

    def array(self, n: int, dtype: type) -> np.ndarray:
        size = np.dtype(dtype).itemsize
        planes = np.frombuffer(self.raw, np.uint8, n * size, self.at)
        self.at += n * size
        return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)

    def rest(self) -> bytes:
        return self.raw[self.at :]


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("key", T.LongType()),  # of a chunk, or below zero of a bucket
            T.StructField("chunk", T.LongType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("m", T.IntegerType()),
            T.StructField("blob", T.BinaryType()),
            T.StructField("ids", T.ArrayType(id_type)),
        ]
    )


def split_words(docs: DataFrame, id_col: str, text_col: str, splitter: Callable[[], Callable[[str], list[str]]], frequencies: bool) -> DataFrame:
    """The chunks of ``docs``, dealt out. ``splitter()`` runs on the executors and gives the function that splits a text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, parts = _schema(docs.schema[id_col].dataType), width(docs.sparkSession)
    arrow, buckets = to_arrow_schema(schema), parts * BUCKETS_EACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        split, part, seq = splitter(), TaskContext.get().partitionId(), 0
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        held: list[tuple] = []
        in_chunk = 0

        def row(**x: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"ids": None} | x], schema=arrow)

        def full_chunk() -> Iterator[pa.RecordBatch]:
            nonlocal numbers, in_chunk, seq, held
            words = [w.encode("utf-8", "surrogatepass") for w in numbers]
            met = np.concatenate([h[2] for h in held])
            total = np.bincount(met, np.concatenate([h[3] for h in held]) if frequencies else None, len(words))
            by_rank = np.argsort(-total, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_rank] = np.arange(len(words), dtype=np.uint32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            chunk = xxhash.xxh3_64_intdigest(hashes[by_rank].tobytes() + b"%d %d" % (part, seq)) >> 1
            for cut in _packs(held):
                ids, sizes, lists, counts = zip(*held[cut], strict=True)
                lists = [rank[x] for x in lists]
                if frequencies:  # sorted numbers as differences
                    orders = [np.argsort(x) for x in lists]
                    lists = [np.diff(x[o], prepend=np.uint32(0)).astype(np.uint32) for x, o in zip(lists, orders, strict=True)]
                    counts = [c[o] for c, o in zip(counts, orders, strict=True)]
                flat = np.concatenate(lists)
                times = np.concatenate(counts) if frequencies else b""
                lens = np.array([len(x) for x in lists], np.uint32)
                yield row(key=chunk, chunk=chunk, n=len(lists), m=len(flat), blob=squeeze(np.array(sizes, np.uint64), lens, flat, times), ids=list(ids))
            at = hashes % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(buckets + 1, dtype=np.uint64))
            for b in range(buckets):
                mine = order[cuts[b] : cuts[b + 1]]
                if len(mine):
                    mine = np.array(sorted(mine.tolist(), key=words.__getitem__))
                    own = [words[i] for i in mine.tolist()]
                    yield row(key=-1 - b, chunk=chunk, n=len(own), m=0, blob=squeeze(rank[mine], np.fromiter(map(len, own), np.uint32, len(own)), b"".join(own)))
            numbers, in_chunk, seq, held = defaultdict(count().__next__), 0, seq + 1, []

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                found = split(text)
                in_chunk += len(found)
                times = None
                if frequencies:
                    found = Counter(found)
                    times = np.fromiter(found.values(), np.uint32, len(found))
                mine = np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))
                held.append((batch.column(0)[i].as_py(), len(text.encode("utf-8", "surrogatepass")), mine, times))
                if in_chunk >= CHUNK_WORDS or len(numbers) >= CHUNK_DISTINCT:
                    yield from full_chunk()
        if held:
            yield from full_chunk()
        release()

    return docs.select(id_col, text_col).mapInArrow(run, schema).repartition(parts, "key")


def _packs(held: list[tuple]) -> Iterator[slice]:
    """Slices of a chunk's documents that make one packed row each."""
    start = words = 0
    for i, (_, _, mine, _) in enumerate(held):
        words += len(mine)
        if words >= PACK_WORDS or i + 1 - start >= PACK_DOCS:
            yield slice(start, i + 1)
            start, words = i + 1, 0
    if start < len(held):
        yield slice(start, len(held))


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def distinct_words(chunks: DataFrame, then: Step | None = None, schema: T.StructType | str = "word binary, places binary") -> DataFrame:
    """One row per distinct word of all chunks: word, and places (chunk ids, then numbers, packed).

    ``then`` goes on with these rows in the same Python process and gives rows of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:  # rows of a few buckets, still packed, and documents, which are not wanted here
            wanted = batch.filter(pc.less(batch.column(0), 0)).select([0, 1, 2, 4])
            for r in wanted.to_pylist():
                held.setdefault(r["key"], []).append(r)
        for bucket in sorted(held):
            yield from merged(held.pop(bucket))
        release()

    def merged(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            items = list(places.items())
            for i in range(0, len(items), 5000):
                some = items[i : i + 5000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in some], pa.binary()), pa.array([np.array(p[0::2], np.int64).tobytes() + np.array(p[1::2], np.int64).tobytes() for _, p in some], pa.binary())],
                    names=["word", "places"],
                )

        for r in rows:
            box = Unsqueezed(r["blob"])
            numbers, lens = box.array(r["n"], np.uint32).tolist(), box.array(r["n"], np.uint32)
            raw, ends, chunk = box.rest(), np.cumsum(lens).tolist(), r["chunk"]
            start = 0
            for k, end in zip(numbers, ends, strict=True):
                w = raw[start:end]
                start = end
                if (p := places.get(w)) is None:
                    places[w] = [chunk, k]
                else:
                    p += (chunk, k)
        yield from out()

    return chunks.mapInArrow(run if then is None else lambda batches: then(run(batches)), schema)


#: Word places that a task gathers before it sends them on.
SEND_PLACES = 400_000


def sender(id_type: T.DataType) -> tuple[Step, T.StructType]:
    """The step from rows (places, array<int>) of words to one row per chunk and load: numbers, lengths, values."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(id_type)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            chunk, number, lens, flat, starts = _gather(held)
            order = np.argsort(chunk, kind="stable")
            ids, cuts = np.unique(chunk[order], return_index=True)
            rows = []
            for c, a, b in zip(ids.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                mine = order[a:b]
                mine = mine[np.argsort(number[mine], kind="stable")]
                l = lens[mine]
                at = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(l)[:-1]]), l) + np.arange(int(l.sum()))
                rows.append({"key": c, "chunk": c, "n": len(mine), "m": int(l.sum()), "blob": squeeze(number[mine].astype(np.uint32), l.astype(np.uint32), flat[at].astype(np.uint32)), "ids": None})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            places, values = batch.column(0), batch.column(1)
            pl = [np.frombuffer(p, np.int64) for p in places.to_pylist()]
            held.append((pl, np.diff(values.offsets.to_numpy()), values.flatten().to_numpy(zero_copy_only=False)))
            n += sum(len(p) for p in pl) // 2
            if n >= SEND_PLACES:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()
        held = []
        release()

    return run, schema


def _gather(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """Places of all held words: chunk, number, and where the word's values lie."""
    chunk, number, lens, starts, base = [], [], [], [], 0
    for places, sizes, flat in held:
        times = np.array([len(p) // 2 for p in places])
        chunk += [p[: len(p) // 2] for p in places]
        number += [p[len(p) // 2 :] for p in places]
        lens.append(np.repeat(sizes, times))
        starts.append(np.repeat(base + np.concatenate([[0], np.cumsum(sizes)[:-1]]), times))
        base += len(flat)
    return np.concatenate(chunk), np.concatenate(number), np.concatenate(lens).astype(np.int64), np.concatenate([f for _, _, f in held]), np.concatenate(starts).astype(np.int64)


def by_chunk(chunks: DataFrame, back: DataFrame, finish: Callable[[tuple, Iterator[tuple]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """What came back for a chunk meets its documents. ``finish`` gets the dictionary as (lengths, starts, values)
    by word number, and the documents as tuples (ids, sizes, lengths, numbers, times or None)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows or docs.column("key")[0].as_py() < 0:
            return arrow.empty_table()
        packs = (_pack(row) for b in docs.to_batches(max_chunksize=1) for row in b.to_pylist())
        out = pa.Table.from_batches(finish(_dictionary(found.to_pylist()), packs), schema=arrow)
        release()
        return out

    dealt = back.repartition(width(chunks.sparkSession), "key")
    return chunks.groupBy("key").cogroup(dealt.groupBy("key")).applyInArrow(run, schema)


def _dictionary(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    boxes = []
    for r in rows:
        box = Unsqueezed(r["blob"])
        boxes.append((box.array(r["n"], np.uint32), box.array(r["n"], np.uint32), box.array(r["m"], np.uint32)))
    n = sum(len(b[0]) for b in boxes)
    lens, starts, base = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for numbers, l, values in boxes:
        lens[numbers] = l
        starts[numbers] = base + np.cumsum(l, dtype=np.int64) - l
        base += len(values)
    return lens, starts, np.concatenate([b[2] for b in boxes]) if boxes else np.zeros(0, np.uint32)


def _pack(r: dict) -> tuple:
    box = Unsqueezed(r["blob"])
    sizes, lens, flat = box.array(r["n"], np.uint64), box.array(r["n"], np.uint32), box.array(r["m"], np.uint32)
    if len(box.raw) == box.at:
        return r["ids"], sizes, lens, flat, None
    ends = np.cumsum(lens, dtype=np.int64)
    run = np.cumsum(flat, dtype=np.int64)  # differences, from zero for each document
    before = np.concatenate([[0], run])[ends - lens]
    return r["ids"], sizes, lens, run - np.repeat(before, lens), box.array(r["m"], np.uint32)


def check_numbers(numbers: np.ndarray, known: int) -> None:
    if len(numbers) and int(numbers.max()) >= known:
        raise RuntimeError("a chunk met no dictionary of its own: the input changed its order between two reads; write it to a table first")
