"""Byte-level BPE encoding by ranked merges, and decoding.

Distinct pre-tokens meet once. Spark's higher-order functions start from the array of a
word's bytes and fold over it: each step joins the leftmost pair of lowest rank and looks
up only the two new pairs. The rank map comes in the rows, as the arrays of a perfect hash
of pairs of ids: a lookup in a map is a scan, and a literal is megabytes of each text of the
plan, which the driver makes and keeps at every step of a query. Words beyond
``FOLD_BYTES`` bytes would fold in quadratic time; these are merged with a heap instead,
with the same result. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import release, short_plans, table, tidy
from trawl.llm.vocab import merge_by_rank, read_ranks, split_pattern, splitter, vocabulary_path
from trawl.llm.word_chunks import Step, by_chunk, check_numbers, distinct_words, sender, split_words

ID_BITS = 24
#: Longest word, in bytes, that is folded by higher-order functions.
FOLD_BYTES = 512


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """What two neighbouring pieces join to: the pairs of their ids as keys, sorted, and the ranks.

    Merges inside a span that none crosses go as they would in the span alone. So where lower ranks
    leave exactly two parts of each piece, as in vocabularies whose ranks grow as they were
    merged, a piece is only ever joined from these, and one pair a piece is enough. In any other
    vocabulary all ways to cut a piece in two pieces are pairs.
    """
    long = [(piece, rank) for piece, rank in ranks.items() if len(piece) > 1]
    parts = [merge_by_rank(piece, ranks, rank) for piece, rank in long]
    keys, found = array("q"), array("i")
    if all(len(p) == 2 for p in parts):
        for (_, rank), (a, b) in zip(long, parts, strict=True):
            keys.append(a << ID_BITS | b)
            found.append(rank)
    else:
        for piece, rank in long:
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << ID_BITS | b)
                    found.append(rank)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(found, np.int32)[order]


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slot for each key without collisions: the shift of each bucket, and the index of the key in each slot (-1: none). Both are powers of 2 long."""
    import xxhash

    slot_bits = max(4, math.ceil(math.log2(max(1, len(keys)) * 1.3)))
    bucket_bits = slot_bits - 2

    h = np.fromiter((xxhash.xxh64_intdigest(k.tobytes(), 42) for k in keys), np.uint64, len(keys)).astype(np.uint64)
    bucket = (h & np.uint64((1 << bucket_bits) - 1)).astype(np.int64)
    first = (h >> np.uint64(20) & np.uint64(0xFFFFF)).astype(np.int64)
    step = (h >> np.uint64(42) & np.uint64(0x3FFFF) | np.uint64(1)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange((1 << bucket_bits) + 1))
    shifts, slots, mask = np.zeros(1 << bucket_bits, np.int32), np.full(1 << slot_bits, -1, np.int32), (1 << slot_bits) - 1
    sizes = np.diff(cuts)
    for b in np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())].tolist():
        own = order[cuts[b] : cuts[b + 1]]
        for shift in range(1 << 12):
            at = first[own] + shift * step[own] & mask
            if (slots[at] < 0).all() and len(set(at.tolist())) == len(at):
                break
        else:
            raise ValueError("no shift keeps a bucket's keys apart")
        shifts[b], slots[at] = shift, own
    return shifts, slots


class RankTables:
    """The rank map as arrays: ids of bytes, ranks of byte pairs, and the hash of all pairs. Executors send them with the words, a row for many."""

    KINDS = {"byte_ids": "int", "byte_pairs": "int", "shifts": "int", "keys": "bigint", "values": "int"}

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, found = pair_ranks(ranks)
        shifts, slots = perfect_hash(keys)
        self.slots, self.buckets = len(slots), len(shifts)
        empty = slots < 0
        at = np.where(empty, 0, slots)
        self.arrays = {
            "byte_ids": pa.array([ranks.get(bytes((i,))) for i in range(256)], pa.int32()),
            "byte_pairs": pa.array([ranks.get(bytes(divmod(i, 256))) for i in range(1 << 16)], pa.int32()),
            "shifts": pa.array(shifts, pa.int32()),
            "keys": pa.array(np.where(empty, -1, keys[at] if len(keys) else -1), pa.int64()),
            "values": pa.array(np.where(empty, 0, found[at] if len(keys) else 0), pa.int32()),
        }
        release()


class RankColumns:
    """The arrays of ``RankTables`` as columns of the row."""

    def __init__(self, tables: RankTables) -> None:
        self.slots, self.buckets = tables.slots, tables.buckets
        self.byte_ids, self.byte_pairs, self.shifts, self.keys, self.values = map(F.col, tables.KINDS)


class RankLiterals:
    """The arrays of ``RankTables`` as foldable literals: for rows that come without them. They are megabytes of the plan."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tables = RankTables(ranks)

        def literal(name: str) -> Column:
            return F.from_json(F.lit(json.dumps(tables.arrays[name].to_pylist(), separators=(",", ":"))), f"array<{tables.KINDS[name]}>")

        self.slots, self.buckets = tables.slots, tables.buckets
        self.byte_ids, self.byte_pairs, self.shifts, self.keys, self.values = map(literal, tables.KINDS)


def fold_merges(raw: Column, ranks: RankColumns | RankLiterals) -> Column:
    """Ids, array<int>, of a word of two bytes or more, given as ``raw``, the array<int> of its bytes."""

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """A lambda's variable is evaluated once, however often its body names it."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def bits(h: Column, start: int, mask: int) -> Column:
        return F.shiftrightunsigned(h, start).bitwiseAND(F.lit(mask))

    def slot(h: Column) -> Column:
        shift = F.get(ranks.shifts, bits(h, 0, ranks.buckets - 1).cast("int"))
        return (bits(h, 20, 0xFFFFF) + shift * bits(h, 42, 0x3FFFF).bitwiseOR(F.lit(1))).bitwiseAND(F.lit(ranks.slots - 1)).cast("int")

    def rank(key: Column) -> Column:
        """The rank of a pair, null if it has none. The arrays stand in the plan once: literals are kept and shown as text."""
        return let(let(F.xxhash64(key), slot), lambda i: F.when(F.get(ranks.keys, i) == key, F.get(ranks.values, i)))

    def pair(a: Column, b: Column) -> Column:
        return F.shiftleft(a.cast("long"), ID_BITS).bitwiseOR(b.cast("long"))

    none = F.array().cast("array<int>")
    pieces = F.transform(raw, lambda b: F.get(ranks.byte_ids, b))
    pairs = F.transform(F.sequence(F.lit(0), F.size(raw) - 2), lambda i: F.get(ranks.byte_pairs, F.get(raw, i) * 256 + F.get(raw, i + 1)))
    start = F.struct(pieces.alias("p"), pairs.alias("r"))

    def merge(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def joined(at: Column, new: Column) -> Column:
            beside = F.transform(F.array(pair(F.get(p, at - 2), new), pair(new, F.get(p, at + 1))), rank)
            kept = F.when(at > 2, F.slice(r, F.lit(1), at - 2)).otherwise(none)
            first = F.when(at > 1, 1).otherwise(2)
            count = F.when(at < F.size(r), 3 - first).otherwise(2 - first)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"),
                F.concat(kept, F.slice(beside, first, count), F.slice(r, at + 2, F.size(r))).alias("r"),
            )

        def step(best: Column) -> Column:  # the rank of a joined piece is its id
            return F.when(best.isNotNull(), let(F.array_position(r, best).cast("int"), lambda at: joined(at, best))).otherwise(acc)

        return let(F.array_min(r), step)

    return F.aggregate(F.sequence(F.lit(2), F.size(raw)), start, merge)["p"]


#: Bytes of words and places after which a row of words is full.
ROW_BYTES = 1 << 21

#: A row of words, with the arrays that their merges are looked up in.
SPELT = "words array<struct<places: binary, raw: array<int>, ids: array<int>>>, " + ", ".join(f"{name} array<{kind}>" for name, kind in RankTables.KINDS.items())


def _spell(ranks: dict[bytes, int], tables: RankTables) -> Step:
    """The step from rows (word, places) to rows of ``SPELT``: raw are the bytes to fold; ids are given of words that are pieces or too long to fold."""
    beside = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in tables.arrays.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [merge_by_rank(w, ranks) if w in ranks or len(w) > FOLD_BYTES or len(w) < 2 else None for w in words]
            raw = [w if i is None else b"" for w, i in zip(words, ids, strict=True)]
            ends = np.cumsum([0, *map(len, raw)], dtype=np.int32)
            spelt = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)))
            rows = pa.StructArray.from_arrays([batch.column(1), spelt, pa.array(ids, pa.list_(pa.int32()))], names=["places", "raw", "ids"])
            weight = np.cumsum([4 * len(w) + len(p) for w, p in zip(words, batch.column(1).to_pylist(), strict=True)])
            cuts = [*np.flatnonzero(np.diff(weight // ROW_BYTES, prepend=-1)).tolist(), len(words)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = pa.ListArray.from_arrays(pa.array([a, b], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([own, *beside], names=["words", *tables.arrays])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, token_ids (array<int>, only with ``keep_ids``), ids_sha256, decoded_sha256.

    The hashes are of the decimal ids joined by one space and of the bytes decoded from the
    ids. A null text counts as empty; null and repeated ids keep their rows; other columns
    are not read; an empty table gives an empty result.
    """
    short_plans(docs.sparkSession)
    tidy(docs.sparkSession)
    ranks = read_ranks(vocabulary or vocabulary_path("byte_bpe_50k.tiktoken"))
    id_type = docs.schema[id_col].dataType
    public, pattern = pattern is None, pattern or split_pattern()
    chunks = split_words(docs, id_col, text_col, lambda: splitter(pattern, public), frequencies=False)
    tables = RankTables(ranks)
    words = distinct_words(chunks, _spell(ranks, tables), SPELT)
    folded = F.transform("words", lambda w: F.struct(w["places"].alias("places"), F.coalesce(w["ids"], fold_merges(w["raw"], RankColumns(tables))).alias("ids")))
    encoded = words.select(F.inline_outer(folded))  # no row is empty; from an inner one Spark infers a filter that folds again
    send, sent = sender(id_type)
    back = encoded.mapInArrow(send, sent)
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * keep_ids
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece

    def finish(dictionary: tuple, packs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        lens, starts, values = dictionary
        digits = [b"%d" % i for i in range(len(pieces))]
        shown, decoded = [], []
        for word, n in zip(starts.tolist(), lens.tolist(), strict=True):
            ids = values[word : word + n].tolist()
            shown.append(b" ".join([digits[i] for i in ids]))
            decoded.append(b"".join([pieces[i] for i in ids]))
        for ids, _, sizes, numbers, _ in packs:
            check_numbers(numbers, len(shown))
            l = lens[numbers]
            total = np.concatenate([[0], np.cumsum(l)])
            ends = np.cumsum(sizes, dtype=np.int64)
            counts = total[ends] - total[ends - sizes]
            hashes: list[list[str]] = [[], []]
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                mine = numbers[a:b].tolist()
                hashes[0].append(hashlib.sha256(b" ".join([shown[w] for w in mine])).hexdigest())
                hashes[1].append(hashlib.sha256(b"".join([decoded[w] for w in mine])).hexdigest())
            columns = [pa.array(ids, arrow.field(0).type), pa.array(counts), pa.array(hashes[0]), pa.array(hashes[1])]
            if keep_ids:
                at = np.repeat(starts[numbers] - total[:-1], l) + np.arange(int(total[-1]))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values[at].astype(np.int32))))
            yield pa.Table.from_arrays(columns, names=arrow.names).cast(arrow).to_batches()[0]

    return by_chunk(chunks, back, finish, schema)


def decode_ids(df: DataFrame, ids_col: str, vocabulary: str | None = None) -> DataFrame:
    """Adds ``decoded`` binary: the pieces of the ids, concatenated. Null ids give null."""
    ranks = read_ranks(vocabulary or vocabulary_path("byte_bpe_50k.tiktoken"))
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = base64.b64encode(piece).decode()
    literal = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<binary>")
    joined = F.aggregate(F.transform(F.col(ids_col), lambda i: F.get(literal, i)), F.lit(b""), lambda a, x: F.concat(a, x))
    return df.withColumn("decoded", joined)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; only lengths and hashes are returned."""
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
