"""SimHash near-duplicates: fingerprints of word shingles, joined by a trie of their bits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.components import components
from trawl.llm.members import possible
from trawl.llm.shared import materialise, release, table
from trawl.llm.trie_join import CELL, Shape, lot_limit, lot_links, trie_links

#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def shingle_hashes(raw: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``size``-word shingle of a text, repeats included; A-Z lower-cased; fewer words: of them all."""
    import xxhash

    words = raw.lower().split()  # on bytes both know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, max(1, len(words) - size + 1))


def majority(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """``lanes`` x 64 bits, big-endian: a bit is 1 if set in over half of the hashes; further lanes are of mixed hashes."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), PIECE):
            h = hashes[i : i + PIECE]
            if lane:
                h = (h ^ np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                h = h ^ h >> np.uint64(31)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(hashes)).tobytes())
    return b"".join(out)


def _raw(texts: pa.Array) -> Iterator[bytes]:
    """The texts' bytes one by one; null: none."""
    for t in texts.cast(pa.binary()):
        yield t.as_py() or b""


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, lanes: int, repeats: bool = True) -> DataFrame:
    """Per row of ``docs``: id, lanes (binary). A null or wordless text has all bits zero. Without ``repeats`` a shingle counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (shingle_hashes(raw, shingle) for raw in _raw(batch.column(1)))
            prints = [majority(h if repeats else np.unique(h), lanes) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=[id_col, "lanes"])
        release()

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("lanes", T.BinaryType())]))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, errors: int = 3) -> DataFrame:
    """Per row of ``docs``: id, print (long, the 64 bits), component (smallest id reachable by links of ``errors`` bits at most).

    Texts without words have print zero and are linked like any other. Null ids take part
    and are the component only of groups without any other id. Repeated rows stay.
    """
    prints = fingerprints(docs, id_col, text_col, shingle, 1).withColumn("print", F.conv(F.hex("lanes"), 16, -10).cast("long"))
    prints = materialise(prints.select(id_col, "print"), "prints")
    nodes = materialise(prints.groupBy("print").agg(F.min(id_col).alias("least")), "nodes")
    lanes = nodes.select(F.col("print").alias("node"), F.unhex(F.lpad(F.hex("print"), 16, "0")).alias("lanes"))
    roots = components(trie_links(lanes.withColumn("size", F.lit(None)), nodes.count(), Shape(1, errors)))
    found = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    found = materialise(found, "roots")
    least = materialise(found.groupBy("root").agg(F.min("least").alias("component")), "least")
    groups = materialise(found.join(least, "root").select("print", "component"), "groups")
    return prints.join(groups, "print").select(id_col, "print", "component")


#: Bits that differ between texts of Jaccard similarity s: the angle between sets of like size, whose cosine is 2s/(1+s).
def differing_share(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _digest(text: str | F.Column) -> F.Column:
    """What tells texts of one id apart; null is as empty."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


#: Sets of so many shingles at most are also linked by what is left of them without one shingle.
SMALL = 9


def _wide_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, lanes: int) -> DataFrame:
    """Per row of ``docs``: id, digest, key (128 bits of its set of shingles), size of the set, lanes, and for small sets the keys without one shingle each."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, less = [], [], [], []
            for raw in _raw(batch.column(2)):
                own = np.unique(shingle_hashes(raw, shingle))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(majority(own, lanes))
                less.append([xxhash.xxh3_128_digest(np.delete(own, k).tobytes()) for k in range(len(own))] if len(own) <= SMALL else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), pa.array(less, pa.list_(pa.binary()))], names=["id", "digest", "key", "size", "lanes", "less"])
        release()

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("digest string, key binary, size int, lanes binary, less array<binary>").fields])
    return docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"), text_col).mapInArrow(run, kind)


def _sets_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, set: the sorted hashes of its distinct shingles, packed) for written ``nodes`` (node, id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique(shingle_hashes(raw, shingle)).tobytes() for raw in _raw(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])
        release()

    texts = docs.select(F.col(id_col).alias("text_id"), _digest(text_col).alias("text_digest"), F.col(text_col).alias("text"))
    some = possible(texts, ["text_id", "text_digest"], nodes, ["id", "digest"], "wanted").where("wanted").drop("wanted")
    met = some.join(nodes, some["text_id"].eqNullSafe(nodes["id"]) & (some["text_digest"] == nodes["digest"])).select("node", "text")
    once = met.dropDuplicates(["node"])  # repeated rows have the same text
    return once.mapInArrow(run, "node long, set binary")


def _alike(similarity: float):
    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both)

    return alike


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have at least this Jaccard similarity; no shingles on either side is 1."""
    alike = _alike(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                keep.append(alike(x, y))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    first = pairs.join(sets.withColumnsRenamed({"node": "b", "set": "y"}), "b")
    return first.join(sets.withColumnsRenamed({"node": "a", "set": "x"}), "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: Rows that a row meets by chance in each table, about: beyond that longer ranges are taken.
MET_BY_CHANCE = 400


def near_shape(rows: int, similarity: float, recall: float, errors: int) -> Shape:
    """The ranges that copy a row least often, of those that find texts of this similarity within their errors in one of them by
    ``recall``, in which a row meets few others by chance, and whose cells hold about ``CELL`` rows at most however many rows there are.

    The limits in all bits: what texts half-way to equality differ in on average; and what texts at the similarity differ in, with
    three standard deviations allowed for.
    """
    share, found = differing_share(similarity), []
    for e in range(1, errors + 1):
        for bits in range(20, 61):
            chance = rows * sum(math.comb(bits, k) for k in range(e + 1)) / 2**bits
            if rows / 2 ** (bits // (e + 1)) > CELL / 2 or chance > MET_BY_CHANCE:
                continue
            hit = sum(math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(e + 1))
            tables = math.ceil(math.log(1 - recall) / math.log(1 - hit))
            found.append((tables * (e + 1), -e, bits, tables))
            break  # longer ranges need more tables
    _, e, bits, tables = min(found)
    lanes = max(4, -(-tables * bits // 64))
    n = 64 * lanes
    sure = differing_share((1 + similarity) / 2) * n
    far = share * n + 3 * math.sqrt(n * share * (1 - share))
    return Shape(lanes, -e, tables, bits, tuple(sorted({int(sure + (far - sure) * k / 6) for k in range(7)})))


def _small_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sets where one is the other without one shingle: for unions of ``SMALL`` or fewer all that differ and can be similar. Keys are unique, so each set meets one other for each of its shingles at most."""
    least = math.ceil(1 / (1 - similarity) - 1e-9) if similarity < 1 else SMALL + 1
    parts = nodes.where(F.col("size").between(least, SMALL)).select(F.col("node").alias("x"), F.explode("less").alias("key"))
    return parts.join(nodes.select(F.col("node").alias("y"), "key"), "key").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _rows_and_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, recall: float, errors: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest, key) of ``docs``, and (key, root) of the nodes that have links."""
    shape = near_shape(docs.count(), similarity, recall, errors)
    rows = materialise(_wide_prints(docs, id_col, text_col, shingle, shape.words), "wide")
    nodes = rows.groupBy("key", "size", "lanes").agg(F.min(F.struct("id", "digest")).alias("least"), F.first("less").alias("less"))
    nodes = materialise(nodes.select("key", "size", "lanes", "least.*", "less").withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = materialise(trie_links(nodes, nodes.count(), shape).unionByName(_small_links(nodes, similarity)).distinct(), "pairs")
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(nodes.join(ends, "node").select("node", "id", "digest", "size", "lanes"), "wanted")
    sets = materialise(_sets_of(wanted.select("node", "id", "digest"), docs, id_col, text_col, shingle), "sets")
    links = materialise(_confirmed(found, sets, similarity), "links")
    joined = components(links)
    labelled = materialise(wanted.join(joined, "node", "left").select("node", "lanes", "size", F.coalesce("root", "node").alias("label")), "labelled")
    links = _more_links(found, links, labelled, sets, shape, similarity)
    if links is not None:  # links between groups, by their labels
        above = components(links).select(F.col("node").alias("label"), F.col("root").alias("top"))
        joined = labelled.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("root"))
    return rows.select("id", "digest", "key"), nodes.join(joined, "node", "left").select("key", F.coalesce("root", "node").alias("root"))


def _more_links(found: DataFrame, links: DataFrame, labelled: DataFrame, sets: DataFrame, shape: Shape, similarity: float) -> DataFrame | None:
    """Links (a, b) between labels that pairs which were not confirmed had hidden; None if there are none.

    A pair is hidden only if others lead from one of its ends to the other, some of them not
    confirmed. So what is gone through again, with the sets at hand, is what such pairs connect,
    but for two lone nodes. Each connected lot is joined in one task; one whose sets are larger
    than a task's share is dealt out by cells.
    """
    label = lambda x: labelled.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    failed = found.join(links, ["a", "b"], "left_anti").join(label("a"), "a").join(label("b"), "b").where("la <> lb")
    lots = components(failed.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    lots = lots.unionByName(lots.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("label"), F.col("root").alias("lot"))
    weight = F.sum(F.greatest("size", F.lit(1)))
    of_lot = labelled.join(lots, "label").groupBy("lot").agg(F.count(F.lit(1)).alias("n"), weight.alias("weight")).where("n > 2").select("lot", (F.col("weight") > lot_limit()).alias("large"), "weight")
    of_lot = materialise(of_lot, "lots", share=16)
    total = {r["large"]: r["weight"] for r in of_lot.groupBy("large").agg(F.sum("weight").alias("weight")).collect()}  # two rows
    if not total:
        return None
    again = labelled.join(lots, "label").join(of_lot.select("lot", "large"), "lot").join(sets, "node")
    again = materialise(again.select("node", "lanes", "size", "label", "set", "lot", "large"), "again")
    out = []
    if False in total:
        out.append(lot_links(again.where("NOT large"), total[False], shape, _alike(similarity)))
    if True in total:
        out.append(trie_links(again.where("large").drop("lot", "large"), total[True], shape, _alike(similarity)))
    more = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return materialise(more.join(label("a"), "a").join(label("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links", share=16)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.995, errors: int = 3) -> DataFrame:
    """Per row of ``docs``: id, component (the smallest id of its group), by links of Jaccard similarity of ``similarity`` or more of word shingles.

    Such pairs differ in too many of 64 bits for a join. So the trie is built over several
    short ranges of a long fingerprint, and what it brings together is linked if the shingles
    themselves say so: every link is confirmed. Rows with equal sets of shingles are one node;
    null, empty and wordless texts are equal. Ids may be of any type that has an order; rows
    with null ids take part, and a group of them alone has component null.
    """
    rows, groups = _rows_and_groups(docs, id_col, text_col, shingle, similarity, recall, errors)
    grouped = materialise(rows.join(groups, "key").select("id", "root"), "grouped")
    least = grouped.groupBy("root").agg(F.min("id").alias("component"))
    return grouped.join(least, "root").select(F.col("id").alias(id_col), "component")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.995, errors: int = 3) -> DataFrame:
    """One row of each group of ``near_copies``, all columns: of the smallest id, null last. It is rows that go, whatever the others of their id are.

    Only rows that may go are shuffled.
    """
    rows, groups = _rows_and_groups(docs, id_col, text_col, shingle, similarity, recall, errors)
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("digest"))
    grouped = materialise(rows.groupBy("id", "digest", "key").agg(F.count(F.lit(1)).alias("n")).join(groups, "key").select("id", "digest", "n", "root"), "grouped")
    first = grouped.groupBy("root").agg(F.min(rank).alias("first"))
    stays = (F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.digest") == F.col("digest"))
    judged = grouped.join(first, "root").select(F.col("id").alias("judged_id"), F.col("digest").alias("judged_digest"), stays.alias("judged_first"), "n").where("NOT judged_first OR n > 1").drop("n")
    judged = materialise(judged, "judged")
    own = docs.select(F.struct("*").alias("row"))  # whatever the columns are called
    own = own.select("row", F.col("row")[id_col].alias("id"), _digest(F.col("row")[text_col]).alias("digest"))
    marked = possible(own, ["id", "digest"], judged, ["judged_id", "judged_digest"], "maybe")
    sure, maybe = marked.where("NOT maybe"), marked.where("maybe")
    held = maybe.join(judged, maybe["id"].eqNullSafe(judged["judged_id"]) & (maybe["digest"] == judged["judged_digest"]), "left")
    other, again = held.where("judged_first IS NULL"), held.where("judged_first")
    again = again.dropDuplicates(["id", "digest"])
    return sure.select("row").unionByName(other.select("row")).unionByName(again.select("row")).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, 3 bits."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op6_simhash": op6_simhash}
