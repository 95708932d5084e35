"""WARC archives of pages: written as whole gzip streams, normalised to a member a record with an index, read by it.

* ``write_archives`` writes each partition as one stream of WARC records in one gzip member:
  Spark's text writer with the end of a record as its line separator. A page whose payload
  another has, too, becomes a revisit of it.
* ``normalise`` reads such streams line by line, so that Spark inflates each of them once and
  no file need fit in memory, and rewrites every record as a gzip member of its own in
  archives of bounded size; a sidecar table has the place of every record.
* ``read_records`` cuts the members out by the sidecar, inflates them one by one and checks digests.

Files are written and read by Spark alone, so they may lie in any store it knows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.members import possible
from trawl.llm.shared import bounded_batches, forget, materialise, new_path, release, struct, table

#: Payloads of fewer bytes are never revisits; an archive ends after so many compressed bytes.
LEAST, ARCHIVE_BYTES = 1000, 16 << 20
#: What the records are dated, where the pages have no date.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:trawl:page:"
END, GZIP = b"\r\n\r\n", 31
#: The last byte of a gzip member of less than 16 MB, its size being little-endian, and of the empty member.
NUL = b"\0"

INDEX = T.StructType([T.StructField(n, T.LongType() if n in ("offset", "length") else T.StringType()) for n in ("offset", "length", "record_type", "record_id", "target_uri", "payload_digest")])
ARCHIVE = T.StructType([T.StructField("archive", T.StringType()), T.StructField("body", T.BinaryType()), T.StructField("entries", T.ArrayType(INDEX))])
RECORD = struct(record_id="string", record_type="string", target_uri="string", refers_to="string", payload_bytes="long", payload_digest="string", payload="binary")


# ---- writing


def with_revisits(pages: DataFrame, id_col: str, url_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(id, url, size, digest, payload, refers, revisit) of every page; the payload of a revisit is null.

    Of pages with one payload of ``least`` bytes or more the one with the largest id (null is
    smallest; one of them, if several have it) is stored and the others revisit it. Only pages
    whose payload may occur twice, by a filter of bounded size, are written and shuffled for
    that; whose payload it is, is decided on rows without payloads.
    """
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "mix": F.xxhash64("payload")})
    same = ["digest", "size", "mix"]
    seen = rows.where(F.col("size") >= least).groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = possible(rows, same, seen, same, "maybe")
    lot = materialise(marked.where("maybe").drop("maybe").withColumn("row", F.monotonically_increasing_id()), "warc-copies")
    copies = lot.where(F.col("size") >= least)
    top = copies.groupBy(*same).agg(F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = copies.drop("payload").join(top.drop("n"), same).where(F.col("row") != F.col("top.row"))
    first = lot.join(again.select("row"), "row", "left_anti")
    kept, none = ["id", "url", "size", "digest"], F.lit(None)
    stored = marked.where("NOT maybe").select(*kept, "payload").unionByName(first.select(*kept, "payload"))
    stored = stored.select(*kept, "payload", none.cast(rows.schema["id"].dataType).alias("refers"), F.lit(False).alias("revisit"))
    return stored.unionByName(again.select(*kept, none.cast("binary").alias("payload"), F.col("top.id").alias("refers"), F.lit(True).alias("revisit")))


def _uri(c: F.Column) -> F.Column:
    """A header must be one line."""
    return F.replace(F.replace(F.coalesce(c, F.lit("urn:trawl:none")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _name(c: F.Column) -> F.Column:
    return F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))


def record_texts(rows: DataFrame, date: str = DATE) -> DataFrame:
    """(value) of the rows of ``with_revisits``: WARC records without the two line ends after them."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = (F.octet_length(http) + F.coalesce(F.octet_length("payload"), F.lit(0))).cast("string")
    parts = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _name(F.col("id")), F.lit("\r\nWARC-Target-URI: "), _uri(F.col("url")), F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _name(F.col("refers")), F.lit("\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length, F.lit("\r\n\r\n"),
        http, F.coalesce(F.col("payload").cast("string"), F.lit("")),
    ]
    return rows.select(F.concat(*parts).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST, date: str = DATE) -> None:
    """Writes a WARC record for every page below ``path``, a gzip stream for each partition.

    Null texts are empty payloads, null ids are called null, null addresses urn:trawl:none;
    line ends in addresses are escaped. Rows that repeat are records of their own. Other
    columns are not looked at. A table without rows gives archives without records.
    """
    records = record_texts(with_revisits(pages, id_col, url_col, text_col, least), date)
    records.write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


# ---- normalising


def _fields(head: bytes) -> dict[bytes, bytes]:
    """Header lines by name in lower case; a line that begins with a blank goes on with the one before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}


class Splitter:
    """Cuts a stream of WARC records, which comes in pieces, into (header fields, record with the two line ends)."""

    def __init__(self) -> None:
        self.held, self.wanted, self.fields = bytearray(), 0, {}

    def feed(self, piece: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        self.held += piece
        at = 0
        while True:
            if not self.wanted:
                while self.held[at : at + 2] == b"\r\n":
                    at += 2
                end = self.held.find(END, at)
                if end < 0:
                    break
                head = bytes(self.held[at:end])
                if not head.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record begins here: {head[:40]!r}")
                self.fields = _fields(head)
                self.wanted = end - at + 4 + int(self.fields[b"content-length"]) + 4
            if len(self.held) < at + self.wanted:
                break
            record = bytes(self.held[at : at + self.wanted])
            if not record.endswith(END):
                raise ValueError("a WARC record is longer than it says")
            at, self.wanted = at + self.wanted, 0
            yield self.fields, record
        del self.held[:at]

    def close(self) -> None:
        if self.wanted or self.held.strip():
            raise ValueError("a WARC file ends within a record")


def member(record: bytes) -> bytes:
    """A record as a gzip member; equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return z.compress(record) + z.flush()


def _text(fields: dict[bytes, bytes], name: bytes) -> str | None:
    return fields[name].decode("utf-8", "replace") if name in fields else None


class _Archive:
    def __init__(self) -> None:
        self.members, self.size, self.entries = [], 0, []

    def add(self, fields: dict[bytes, bytes], record: bytes) -> None:
        self.members.append(member(record))
        n = len(self.members[-1])
        what = [_text(fields, k) for k in (b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-payload-digest")]
        self.entries.append(dict(zip(INDEX.names, [self.size, n, *what], strict=True)))
        self.size += n

    def row(self, name: str) -> dict:
        """The body lacks the NUL at its end: that is what the text writer ends its one line with."""
        if not self.members[-1].endswith(NUL):  # a record of 16 MB or more: an empty member follows it
            self.members.append(member(b""))
        return {"archive": name, "body": b"".join(self.members)[:-1], "entries": self.entries}


def normalise(spark: SparkSession, source: str, target: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Rewrites gzip streams of WARC records below ``source``: archives below ``target``/archives, sidecar in ``target``/index.

    A stream is read once, by one task, whatever its size; the task holds a record and an
    archive at a time. Archives are named after their stream and their number in it, so a task
    that runs again makes the same ones. Records of any type are kept as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(spark)
    arrow = to_arrow_schema(ARCHIVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seq, splitter, archive = None, 0, Splitter(), _Archive()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal archive, seq
            if archive.members:
                yield pa.RecordBatch.from_pylist([archive.row(f"{file & 0xFFFFFFFFFFFFFFFF:016x}-{seq:06d}")], schema=arrow)
                archive, seq = _Archive(), seq + 1

        for batch in batches:
            files, lines, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(files):
                if files[at] != file:
                    splitter.close()
                    yield from out()
                    file, seq, splitter = files[at], 0, Splitter()
                end = at + 1
                while end < len(files) and files[end] == file:
                    end += 1
                for fields, record in splitter.feed(b"\n".join(lines[at:end]) + b"\n"):
                    archive.add(fields, record)
                    if archive.size >= archive_bytes:
                        yield from out()
                at = end
        splitter.close()
        yield from out()
        release()

    lines = spark.read.schema("value string").option("lineSep", "\n").text(source)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    members = new_path(spark, "warc-members")
    lines.mapInArrow(run, ARCHIVE).write.option("compression", "uncompressed").parquet(members)
    made = spark.read.schema(ARCHIVE).parquet(members)
    made.select("archive", F.col("body").cast("string").alias("value")).write.option("lineSep", NUL.decode()).partitionBy("archive").text(f"{target}/archives")
    made.select("archive", F.inline("entries")).write.parquet(f"{target}/index")
    forget(spark, members)


# ---- reading


def index_of(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar: archive, offset, length and what each record is."""
    return spark.read.schema(T.StructType([ARCHIVE["archive"], *INDEX.fields])).parquet(f"{target}/index")


def parsed(record: bytes) -> dict:
    """A record of an HTTP response, or a revisit of one; the digest of a payload that is there is checked."""
    head, _, block = record[: -len(END)].partition(END)
    fields = _fields(head)
    http, _, payload = block.partition(END)
    revisit = fields[b"warc-type"] == b"revisit"
    digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    size = int(_fields(http)[b"content-length"])
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields[b'warc-record-id']!r} is damaged")
    texts = {n: _text(fields, k) for n, k in (("record_id", b"warc-record-id"), ("record_type", b"warc-type"), ("target_uri", b"warc-target-uri"), ("refers_to", b"warc-refers-to"))}
    return texts | {"payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


def read_records(spark: SparkSession, target: str, wanted: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, or those of ``wanted``, which are rows of the sidecar.

    Archives come as whole files of bounded size; places in them come from the sidecar, and
    each member is inflated by itself, so a damaged one harms no other before it is met.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(spark)
    schema = RECORD if payloads else T.StructType(RECORD.fields[:-1])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, rows, size = batch.column(0)[i].as_buffer(), [], 0
                for place in batch.column(1)[i].as_py():
                    rows.append(parsed(zlib.decompress(body[place["offset"] : place["offset"] + place["length"]], GZIP)))
                    size += rows[-1]["payload_bytes"]
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=arrow)
        release()

    bodies = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{target}/archives")
    bodies = bodies.select(F.regexp_extract("path", "/archive=([^/]+)/", 1).alias("archive"), "content")
    places = (index_of(spark, target) if wanted is None else wanted).groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places"))
    return bodies.join(places, "archive").select("content", "places").mapInArrow(run, schema)


def page_number(record_id: F.Column) -> F.Column:
    """The page that a record's name was made of; null for a null id."""
    return F.regexp_extract(record_id, f"^<{ID}(-?[0-9]+)>$", 1).try_cast("long")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC, normalised and read back by the sidecar index."""
    pages, path = table(spark, sf_dir, "pages"), new_path(spark, "warc")
    write_archives(pages, f"{path}/streams")
    normalise(spark, f"{path}/streams", f"{path}/normal")
    forget(spark, f"{path}/streams")
    found = read_records(spark, f"{path}/normal", payloads=False)
    return found.select(page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number(F.col("refers_to")).alias("refers_to"))


QUERIES = {"op12_warc": op12_warc}
ORACLE_SQL = {
    "op12_warc": """
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, CASE WHEN payload_bytes < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages))"""
}
