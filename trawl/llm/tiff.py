"""TIFF media columns: pages written from payloads, and one row per page read back.

``read_pages`` walks the image directories of a file (either byte order, classic or big),
decodes PackBits, LZW or deflate strips or tiles, undoes the horizontal predictor and gives
each page's samples. ``write_tiff`` is its inverse for 8-bit grey pages.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trawl.llm.shared import struct as struct_of
from trawl.llm.shared import table

# Fixed values of the format: compressions, tags and field types.
RAW, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 5: "Q", 6: "b", 7: "B", 8: "h", 9: "i", 10: "q", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CLEAR, STOP, FIRST_CODE, LAST_CODE = 256, 257, 258, 4093

_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = row[i : min(i + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(row):
        literal(at, m.start())
        out.extend((257 - (m.end() - m.start()), row[m.start()]))
        at = m.end()
    literal(at, len(row))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
                at += 1
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0
    singles = {bytes((i,)): i for i in range(256)}
    known, following, size = dict(singles), FIRST_CODE, 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << size | code, held + size
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(CLEAR)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        put(known[word])
        known[longer] = following
        following += 1
        if following > LAST_CODE:
            put(CLEAR)
            known, following, size = dict(singles), FIRST_CODE, 9
        elif following >= 1 << size:
            size += 1
        word = data[i : i + 1]
    if word:
        put(known[word])
        following += 1
        if following > LAST_CODE:
            put(CLEAR)
            size = 9
        elif following >= 1 << size:
            size += 1
    put(STOP)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, codes, size, last = [], list(base), 9, None
    bits = held = at = 0
    end = len(data)
    while True:
        while held < size:
            if at >= end:
                return b"".join(out)
            bits, held, at = (bits & 0xFFFFF) << 8 | data[at], held + 8, at + 1
        held -= size
        code = bits >> held & ((1 << size) - 1)
        if code == STOP:
            break
        if code == CLEAR:
            codes, size, last = list(base), 9, None
            continue
        if code > len(codes) - (last is None):
            raise ValueError("a code beyond the table")
        if last is None:
            word = codes[code]
        else:
            word = codes[code] if code < len(codes) else last + last[:1]
            codes.append(last + word[:1])
            if len(codes) + 1 >= 1 << size and size < 12:
                size += 1
        out.append(word)
        last = word
    return b"".join(out)


def _encode(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
    if compression == PACKBITS:
        return b"".join(pack_bits(row.tobytes()) for row in block)
    raw = block.tobytes()
    return lzw_encode(raw) if compression == LZW else zlib.compress(raw, 1) if compression == ADOBE_DEFLATE else raw


def write_tiff(payload: bytes, width: int = 64, page_rows: int = 1024, compression: int = ADOBE_DEFLATE, predictor: int = 2, tile: int = 0) -> bytes:
    """8-bit grey pages of ``width`` samples a row, ``page_rows`` rows at most; strips of 256 rows, or square tiles.

    ``payload`` is whole rows; ``tile`` is a multiple of 16, or 0 for strips.
    """
    if not payload or len(payload) % width:
        raise ValueError("a payload is one or more whole rows")
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(samples), page_rows):
        page = samples[top : top + page_rows]
        if tile:
            down, across = -(-len(page) // tile), -(-width // tile)
            full = np.zeros((down * tile, across * tile), np.uint8)
            full[: len(page), :width] = page
            blocks = [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            blocks = [page[y : y + 256] for y in range(0, len(page), 256)]
        parts = [_encode(b, compression, predictor) for b in blocks]
        places = []
        for p in parts:
            out += b"\0" * (len(out) % 2)
            places.append(len(out))
            out += p
        sizes = [len(p) for p in parts]
        fields = [(WIDTH, [width]), (HEIGHT, [len(page)]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1])]
        if tile:
            fields += [(SAMPLES, [1]), (PREDICTOR, [predictor]), (TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILE_OFFSETS, places), (TILE_BYTES, sizes)]
        else:
            fields += [(STRIP_OFFSETS, places), (SAMPLES, [1]), (ROWS_PER_STRIP, [256]), (STRIP_BYTES, sizes), (PREDICTOR, [predictor])]
        entries = b""
        for tag, values in fields:
            if len(values) == 1:
                entries += struct.pack("<HHII", tag, 4, 1, values[0])
            else:
                out += b"\0" * (len(out) % 2)
                entries += struct.pack("<HHII", tag, 4, len(values), len(out))
                out += struct.pack(f"<{len(values)}I", *values)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(media: bytes) -> list[dict[int, tuple]]:
    """The tags of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or len(media) < 8:
        raise ValueError("no TIFF header")
    magic = struct.unpack_from(order + "H", media, 2)[0]
    if magic == 42:
        count, entry, offset, inline = "H", "HHI", "I", 4
        at = struct.unpack_from(order + "I", media, 4)[0]
    elif magic == 43:
        count, entry, offset, inline = "Q", "HHQ", "Q", 8
        at = struct.unpack_from(order + "Q", media, 8)[0]
    else:
        raise ValueError("no TIFF header")
    out, seen = [], set()
    while at:
        if at in seen:
            raise ValueError("directories in a circle")
        seen.add(at)
        n = struct.unpack_from(order + count, media, at)[0]
        at += struct.calcsize(order + count)
        step = struct.calcsize(order + entry) + inline
        tags = {}
        for i in range(n):
            tag, kind, k = struct.unpack_from(order + entry, media, at + i * step)
            form = FIELD.get(kind)
            if form is None:
                continue
            k *= 2 if kind in (5, 10) else 1
            form = "I" if kind == 5 else "i" if kind == 10 else form
            place = at + i * step + step - inline
            if struct.calcsize(form) * k > inline:
                place = struct.unpack_from(order + offset, media, place)[0]
            if struct.calcsize(form) * k > len(media) - place:
                raise ValueError("a field beyond the file")
            tags[tag] = struct.unpack_from(f"{order}{k}{form}", media, place)
        out.append(tags)
        at = struct.unpack_from(order + offset, media, at + n * step)[0]
    return out


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == RAW:
        raw = data
    elif compression == PACKBITS:
        raw = unpack_bits(data, size)
    elif compression == LZW:
        raw = lzw_decode(data)
    elif compression in (ADOBE_DEFLATE, DEFLATE):
        raw = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression} is not known")
    if len(raw) < size:
        raise ValueError("a strip or tile is too short")
    return raw[:size]


def page_samples(media: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """Height x width x samples of one page, in the machine's byte order."""
    order = "<" if media[:2] == b"II" else ">"
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bits, samples = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(SAMPLES, 1)
    if not width or not height or bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError("only pages of 8 or 16 bits a sample can be read")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(np.uint16).newbyteorder(order)
    planes = samples if one(PLANAR, 1) == 2 else 1
    depth = samples // planes
    if TILE_OFFSETS in tags:
        h, w = one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)
        places, sizes = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        h, w = min(one(ROWS_PER_STRIP, height), height), width
        places = tags[STRIP_OFFSETS]
        sizes = tags.get(STRIP_BYTES) or tuple(len(media) - p for p in places)
    if not h or not w:
        raise ValueError("a strip or tile without area")
    down, across = -(-height // h), -(-width // w)
    if min(len(places), len(sizes)) < down * across * planes:
        raise ValueError("too few strips or tiles")
    if down * across * planes * w * depth * kind.itemsize * min(h, height) > 1 << 32:
        raise ValueError("a page of more than 4 GiB")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(down * across * planes):
        plane, y, x = k // (down * across), k // across % down, k % across
        rows = h if TILE_OFFSETS in tags else min(h, height - y * h)
        raw = _decode(media[places[k] : places[k] + sizes[k]], one(COMPRESSION, RAW), rows * w * depth * kind.itemsize)
        block = np.frombuffer(raw, kind).reshape(rows, w, depth).astype(out.dtype)
        if one(PREDICTOR, 1) == 2:
            block = np.add.accumulate(block, axis=1, dtype=out.dtype)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("a predictor that is not known")
        to = out[y * h : y * h + rows, x * w : (x + 1) * w, plane : plane + 1] if planes > 1 else out[y * h : y * h + rows, x * w : (x + 1) * w]
        to[:] = block[: to.shape[0], : to.shape[1]]
    return out


PAGE_FIELDS = struct_of(
    page="integer", n_pages="integer", width="long", height="long", samples="integer", bits="integer", compression="integer", predictor="integer", tiled="boolean", pixels="binary", error="string"
)
#: Bytes of pages in a batch that leaves a step.
BATCH_BYTES = 4 << 20
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 256
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def page_rows(media: bytes | None) -> Iterator[dict]:
    """A row per page. Null media gives none; a file or page that cannot be read gives a row with ``error``."""
    if media is None:
        return
    try:
        tags = directories(media)
    except (ValueError, struct.error) as e:
        yield {"error": str(e)}
        return
    for page, t in enumerate(tags):
        row = {"page": page, "n_pages": len(tags)}
        try:
            a = page_samples(media, t)
            row |= {"width": a.shape[1], "height": a.shape[0], "samples": a.shape[2], "bits": a.itemsize * 8, "compression": t.get(COMPRESSION, (RAW,))[0], "predictor": t.get(PREDICTOR, (1,))[0], "tiled": TILE_OFFSETS in t, "pixels": a.tobytes()}
        except (ValueError, KeyError, struct.error, zlib.error, MemoryError) as e:
            row["error"] = str(e)
        yield row


def read_pages(df: DataFrame, media_col: str, keep: list[str], then: Step | None = None, schema: T.StructType | None = None) -> DataFrame:
    """One row per page of ``media_col``: the columns ``keep``, then those of ``PAGE_FIELDS``.

    Pages of a file follow each other, in order, in one partition. Null media gives no row,
    media that cannot be read one with ``error``. ``then`` goes on in the same Python
    process. Kept columns must not have names of ``PAGE_FIELDS``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if clash := set(keep) & set(PAGE_FIELDS.names):
        raise ValueError(f"kept columns clash with page columns: {sorted(clash)}")
    own = T.StructType([*[df.schema[c] for c in keep], *PAGE_FIELDS.fields])
    arrow = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    kept = {c: batch.column(k)[i].as_py() for k, c in enumerate(keep)}
                    for row in page_rows(batch.column(len(keep))[i].as_py()):
                        yield kept | row, len(row.get("pixels") or b"")

        return _batches(rows(), arrow)

    return df.select(*keep, media_col).mapInArrow(run if then is None else lambda b: then(run(b)), own if then is None else schema)


def storage_form(payload: bytes) -> dict:
    """How a payload is stored: by its checksum, so that all codecs and layouts are in use and equal payloads are equal files."""
    k = zlib.crc32(payload) % 16
    if k == 0:
        return {"compression": LZW, "predictor": 2}
    if k < 4:
        return {"compression": PACKBITS, "predictor": 1}
    return {"compression": ADOBE_DEFLATE, "predictor": 2, "tile": 32 if k < 8 else 0}


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, payload_bytes, media_bytes, media_sha256, media (a TIFF file).

    The payload is the UTF-8 text (null: empty) with zero bytes up to a positive multiple of 64.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema[id_col], *struct_of(n_bytes="long", payload_bytes="long", media_bytes="long", media_sha256="string", media="binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    raw = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
                    media = write_tiff(payload, **storage_form(payload))
                    yield {id_col: batch.column(0)[i].as_py(), "n_bytes": len(raw), "payload_bytes": len(payload), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "media": media}, len(media)

        return _batches(rows(), arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _digest(kept: list[str], schema: pa.Schema) -> Step:
    """The step from page rows to one row per file: hashes and features of all its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            sha, counts, tail, height, crossed = hashlib.sha256(), np.zeros(256, np.int64), b"", 0, 0
            for batch in batches:
                for r in batch.to_pylist():
                    if r["error"]:
                        raise ValueError(f"a stored file cannot be read back: {r['error']}")
                    pixels = r["pixels"]
                    sha.update(pixels)
                    a = np.frombuffer(pixels, np.uint8)
                    counts += np.bincount(a, minlength=256)
                    crossed += int(np.count_nonzero(np.diff(a.reshape(-1, r["width"]), axis=1)))
                    tail, height = pixels[-64:], height + r["height"]
                    if r["page"] + 1 == r["n_pages"]:
                        total = int(counts.sum())
                        share = counts[counts > 0] / total
                        mean = int((counts * np.arange(256)).sum()) / total
                        feature = f"pages={r['n_pages']};rows={height};mean={mean:.4f};entropy={abs(math.fsum((-share * np.log2(share)).tolist())):.4f};top={int(counts.argmax())};edges={crossed}"
                        yield {c: r[c] for c in kept} | {"payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "feature": feature}, 256
                        sha, counts, tail, height, crossed = hashlib.sha256(), np.zeros(256, np.int64), b"", 0, 0

        return _batches(rows(), schema)

    return run


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as TIFF, read back page by page, and digested."""
    from pyspark.sql.pandas.types import to_arrow_schema

    media = store_texts(table(spark, sf_dir, "documents"))
    keep = ["doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256"]
    schema = T.StructType([*[media.schema[c] for c in keep], *struct_of(payload_sha256="string", tail_crc32="long", feature="string").fields])
    out = read_pages(media, "media", keep, _digest(keep, to_arrow_schema(schema)), schema)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op5_tiff": op5_tiff}
