"""Line windows of files that come in pieces: a prefix scan of line and byte counts, then every piece by itself.

A piece may begin and end anywhere, within a line end, a code point or a byte order mark. What
lies before it is told by sums over narrow rows, one a piece; the pieces' texts are never
together in one task, but for the few that one window spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import is_blank
from trawl.operators.windows import _named, window_options

MARK = "EFBBBF"
#: Windows of a file whose ordinals are counted together.
BLOCK = 4096


def _placed(pieces: DataFrame) -> DataFrame:
    """(relative_path, piece, content, skip, line, byte, n): bytes of a piece to leave out, the line and byte of the normal text that it begins in, lines of the file."""
    text = F.col("content").cast("string")
    newlines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    facts = pieces.select(
        "relative_path", "piece", F.octet_length("content").cast("long").alias("raw"), F.hex(F.substring("content", 1, 3)).alias("head"), F.hex(F.expr("substring(content, -1)")).alias("last"),
        F.octet_length(newlines).cast("long").alias("size"), (F.octet_length(newlines) - F.octet_length(F.replace(newlines, F.lit("\n")))).cast("long").alias("ends"),
    )
    before = Window.partitionBy("relative_path").orderBy("piece")
    until = before.rowsBetween(Window.unboundedPreceding, -1)
    heads = F.concat_ws("", "head", F.lead("head", 1).over(before), F.lead("head", 2).over(before))  # a piece has a byte at least
    facts = facts.withColumns({"at": F.coalesce(F.sum("raw").over(until), F.lit(0)), "came": F.lag("last").over(before), "heads": heads})
    marked = F.startswith(F.first("heads").over(before), F.lit(MARK))
    mark = F.when(marked, F.greatest(F.lit(0), F.least(3 - F.col("at"), F.col("raw")))).otherwise(0)
    drop = F.when((F.col("came") == "0D") & F.startswith("head", F.lit("0A")), 1).otherwise(0)  # the second half of a line end
    facts = facts.withColumns({"mark": mark, "drop": drop})
    facts = facts.withColumns({"size": F.col("size") - F.col("mark") - F.col("drop"), "ends": F.col("ends") - F.col("drop")})
    whole = Window.partitionBy("relative_path")
    facts = facts.select("relative_path", "piece", (F.col("mark") + F.col("drop")).alias("skip"), F.coalesce(F.sum("ends").over(until), F.lit(0)).alias("line"), F.coalesce(F.sum("size").over(until), F.lit(0)).alias("byte"), (F.sum("ends").over(whole) + 1).alias("n"))
    return pieces.join(facts, ["relative_path", "piece"])


def _slices(placed: DataFrame, size: int, step: int) -> DataFrame:
    """(relative_path, at, n, byte, part): what a piece holds of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, skip, line, byte, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a mark is at the front, and so is half a line end, which must go before line ends are told
                raw = content[skip:].replace(b"\r\n", b"\n").replace(b"\r", b"\n")
                if not raw:
                    continue
                starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1])
                starts = starts[starts < len(raw)]
                last, count = line + len(starts) - 1, 1 if n <= size else 1 + -(-(n - size) // step)
                rows = []
                for w in range(max(0, -(-(line - size + 1) // step)), min(count - 1, last // step) + 1):
                    a, b = max(w * step, line) - line, min(w * step + size, last + 1) - line
                    if a < b:
                        rows.append((path, w, n, byte + int(starts[a]), raw[starts[a] : starts[b] if b < len(starts) else len(raw)]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["relative_path", "at", "n", "byte", "part"])

    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return placed.select("relative_path", "content", "skip", "line", "byte", "n").mapInArrow(run, "relative_path string, at long, n long, byte long, part binary")


def split_line_windows(pieces: DataFrame, window: int = 0, overlap: int = 0) -> DataFrame:
    """What ``line_windows`` gives of the files that ``pieces`` (relative_path, piece, content binary) make up, in order of piece.

    Empty pieces and files are allowed; bytes that are no UTF-8 are replaced in the snippets.
    """
    size, over = window_options(window, overlap)
    step = size - over
    pieces = pieces.select("relative_path", F.col("piece").cast("long").alias("piece"), F.col("content").cast("binary").alias("content")).where(F.octet_length("content") > 0)
    slices = _slices(_placed(pieces), size, step)
    # rows and counts need the same columns of this shuffle, so that Spark takes it for both
    met = slices.groupBy("relative_path", "at").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("byte", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["part"].cast("string")), "")
    met = met.select("relative_path", "at", "n", F.col("parts")[0]["byte"].alias("start_byte"), text.alias("text"))
    end = F.least(F.col("at") * step + size, F.col("n"))
    text = F.when(end < F.col("n"), F.expr("cast(substring(cast(text as binary), 1, octet_length(text) - 1) as string)")).otherwise(F.col("text"))
    met = met.select("relative_path", "at", (F.col("at") * step + 1).alias("start_line"), end.alias("end_line"), "start_byte", text.alias("raw"), F.make_valid_utf8(text).alias("snippet"))
    kept = met.where(~is_blank(F.col("snippet"))).withColumn("block", F.floor(F.col("at") / BLOCK))
    earlier = Window.partitionBy("relative_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("relative_path", "block").agg(F.count(F.lit(1)).alias("k"))
    counts = counts.select("relative_path", "block", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k"))
    number = F.row_number().over(Window.partitionBy("relative_path", "block").orderBy("at"))
    cut = kept.withColumn("number", number).join(counts, ["relative_path", "block"])
    cut = cut.select("relative_path", (F.col("number") + F.col("k")).cast("int").alias("chunk_index"), "start_line", "end_line", "start_byte", "snippet", (F.col("start_byte") + F.octet_length("raw")).alias("end_byte"))
    return _named(cut)
