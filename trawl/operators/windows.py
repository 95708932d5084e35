"""Line windows in expressions alone: closed form, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.paths import basename, chunk_type, slashes
from trawl.functions.text import doc_id, is_blank, normal_text


def window_options(window: int = 0, overlap: int = 0) -> tuple[int, int]:
    """Defaults are 40 and 8 lines; an overlap as large as the window becomes a quarter of it."""
    window = window if window > 0 else 40
    overlap = overlap if overlap > 0 else 8
    return window, window // 4 if overlap >= window else overlap


def line_windows(files: DataFrame, path_col: str = "relative_path", text_col: str = "content", window: int = 0, overlap: int = 0) -> DataFrame:
    """Chunks of ``files``: windows of lines of the normalised text, blank ones left out, with bytes, ordinal and id.

    A file's windows are built as one array of small structs before they become rows, so its
    lines are not copied once a window; the bytes before a window are sums of whole steps.
    """
    size, over = window_options(window, overlap)
    step = size - over
    lines = files.select(F.col(path_col).alias("relative_path"), F.split(normal_text(F.col(text_col)), "\n", -1).alias("lines"))
    n = F.size("lines")
    count = F.when(n <= size, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - size) / F.lit(step)).cast("int"))
    numbers = F.sequence(F.lit(0), count - 1)
    in_step = F.transform(numbers, lambda k: F.aggregate(F.slice("lines", k * step + 1, F.lit(step)), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1))
    steps = lines.select("relative_path", "lines", numbers.alias("numbers"), in_step.alias("in_step"))

    def one(k):  # noqa: ANN001, ANN202
        return F.struct(
            (k * step + 1).cast("long").alias("start_line"),
            F.least(k * step + size, n).cast("long").alias("end_line"),
            F.aggregate(F.slice("in_step", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x).alias("start_byte"),
            F.array_join(F.slice("lines", k * step + 1, F.lit(size)), "\n").alias("snippet"),
        )

    kept = F.filter(F.transform("numbers", one), lambda w: ~is_blank(w["snippet"]))
    cut = steps.select("relative_path", F.posexplode(kept).alias("at", "w")).select("relative_path", (F.col("at") + 1).alias("chunk_index"), "w.*")
    return _named(cut.withColumn("end_byte", F.col("start_byte") + F.octet_length("snippet")))


def _named(cut: DataFrame) -> DataFrame:
    """Adds what all line windows have in common, and the id."""
    path, none = F.col("relative_path"), F.lit("")
    out = cut.withColumns({"chunk_type": chunk_type(path), "name": basename(path), "symbol_name": none, "symbol_kind": none, "parent_scope": none, "chunk_strategy": F.lit("line_window")})
    made = doc_id(path, F.col("start_line"), F.col("end_line"), F.col("start_byte"), F.col("end_byte"), F.col("chunk_index"), F.col("chunk_strategy"), F.col("chunk_type"), F.col("symbol_name"), F.col("snippet"))
    return out.withColumn("relative_path", slashes(path)).withColumn("doc_id", made)


def longest_line(text):  # noqa: ANN001, ANN201
    """Bytes of the longest line of a text column."""
    return F.array_max(F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x)))


def rejection(max_file_bytes: int = 2 << 20, max_line_bytes: int = 1 << 20, text_col: str = "content"):  # noqa: ANN201
    """Why a file is not indexed, by the size of file and line; null if it is."""
    return F.when(F.octet_length(text_col) > max_file_bytes, "file too large for indexing").when(longest_line(F.col(text_col)) > max_line_bytes, "line too long for indexing")


def acceptable(files: DataFrame, max_file_bytes: int = 2 << 20, max_line_bytes: int = 1 << 20, text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) by size of file and line."""
    marked = files.withColumn("reason", rejection(max_file_bytes, max_line_bytes, text_col))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
