"""Which chunker takes a file, and all files of a relation through them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.chunkers.common import Chunk, Options
from trawl.chunkers.prose import prose_chunks
from trawl.chunkers.query_text import xml_query_chunks
from trawl.chunkers.syntax import LANGUAGES, NoTree, syntax_chunks
from trawl.functions.paths import basename, extension
from trawl.functions.text import doc_id, normal_text
from trawl.operators.windows import line_windows

PROSE = (".md", ".markdown", ".mdc", ".txt")


@dataclass(frozen=True)
class Routing:
    strategy: str = "hybrid"  # or prose, line_window
    languages: tuple[str, ...] = ("go", "python", "javascript", "typescript", "bsl")
    include_queries: bool = True


def route_of(ext: str, routing: Routing) -> str:
    """line_window, prose, xml_queries or syntax."""
    ext = ext.lower()
    if routing.strategy == "line_window":
        return "line_window"
    if ext in PROSE:
        return "prose"
    if ext == ".dcs" and "bsl" in routing.languages and routing.include_queries:
        return "xml_queries"
    language = LANGUAGES.get(ext, "")
    known = "typescript" if language == "tsx" else language
    return "syntax" if routing.strategy == "hybrid" and known in routing.languages else "line_window"


def windows_of(path: str, text: str, opts: Options) -> Iterator[Chunk]:
    """Line windows of one file, as the relational form cuts them."""
    from trawl.operators.windows import window_options

    size, over = window_options(opts.window_lines, opts.overlap_lines)
    lines, at = text.split("\n"), 0
    while True:
        body = "\n".join(lines[at : at + size])
        if body.strip():
            start = sum(len(x.encode()) + 1 for x in lines[:at])
            yield Chunk(path, at + 1, min(at + size, len(lines)), body, _kind(path), "line_window", start_byte=start, end_byte=start + len(body.encode()))
        if at + size >= len(lines):
            return
        at += size - over


def _kind(path: str) -> str:
    ext = path[path.rfind(".") :].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return "markdown" if ext in PROSE else "config" if ext in (".yaml", ".yml", ".json", ".toml") else "code"


def chunk_text(path: str, text: str, route: str, opts: Options) -> Iterator[Chunk]:
    """Chunks of one file. A source file without a usable tree falls back to line windows."""
    path = path.replace("\\", "/")
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if route == "prose":
        yield from prose_chunks(path, text, opts, markdown=ext != ".txt")
    elif route == "xml_queries":
        stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        queries, rest = xml_query_chunks(path, text, opts, f"module {stem}")
        yield from queries
        yield from windows_of(path, rest, opts)
    elif route == "syntax":
        try:
            yield from list(syntax_chunks(path, text, LANGUAGES[ext], opts))
        except NoTree:
            yield from windows_of(path, text, opts)
    else:
        yield from windows_of(path, text, opts)


_SCHEMA = "relative_path string, chunk_index int, start_line long, end_line long, start_byte long, end_byte long, chunk_type string, snippet string, symbol_name string, symbol_kind string, parent_scope string, chunk_strategy string"

_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
#: Chunks, and characters of them, that are handed on at once.
HELD, HELD_CHARACTERS = 1000, 1 << 21


def chunk_files(files: DataFrame, opts: Options | None = None, routing: Routing | None = None, path_col: str = "relative_path", text_col: str = "content", errors: bool = False) -> DataFrame:
    """Chunks of all files, with ordinals and ids. Line windows are expressions; the other routes run in Python, file by file.

    With ``errors`` a file whose chunks cannot be made does not fail the others: it comes as one
    row without a snippet, whose ``error`` (null for chunks) says why.
    """
    opts, routing = opts or Options(), routing or Routing()
    rows = files.select(F.col(path_col).alias("relative_path"), normal_text(F.col(text_col)).alias("content"))
    by_python = [e for e in (*PROSE, ".dcs", *LANGUAGES) if route_of(e, routing) != "line_window"]
    special = F.lower(extension(F.col("relative_path"))).isin(by_python)

    schema = f"{_SCHEMA}, error string"
    arrow = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):  # one by one: no batch is held as Python strings
                for row in of_file(path.as_py(), text.as_py()):
                    held.append(row)
                    size += len(row[7] or "")
                    if len(held) >= HELD or size >= HELD_CHARACTERS:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def of_file(path: str, text: str | None) -> Iterator[tuple]:
        name = path.replace("\\", "/")
        made = chunk_text(path, text or "", route_of(path[path.rfind(".") :], routing), opts)
        if errors:  # a file's chunks come all or not at all
            try:
                made = list(made)
            except Exception as e:
                yield (name, 0, *[None] * 10, f"{type(e).__name__}: {e}")
                return
        for k, c in enumerate(made, 1):
            yield name, k, c.start_line, c.end_line, c.start_byte, c.end_byte, c.kind, c.snippet, c.symbol, c.symbol_kind, c.scope, c.strategy, None

    made = rows.where(special).mapInArrow(run, schema) if by_python else None
    windows = line_windows(rows.where(~special) if by_python else rows, window=opts.window_lines, overlap=opts.overlap_lines)
    columns = ["doc_id", *(x.split()[0] for x in _SCHEMA.split(", ")), "name", *(["error"] if errors else [])]
    windows = windows.withColumn("error", F.lit(None).cast("string"))
    if made is None:
        return windows.select(*columns)
    made = made.withColumn("name", basename(F.col("relative_path")))
    path = F.col("relative_path")
    made = made.withColumn("doc_id", doc_id(path, *(F.col(c) for c in ("start_line", "end_line", "start_byte", "end_byte", "chunk_index", "chunk_strategy", "chunk_type", "symbol_name", "snippet"))))
    return made.select(*columns).unionByName(windows.select(*columns))
