"""Text expressions: normal forms, token budgets, ids and fingerprints, query terms, redaction."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.paths import slashes

RUNES_PER_TOKEN = 3.5


def normal_text(text: Column) -> Column:
    """Without a byte order mark, line ends as newlines."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def token_count(text: Column) -> Column:
    return (F.char_length(text) / F.lit(RUNES_PER_TOKEN)).cast("int")


def count_tokens(text: str) -> int:
    return int(len(text) / RUNES_PER_TOKEN)


def character_count(text: Column) -> Column:
    """A token a code point."""
    return F.char_length(text)


@dataclass(frozen=True)
class Fixed:
    """A counter that says the same of any text, one at least."""

    tokens: int

    def __call__(self, text: str) -> int:
        return max(1, self.tokens)


@cache
def _tokenizer(path: str) -> object:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass(frozen=True)
class ByTokenizer:
    """Tokens of a tokenizer file, special ones included, by estimate where it fails on a text; read once a process, so the path must be on every executor."""

    path: str

    def __call__(self, text: str) -> int:
        tokenizer = _tokenizer(self.path)
        try:
            return len(tokenizer.encode(text).ids)
        except Exception:  # the library raises its own type-less errors
            return count_tokens(text)


def counter_of(provider: str, tokenizer_path: str = "") -> Callable[[str], int]:
    """The counter of an embedder's provider, for ``Options.count``: a model's own tokenizer, else the estimate."""
    if provider.lower() != "onnx":
        return count_tokens
    if not Path(tokenizer_path).is_file():
        raise FileNotFoundError(f"no tokenizer file: {tokenizer_path}")
    return ByTokenizer(tokenizer_path)


def content_fingerprint(snippet: Column) -> Column:
    return F.substring(F.sha2(trimmed(snippet), 256), 1, 8)


def doc_id(path: Column, start_line: Column, end_line: Column, start_byte: Column, end_byte: Column, index: Column, strategy: Column, kind: Column, symbol: Column, snippet: Column) -> Column:
    """A chunk's id from its place, kind and content."""
    parts = [slashes(path), start_line, end_line, start_byte, end_byte, index, strategy, kind, symbol, content_fingerprint(snippet)]
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16))


def collection_name(owner: Column, profile: Column, dims: Column) -> Column:
    return F.concat(F.lit("ws_"), F.substring(F.sha2(F.concat_ws(":", owner, profile, dims.cast("string")), 256), 1, 16))


def context_prefix(path: Column, scope: Column) -> Column:
    head = F.concat(F.lit("// file: "), slashes(path), F.lit("\n"))
    return F.when(scope == "", head).otherwise(F.concat(head, F.lit("// scope: "), scope, F.lit("\n")))


def embed_text(path: Column, scope: Column, snippet: Column, prefix: bool = True) -> Column:
    return F.concat(context_prefix(path, scope), snippet) if prefix else snippet


def body_budget(path: Column, scope: Column, max_tokens: int, ratio: float, prefix: bool = True) -> Column:
    total = math.floor(max_tokens * ratio)
    total = total if total > 0 else max_tokens
    if not prefix:
        return F.lit(total)
    return F.greatest(F.lit(1), F.lit(total) - token_count(context_prefix(path, scope)))


def overlap_budget(budget: Column, ratio: float) -> Column:
    n = F.floor(budget * F.lit(ratio if ratio > 0 else 0.12)).cast("int")
    return F.when((n < 1) & (budget > 1), F.lit(1)).otherwise(n)


def query_terms(query: Column) -> Column:
    """Lower-case words of letters and digits, three characters or more, each once, in order."""
    words = F.array_distinct(F.split(F.lower(query), r"[^\p{L}\p{Nd}]+"))
    return F.filter(words, lambda t: F.char_length(t) >= 3)


def terms_of(query: str) -> list[str]:
    words = ("".join(c if c.isalpha() or c.isdecimal() else " " for c in query.lower())).split()
    return list(dict.fromkeys(w for w in words if len(w) >= 3))


HEADING = r"^\s*(#{1,6}) +(\S.*?)\s*$"


def heading_level(line: Column) -> Column:
    return F.char_length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    return F.regexp_extract(line, HEADING, 2)


QUERY_START = r"(?i)^\s*(ВЫБРАТЬ|SELECT)(\s|$)"


def is_query_text(text: Column) -> Column:
    return text.rlike(QUERY_START)


def query_name(text: Column) -> Column:
    """What follows the first word of a query's first line that is not blank; '' for other text."""
    first = F.regexp_extract(text, r"^\s*(\S[^\n]*)", 1)
    fields = F.split(first, r"[\s,]+")
    return F.when(is_query_text(text) & (F.size(fields) > 1), F.get(fields, F.lit(1))).otherwise("")


def opens_fence(line: Column) -> Column:
    return line.rlike(r"^\s*(`{3,}|~{3,})")


def is_table_row(line: Column) -> Column:
    t = trimmed(line)
    return t.startswith("|") | t.endswith("|")


QUERY_BLOCK = r"(?s)<query>(.*?)</query>"


def query_blocks(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(QUERY_BLOCK), F.lit(1))


#: Absolute paths as they stand in messages, up to a quote, bracket or separator.
PATH_IN_TEXT = r"""(?:\\\\|[A-Za-z]:[\\/]|/[A-Za-z_])[^"';,)\]]*"""


def redact_paths(text: Column) -> Column:
    return F.regexp_replace(text, PATH_IN_TEXT, "<redacted>")


# What messages of each class say.
LOCKED = ("lock file", "can't open lock", "can't lock read-only", "read-only collection")
CORRUPT = ("file is too small", "corrupt")
ONE_FILE = ("file too large for indexing", "line too long for indexing", "escapes workspace root", "no such file", "permission denied")


def error_class(message: Column) -> Column:
    """lock, skippable (one file's trouble: corrupt, too large, gone, not allowed) or abort, by what a message says."""
    m = F.lower(message)

    def says(parts: tuple[str, ...]) -> Column:
        return m.rlike("|".join(map(re.escape, parts)))

    return F.when(says(LOCKED), "lock").when(says(CORRUPT), "skippable").when(says(ONE_FILE), "skippable").otherwise("abort")


#: Names that DOS keeps for devices.
DEVICE_NAMES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def valid_collection_id(name: Column) -> Column:
    """Letters, digits, '.', '_' and '-', from a letter or digit on, 64 at most, no '..', no dot at the end, no device name."""
    device = F.lower(F.regexp_extract(name, r"^[^.]*", 0)).isin(*DEVICE_NAMES)
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$") & ~F.contains(name, F.lit("..")) & ~name.endswith(".") & ~device
